import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F

from blockwright.llm import spotsigs


def plain_spots(text, chain=2):
    """Signatures as tuples, from the definition."""
    low = (text or "").lower()
    words = [w for w in re.split(r"[\s!-/:-@\[-`{-~]+", low) if w]
    common = {*spotsigs.ANTECEDENTS, *spotsigs.SKIPPED}
    content = [w for w in words if w not in common]
    out = set()
    if content:
        out.add(("\x02", *content[:chain]))
    elif low:
        out.add((low,))
    for i, w in enumerate(words):
        after = [x for x in words[i + 1 :] if x not in common][:chain]
        if w in spotsigs.ANTECEDENTS and after:
            out.add((w, *after))
    for i, w in enumerate(content):
        if xxhash.xxh64(w.encode(), seed=42).intdigest() % spotsigs.ANCHOR_SHARE == 0:
            out.add(("\x03", w, *content[i + 1 : i + 1 + chain]))
    return out


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def test_signatures(spark, rows):
    texts = [(i, r[1]) for i, r in enumerate(rows)] + [(900, "The quick, brown fox of THE forest was a dog."), (901, "the of"), (902, "-- The --")]
    out = spotsigs.with_signatures(spark.createDataFrame(texts, "i int, text string").withColumn("_words", F.lit(1)), "text", "sigs").collect()
    for r in out:
        assert len(r["sigs"]) == len(plain_spots(r["text"])) == len(set(r["sigs"])), r["text"]


def test_query(spark, docs, rows, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = spotsigs.op9_spotsigs(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    distinct = {(r[0], r[1] or "") for r in rows}
    order = sorted(((i, t) for i, t in distinct if i is not None), key=lambda x: -x[0])
    by = {i: t for i, t in order}
    following = {a[0]: b[1] for a, b in zip(order, order[1:], strict=False)}
    for r in out:
        if r["doc_id"] not in following:
            continue
        t, nxt = by[r["doc_id"]], following[r["doc_id"]]
        n = len(t)
        edited = t[: n - n // 2] + nxt[: n // 2]
        assert r["n_chars"] == n and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r["near_edited"] - jaccard(plain_spots(t), plain_spots(edited))) < 1e-9
        assert abs(r["near_next"] - jaccard(plain_spots(t), plain_spots(nxt))) < 1e-9
    texts = {}
    for r in out:
        if r["doc_id"] in by:
            assert texts.setdefault(by[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]


def test_texts_without_antecedents(spark):
    """Long texts that share a beginning only, without any antecedent, tell each other apart, and so do halves."""
    rng = random.Random(8)
    line = "zorb krell mumf tagge"
    texts = [line + " " + " ".join("".join(rng.choice("bdfgklmnprst") for _ in range(5)) for _ in range(300)) for _ in range(12)]
    out = spotsigs.with_signatures(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"), "text", "sigs")
    rows = out.select("i", "text", "sigs", spotsigs.fingerprint(F.col("sigs")).alias("fp")).collect()
    assert len({r["fp"] for r in rows}) == 12 and all(len(r["sigs"]) > 15 for r in rows)
    spots = [plain_spots(r["text"]) for r in rows]
    assert all(jaccard(a, b) < 0.1 for i, a in enumerate(spots) for b in spots[:i])


def test_matches(spark, empty):
    rng = random.Random(5)
    words = [*spotsigs.ANTECEDENTS[:8] * 12, *("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(300))]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 120))) for _ in range(40)]
    for i in range(0, 30, 3):  # near copies, some longer by a third
        near = texts[i].split()
        near[len(near) // 2] = "changed"
        texts += [" ".join(near), " ".join(near + near[: len(near) // 3])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["a"], r["b"]) for r in spotsigs.spot_matches(docs, 0.5).collect()}
    sets = spotsigs.with_signatures(docs, "text", "sigs").select(spotsigs.fingerprint(F.col("sigs")).alias("fp"), "text").distinct().collect()
    spots = {r["fp"]: plain_spots(r["text"]) for r in sets}
    want = {(a, b) for a in spots for b in spots if a < b and spots[a] and spots[b] and jaccard(spots[a], spots[b]) >= 0.5}
    assert got == want and want
    assert spotsigs.spot_matches(empty).count() == 0
