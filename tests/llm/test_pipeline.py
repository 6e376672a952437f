import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plain import near_groups, plain_score, water_filling


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    d = tmp_path_factory.mktemp("corpus")
    docs.write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    return str(d)


def test_stages(spark, docs, folder):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "substring_dedup", "mixing", "bpe"]
    now = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = now.columns, None
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.stored(stage(spark, now, folder), name)
        if name != "bpe":
            assert out.columns == columns
        if name in ("toxicity", "near_dedup"):  # rows go or stay as they are
            assert not Counter(map(tuple, out.collect())) - Counter(map(tuple, now.collect()))
        if name == "near_dedup":
            texts = [r["text"] for r in out.collect() if r["text"] is not None]
            assert len(texts) == len(set(texts))
        if name == "substring_dedup":
            assert out.count() == now.count()
            seen = Counter()
            for r in now.collect():
                w = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
                seen.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
            again = {k for k, n in seen.items() if n > 1}
            for r in out.collect():
                w = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
                assert r["text"] is None or r["n_chars"] == len(r["text"])
                assert not any(tuple(w[i : i + 35]) in again for i in range(len(w) - 34))
        now, before = out, now
    assert now.count() == before.count() and "ids" in now.columns


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 0 and out.where("n_tokens * 4 <> octet_length(ids)").count() == 0


def test_empty(spark, empty, folder):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0


def test_further_columns(spark, docs, folder):
    """Columns that documents does not have pass all stages but the last, whatever their names."""
    more = {"score": "s", "predicted": "p", "key": "k", "once": "o", "n_words": "n", "_own": "w", "rate": "r", "copies": "c", "a b.c": "d"}
    now = docs
    for name, value in more.items():
        now = now.withColumn(name, F.lit(value))
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.stored(stage(spark, now, folder), name)
        assert now.columns == columns
    rows = now.collect()
    assert rows and all(r[n] == v for r in rows for n, v in more.items())


def plain_pipeline(spark, rows, folder):
    """(doc_id, lang, source, ids) of the whole pipeline on a list of rows, by the plain versions of the operators' own tests."""
    from tokenizers import Tokenizer

    from blockwright.llm import bpe, mixing, toxicity

    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model = toxicity.learn(documents, spark.read.parquet(f"{folder}/labels.parquet"))
    rows = [r for r in rows if plain_score(r[1], model["lexicon"], model["fit"]) < toxicity.THRESHOLD]
    # Near duplicates: the least id of a group stays, of its texts the one that a hash of the text puts first; null texts all stay.
    keys = {r["text"]: r["key"] for r in documents.select("text", F.xxhash64("text").alias("key")).collect()}
    group = near_groups(rows)
    best = {}
    for i, t, *_ in rows:
        if t is not None:
            best[group[t]] = min(best.get(group[t], (True, 0, 0, "")), (i is None, i or 0, keys[t], t))
    seen, kept = set(), []
    for r in rows:
        if r[1] is None:
            kept.append(r)
        elif best[group[r[1]]][3] == r[1] and best[group[r[1]]][:2] == (r[0] is None, r[0] or 0) and (r[0], r[1]) not in seen:
            seen.add((r[0], r[1]))
            kept.append(r)
    # Repeated windows of 35 words.
    words = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in kept]
    count = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    cut = []
    for r, w in zip(kept, words, strict=True):
        gone = {j for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        spans = [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", r[1] or "")] + [len(r[1] or "")]
        text = r[1] if r[1] is None or not gone else r[1][: spans[0]] + "".join(r[1][spans[k] : spans[k + 1]] for k in range(len(w)) if k not in gone)
        cut.append((r[0], text, r[2], r[3]))
    # The mix.
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, _, s in cut:
        sizes[s] += size(t)
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    target = water_filling(sizes, {s: i % 3 + 1 for i, s in enumerate(order)})
    coder, out = Tokenizer.from_file(bpe.default_path()), Counter()
    for i, t, lang, s in cut:
        rate = target[s] / sizes[s] if sizes[s] else 0.0
        key = "|".join([mixing.SEED, "" if i is None else str(i), hashlib.md5((t or "").encode()).hexdigest()])
        draw = int(hashlib.md5(key.encode()).hexdigest()[:13], 16) / (1 << 52)
        ids = coder.encode(t or "", add_special_tokens=False).ids
        for _ in range(int(rate) + (draw < rate - int(rate))):
            out[i, lang, s, tuple(ids)] += 1
    return out


def test_brute_force(spark, rows, folder):
    out = corpus_pipeline.run(spark, folder).collect()
    got = Counter((r["doc_id"], r["lang"], r["source"], tuple(np.frombuffer(bytes(r["ids"]), "<u4").tolist())) for r in out)
    assert got == plain_pipeline(spark, rows, folder)
