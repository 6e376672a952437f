import math
import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from blockwright.llm import toxicity
from plain import plain_score


def made(n=900):
    rng = random.Random(2)
    words = ["".join(rng.choice("bcdfghlmnprstv") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) for _ in range(300)]
    bad = ["idiot", "zorgaba", "zorgabel", "zorgamu", "krappel"]
    docs, labels = [], []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(max(2, len(t) // 30)):
                t[rng.randrange(len(t))] = rng.choice(bad)
        docs.append((i, " ".join(t)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_folding():
    assert toxicity.folded("You 1D10T!").split() == ["you", "idiot"]
    assert toxicity.folded("іdіоt $tupid élève 2024 x_y").split() == ["idiot", "stupid", "eleve", "x", "y"]
    assert toxicity.folded("").strip() == "" and toxicity.folded("\ud800 ok").split() == ["ok"]


def test_exceptions():
    a = toxicity._automaton({" trash ": 4.0, " stup": 3.0})
    assert toxicity.found_weight("this is trash", a)[0] == 4.0
    assert toxicity.found_weight("put it in the trash can", a)[0] == 0.0
    assert toxicity.found_weight("Stupidity!", a) == (3.0, 1)


def test_held_out_accuracy(spark):
    docs, labels = made()
    d, l = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(d, l)
    out = {r["doc_id"]: r for r in toxicity.scored(d, model).collect()}
    held = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 4 == 2]
    y = dict(labels)
    assert len(held) > 100
    assert sum(out[i]["predicted"] == y[i] for i in held) / len(held) > 0.97
    # Labels of held-out rows are never used.
    flipped = spark.createDataFrame([(i, 1 - t if i in set(held) else t) for i, t in labels], "doc_id long, toxic int")
    assert toxicity.learn(d, flipped) == model


def test_edges(spark, docs, rows, empty):
    labels = spark.createDataFrame([(1, None), (None, 1), (99999, 1)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    assert model["fit"] == toxicity.DEFAULT_FIT
    out = toxicity.scored(docs.withColumn("score", F.lit("x")), model).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out) and {r["predicted"] for r in out} == {0}
    assert toxicity.scored(empty, model).count() == 0
    assert toxicity.learn(empty, labels)["fit"] == toxicity.DEFAULT_FIT


def test_brute_force(spark):
    """Counts, weights and scores against plain versions, a very long text among them."""
    docs, labels = made(300)
    docs += [(1000, None), (1001, ""), (1002, "you idiot " * 3000), (1003, "Zorgabel in the trash can, 1D10T trash"), (1003, "Zorgabel in the trash can, 1D10T trash")]
    d, l = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(d, l)
    y, text, seen, n = dict(labels), dict(docs), {0: Counter(), 1: Counter()}, Counter()
    for i, t in y.items():
        if zlib.crc32(str(i).encode()) % 4 != 2:
            words = set(toxicity.folded(text[i]).split())
            seen[t].update({f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in toxicity.STEMS if len(w) > k})
            n[t] += 1
    want = {f" {w} ": toxicity.SEED_WEIGHT for w in toxicity.SEED_WORDS}
    for e in set(seen[0]) | set(seen[1]):
        a, b = seen[1][e], seen[0][e]
        odds = math.log((a + 0.5) / (n[1] + 1)) - math.log((b + 0.5) / (n[0] + 1)) - toxicity.ERRORS * math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        if e in want or odds >= toxicity.LEAST_ODDS and a >= toxicity.LEAST_DOCS:
            want[e] = max(0.0, odds) ** 2 / 4
    want = {e: w for e, w in want.items() if w > 0}
    assert model["lexicon"].keys() == want.keys() and all(abs(model["lexicon"][e] - w) < 1e-9 for e, w in want.items())
    out = toxicity.scored(d, model).collect()
    assert len(out) == len(docs)
    for r in out:
        assert abs(r["score"] - plain_score(r["text"], want, model["fit"])) < 1e-9 and r["predicted"] == (r["score"] >= 0.3)


def test_no_entry_is_dropped(spark):
    """More entries than any fixed size: each word stands in enough toxic rows."""
    words = [f"zq{chr(97 + i // 676)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}" for i in range(5000)]
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2]
    docs = spark.createDataFrame([(i, " ".join(words) if k % 2 else "fine words only") for k, i in enumerate(ids)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, toxic int")
    lexicon = toxicity.learn(docs, labels)["lexicon"]
    assert all(f" {w} " in lexicon for w in words)


def test_column_names(spark):
    docs = spark.createDataFrame([(1, "x", "y")], "doc_id long, text string, `a b.c` string")
    assert toxicity.scored(docs, {"lexicon": {}, "fit": toxicity.DEFAULT_FIT}).columns == ["doc_id", "text", "a b.c", "score", "predicted"]
