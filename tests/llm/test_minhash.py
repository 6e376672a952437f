import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from blockwright.llm import _graph, minhash
from blockwright.llm._graph import components
from blockwright.llm._words import slices
from plain import similarity, weights


def plain(rows):
    """Least id of each group, by comparing all pairs of texts."""
    texts = sorted({t for _, t, *_ in rows if t is not None})
    sets, parent = [weights(t) for t in texts], list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and similarity(sets[i], sets[j]) >= 0.8 - 1e-12:
                parent[find(i)] = find(j)
    least = {}
    for i, t, *_ in rows:
        if t is not None and i is not None:
            g = find(texts.index(t))
            least[g] = min(least.get(g, i), i)
    return {t: least.get(find(k)) for k, t in enumerate(texts)}


def test_signature_estimates_probability_jaccard():
    rng = np.random.default_rng(3)
    h = rng.integers(1, 1 << 52, 60, dtype=np.uint64)
    x, y = rng.integers(1, 9, 40).astype(float), rng.integers(1, 9, 40).astype(float)
    doc = np.repeat([0, 1], 40)
    both = np.concatenate([h[:40], h[20:]])
    sig = minhash.signatures(doc, both, np.concatenate([x, y]), 2, 4096)
    a, b = np.argsort(h[:40]), np.argsort(h[20:])
    want = minhash.probability_jaccard(h[:40][a], x[a], h[20:][b], y[b])
    plainly = similarity(Counter(dict(zip(h[:40].tolist(), x, strict=True))), Counter(dict(zip(h[20:].tolist(), y, strict=True))))
    assert want == pytest.approx(plainly)
    assert (sig[0] == sig[1]).mean() == pytest.approx(want, abs=0.03)


def near_rows(hub=40):
    """A large group around one text, whose members are often too far from each other."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(120)]
    out = [(1000, " ".join(base))]
    for k in range(hub):
        t = list(base)
        for _ in range(rng.choice([1, 2, 3, 6])):
            t[rng.randrange(len(t))] = word()
        out.append((1001 + k, " ".join(t)))
    return out


def test_similar_matches_pairs():
    texts = [t for _, t in near_rows(25)] + ["a b c d e f g h i j " * 5, "a b c d e f g h i j " * 4, "", "one two"]
    for _, _, words in slices(pa.array(texts), 1 << 40):
        root = minhash.similar(words, 0.8)
    sets = [weights(t) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and similarity(sets[i], sets[j]) >= 0.8:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert root.tolist() == [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("chunk", [128, 6])
def test_brute_force(spark, rows, chunk, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK", chunk)
    rows = [r[:2] for r in rows] + near_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = minhash.near_deduped(docs).join(docs.select("doc_id", F.xxhash64("text").alias("k"), "text").distinct(), ["doc_id"]).where("key = k").collect()
    want = plain(rows)
    assert len(out) >= len({r for r in rows if r[0] is not None and r[1] is not None})
    for r in out:
        assert r["class_id"] == want[r["text"]], (r["doc_id"], r["text"][:40])
    kept = minhash.near_deduped(docs).where("kept and key is not null").select("doc_id", "class_id").distinct().collect()
    assert len(kept) == len(set(want.values()))


def test_edges(spark, empty, docs):
    assert minhash.near_deduped(empty).count() == 0
    out = minhash.near_deduped(docs.withColumn("key", F.lit("x")).withColumn("band", F.lit(0)))
    assert out.count() == docs.count() and out.where("key is null and not kept").count() == 0


@pytest.mark.parametrize("kind", ["random", "chain", "star"])
def test_components(spark, kind):
    rng = random.Random(3)
    edges = {"random": [(rng.randrange(200), rng.randrange(200)) for _ in range(130)], "chain": [(i, i + 1) for i in range(40)] + [(90, 90)], "star": [(7, i) for i in range(60)]}[kind]
    parent = {}

    def find(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    out = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in out} == {i: find(i) for i in parent} and len(out) == len(parent)


def forest(edges):
    parent = {}

    def find(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in parent}


def tangled(n=300):
    rng = random.Random(11)
    out = [(rng.randrange(-n, n), rng.randrange(-n, n)) for _ in range(n)]
    chain = rng.sample(range(1000, 1000 + n), n)
    return out + list(zip(chain, chain[1:], strict=False)) + [(5000, 5000), (-(1 << 63), (1 << 63) - 1)]


def test_united():
    edges = tangled()
    node, root = _graph.united(*np.array(edges, np.int64).T)
    assert dict(zip(node.tolist(), root.tolist(), strict=True)) == forest(edges)
    assert not len(_graph.united(*np.zeros((2, 0), np.int64))[0])


@pytest.mark.parametrize("small", [-1, 1 << 19])
def test_components_of_few_and_of_many_links(spark, small, monkeypatch):
    monkeypatch.setattr(_graph, "SMALL", small)
    for edges in (tangled(60), [(9, 9)], [(3, 1), (2, 1), (3, 2)]):
        out = components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()
        assert {r["node"]: r["root"] for r in out} == forest(edges) and len(out) == len(forest(edges))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_other_keys(spark):
    out = components(spark.createDataFrame([("b", "a"), ("c", "b"), ("z", "y")], "a string, b string")).collect()
    assert sorted(map(tuple, out)) == [("a", "a"), ("b", "a"), ("c", "a"), ("y", "y"), ("z", "y")]


def test_few_tables_are_written(spark, monkeypatch):
    """Every table costs a task and a file for each partition, however small it is."""
    written = []

    def counting(df, name, f=minhash.stored):
        written.append(name)
        return f(df, name)

    monkeypatch.setattr(minhash, "stored", counting)
    monkeypatch.setattr(_graph, "stored", counting)
    monkeypatch.setattr(minhash, "CHUNK", 6)
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = minhash.near_deduped(docs).collect()
    want = plain(rows)
    assert {r["doc_id"]: r["class_id"] for r in out} == {i: want[t] for i, t in rows}
    assert "links-2" in written and len(written) <= 12, written


def test_more_links_than_one_task_takes(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK", 6)
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    at_once = sorted(map(tuple, minhash.near_deduped(docs).collect()))
    monkeypatch.setattr(_graph, "SMALL", 3)
    assert sorted(map(tuple, minhash.near_deduped(docs).collect())) == at_once


def test_classes_of_one_row_and_null_ids(spark):
    rows = [(None, "a b c"), (3, "a b c"), (None, "x y"), (7, None), (None, None), (8, "z"), (8, "z"), (9, "")]
    out = minhash.near_deduped(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    found = Counter((r["doc_id"], r["class_id"], r["kept"]) for r in out)
    assert found == Counter([(None, 3, False), (3, 3, True), (None, None, True), (7, 7, True), (None, None, True), (8, 8, True), (8, 8, True), (9, 9, True)])
