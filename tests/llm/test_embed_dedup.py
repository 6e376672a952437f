import math
import random

import pytest

from blockwright.llm import embed_dedup

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors():
    rng = random.Random(4)
    g = lambda n: [rng.gauss(0, 1) for _ in range(n)]
    out = [(i, g(16), i % 2) for i in range(80)]
    for k in range(6):  # near copies of one vector, near the limit, in both labels
        base = g(16)
        for j in range(14):
            out.append((100 + 20 * k + j, [x + 0.09 * rng.gauss(0, 1) for x in base], j % 2 if k else 0))
    out += [(300 + i, out[0][1], 0) for i in range(5)] + [(310, out[0][1], None), (311, None, 0), (312, [0.0] * 16, 0), (313, [float("nan")] + [1.0] * 15, 0), (314, [float("inf")] + [1.0] * 15, 0)]
    out += [(315, [None] + [1.0] * 15, 0), (316, [1.0, 2.0], 0), (317, [2.0, 4.0], 0), (318, [], 0), (400, [2.0, 4.0], 0), (401, [1e30] * 16, 0), (402, [1e30] * 16, 0)]
    return [(i, None if v is None else [None if x is None else struct_float(x) for x in v], l) for i, v, l in out]


def struct_float(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


def plain(rows):
    ok = lambda v: v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    norm = {i: math.sqrt(sum(x * x for x in v)) for i, v, _ in rows if ok(v)}
    links, parent = {i: 0 for i, *_ in rows}, {i: i for i, *_ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, v, l in rows:
        for j, w, m in rows:
            if i < j and l == m is not None and ok(v) and ok(w) and len(v) == len(w) and sum(a * b for a, b in zip(v, w)) / norm[i] / norm[j] >= 0.98:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (links[i], find(i), find(i) == i) for i, *_ in rows}


@pytest.mark.parametrize("side", [256, 4])
def test_brute_force(spark, side, monkeypatch):
    monkeypatch.setattr(embed_dedup, "SIDE", side)
    monkeypatch.setattr(embed_dedup, "BLOCK", 64)
    monkeypatch.setattr(embed_dedup, "WINDOW", 8)
    rows = vectors()
    out = embed_dedup.vector_groups(spark.createDataFrame(rows, SCHEMA).repartition(3), window=8)
    assert {r["vec_id"]: tuple(r)[1:] for r in out.collect()} == plain(rows)


def test_edges(spark):
    assert embed_dedup.vector_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, [1.0, 0.0], 3), (1, [1.0, 0.0], 3), (None, [1.0, 0.0], 3), (None, None, None)]
    out = embed_dedup.vector_groups(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as key", "1 as n")).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0) for r in out) == [(0, 0, 0), (0, 2, 1), (1, 2, 1), (1, 2, 1)]


def test_rounds_until_nothing_joins(spark):
    """One label whose vectors share a direction, few passes and narrow windows: every planted pair is found."""
    rng = random.Random(8)
    g = lambda n: [rng.gauss(0, 1) for _ in range(n)]
    mean = [2 * x for x in g(32)]
    rows = [(i, [a + b for a, b in zip(mean, g(32))], 1) for i in range(3000)]
    rows += [(5000 + i, [x + 0.2 * rng.gauss(0, 1) for x in rows[i][1]], 1) for i in range(150)]
    out = embed_dedup.vector_groups(spark.createDataFrame(rows, SCHEMA), passes=3, window=6)
    got = {r["vec_id"]: r["component_id"] for r in out.collect()}
    unit = lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v]
    near = [i for i in range(150) if sum(a * b for a, b in zip(unit(rows[i][1]), unit(rows[3000 + i][1]))) >= 0.981]
    assert len(near) > 100 and all(got[5000 + i] == got[i] for i in near)
