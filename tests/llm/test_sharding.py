import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from blockwright.llm import sharding


@pytest.mark.parametrize("shards", [8, 3, 1])
def test_law(docs, rows, shards):
    out = sharding.sharded(docs, shards).collect()
    assert len(out) == len(rows)
    size = lambda t: len((t or "").encode()) + 1
    assert sorted((r["size"], r["text_crc32"]) for r in out) == sorted((size(t), zlib.crc32((t or "").encode())) for _, t, *_ in rows)
    by, slots = defaultdict(int), defaultdict(list)
    for r in out:
        by[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    largest = max(size(t) for _, t, *_ in rows)
    assert all(abs(by[s] - sum(by.values()) / shards) <= largest + 1 for s in range(shards))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_small_groups_stay_whole(spark):
    many = spark.range(20000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") / 4).cast("int").cast("string")).alias("text"))
    out = sharding.sharded(many)
    assert out.groupBy("text_crc32", "size").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0
    sizes = [r["b"] for r in out.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 8 and max(sizes) < 1.02 * min(sizes)


def test_hot_group_is_cut(spark):
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1500, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    sizes = [r["b"] for r in sharding.sharded(many).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert max(sizes) < 1.03 * min(sizes)


def test_brute_force(docs, rows):
    """Shards, slots and moved cuts against a plain walk over the same order; nulls, repeated rows and a long text among them."""
    order = sharding.placed(docs).orderBy("rows_before").collect()
    total, shards = sum(r["size"] for r in order), 8
    assert [r["bytes_before"] for r in order] == [sum(x["size"] for x in order[:i]) for i in range(len(order))]
    assert [r["text_hash"] is None for r in order] == sorted((r["text_hash"] is None for r in order), reverse=True)
    cuts = []
    for k in range(1, shards):
        c = -(-total * k // shards)
        at = max(i for i, r in enumerate(order) if r["bytes_before"] <= c)
        if order[at]["bytes_before"] + order[at]["size"] > c:
            group = [r for r in order if r["text_hash"] == order[at]["text_hash"]]
            a, b = group[0]["bytes_before"], group[-1]["bytes_before"] + group[-1]["size"]
            if min(c - a, b - c) <= max(sharding.GROUP_SHARE * total / shards, min(2 * group[0]["size"], sharding.ROWS_SHARE * total / shards)):
                c = a if c - a <= b - c else b
        cuts.append(c)
    want = Counter()
    slots = Counter()
    for r in order:
        shard = sum(r["bytes_before"] >= c for c in cuts)
        want[r["doc_id"], r["size"], r["text_crc32"], shard, slots[shard]] += 1
        slots[shard] += 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in sharding.sharded(docs, shards).collect()) == want


def test_pairs_stay_whole_in_small_tables(spark):
    few = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("some text "), (F.col("id") / 2).cast("int").cast("string")).alias("text"))
    out = sharding.sharded(few)
    assert out.groupBy("text_crc32", "size").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0


def test_edges(empty, docs):
    assert sharding.sharded(empty).count() == 0
    assert sharding.sharded(docs.withColumn("part", F.lit("x")).withColumn("size", F.lit("y"))).count() == docs.count()
