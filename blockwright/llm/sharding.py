"""Contiguous shards of balanced byte size, from global prefix sums.

Rows are put in one global order (by text hash, then id, so that equal texts stand together), running sums are taken
inside each range partition, the partitions' totals (one row a partition) give every partition's offset, and the whole
is cut at equal shares of all bytes. Where a cut falls inside a group of equal texts it moves to the group's nearer end if
that is near: within 1 % of a shard, or within two rows of the group and a tenth of a shard, since a cut is no finer than a
row anyway. Elsewhere the group is cut, or sizes could not be near equal.

Defined cases: null text counts no bytes, so size 1, crc32 0; null ids come first within their text; repeated rows each
get a slot; an empty table gives an empty table; shards past the last row may be empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockwright.llm._store import stored, table

#: A cut moves to the nearer end of a group of equal texts if that is no further than this share of a shard, or than two
#: of the group's rows where those are no more than ROWS_SHARE of a shard.
GROUP_SHARE, ROWS_SHARE = 0.01, 0.1


def _running(batches):
    """Adds the partition's number and the sums over the partition's earlier rows."""
    part, so_far, row = TaskContext.get().partitionId(), 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        size = b.column("size").to_numpy(zero_copy_only=False)
        before = np.cumsum(size) - size + so_far
        extra = [pa.array(np.full(len(size), part, np.int32)), pa.array(before), pa.array(np.arange(row, row + len(size), dtype=np.int64))]
        so_far, row = int(before[-1] + size[-1]), row + len(size)
        yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*b.schema.names, "part", "local_bytes", "local_row"])


def placed(docs: DataFrame) -> DataFrame:
    """One narrow row per document: doc_id, size, text_crc32, text_hash, and its place in the global order (bytes, row).

    No row holds text after the scan, so the sort moves about 40 bytes a document. The partition's number and local
    sums are written with the rows: a lost executor cannot deal the ranges out anew between the passes.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64("text").alias("text_hash"),
        F.monotonically_increasing_id().alias("_tie"),
    )
    order = ["text_hash", "doc_id", "_tie"]
    ranged = narrow.repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie")
    schema = ranged.schema.simpleString()[len("struct<"):-1] + ",part:int,local_bytes:bigint,local_row:bigint"
    local = stored(ranged.mapInArrow(_running, schema), "shard-order")
    parts = local.groupBy("part").agg(F.max(F.col("local_bytes") + F.col("size")).alias("b"), F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    parts = parts.select("part", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    parts = stored(parts, "shard-parts")
    return local.join(F.broadcast(parts), "part").select(  # bounded: one row per partition
        "doc_id", "size", "text_crc32", "text_hash", (F.col("b0") + F.col("local_bytes")).alias("bytes_before"), (F.col("n0") + F.col("local_row")).alias("rows_before")
    )


def _cuts(order: DataFrame, shards: int, group_share: float) -> list[int]:
    """The byte offsets at which shards 1, 2, ... begin; ``shards`` values reach the driver."""
    total = order.agg(F.max(F.col("bytes_before") + F.col("size"))).first()[0] or 0
    cuts = [-(-total * k // shards) for k in range(1, shards)]
    if not total:
        return cuts
    inside = F.array(*[F.when((F.col("bytes_before") < c) & (F.col("bytes_before") + F.col("size") > c), F.lit(c)) for c in cuts])
    crossing = order.withColumn("cut", F.explode(F.array_compact(inside))).select("cut", "text_hash").distinct()
    # A cut on a row's edge needs no move of the row, but may stand between two equal texts.
    edge = order.where(F.col("bytes_before").isin(cuts)).select(F.col("bytes_before").alias("cut"), "text_hash").distinct()
    crossing = crossing.unionByName(edge).distinct()
    spans = order.join(F.broadcast(crossing), "text_hash").groupBy("cut", "text_hash").agg(F.min("bytes_before").alias("a"), F.max(F.col("bytes_before") + F.col("size")).alias("b"), F.max("size").alias("row"))
    moved = {r["cut"]: (r["a"], r["b"], r["row"]) for r in spans.collect()}
    out = []
    for c in cuts:
        a, b, row = moved.get(c, (c, c, 0))
        near = max(group_share * total / shards, min(2 * row, ROWS_SHARE * total / shards))
        out.append((a if c - a <= b - c else b) if min(c - a, b - c) <= near else c)
    return out


def sharded(docs: DataFrame, shards: int = 8, group_share: float = GROUP_SHARE) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot (its place in the shard), grown_shard (null)."""
    order = placed(docs)
    cuts = _cuts(order, shards, group_share)
    shard = F.lit(0)
    for c in cuts:
        shard = shard + (F.col("bytes_before") >= F.lit(c)).cast("int")
    cut = order.withColumn("shard", shard)
    first = cut.groupBy("shard").agg(F.min("rows_before").alias("first_row"))  # a row per shard
    return cut.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("rows_before") - F.col("first_row")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_sharding(spark, sf_dir):
    return sharded(table(spark, sf_dir, "documents").select("doc_id", "text"))
