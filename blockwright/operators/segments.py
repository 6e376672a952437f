"""Segmentation of a lane into homogeneous regions, and even splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def alphabet_bucket(distinct: Column) -> Column:
    return F.when(distinct <= 1, 0).when(distinct <= 16, 1).when(distinct <= 64, 2).when(distinct <= 192, 3).otherwise(4)


def window_classes(rows: DataFrame, window: int) -> DataFrame:
    """(block_id, win, n, distinct, class): fixed windows of a lane; a trailing part joins the last whole window."""
    last = F.greatest(F.floor(F.max("pos").over(Window.partitionBy("block_id")) + 1) / window, F.lit(1.0)).cast("long") - 1
    w = rows.withColumn("win", F.least(F.floor(F.col("pos") / window), last))
    return w.groupBy("block_id", "win").agg(F.count("*").alias("n"), F.countDistinct("v").alias("distinct")).withColumn("class", alphabet_bucket(F.col("distinct")).cast("long"))


def segments(classes: DataFrame) -> DataFrame:
    """Maximal stretches of windows of one class: block_id, segment, class, first window, windows, values, offset in values."""
    w = Window.partitionBy("block_id").orderBy("win")
    marked = classes.withColumn("new", F.when(F.lag("class").over(w) == F.col("class"), 0).otherwise(1))
    marked = marked.withColumn("segment", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    s = marked.groupBy("block_id", "segment").agg(F.first("class").alias("class"), F.min("win").alias("first_win"), F.count("*").alias("windows"), F.sum("n").alias("n"))
    before = Window.partitionBy("block_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    return s.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))


def even_split(parts: DataFrame, most: int) -> DataFrame:
    """Pieces of at most ``most`` values, as even as can be: adds piece, piece_from, piece_to."""
    n = F.ceil(F.col("n") / most)
    p = parts.withColumn("pieces", n).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces").cast("long") - 1)))
    return p.withColumn("piece_from", F.floor(F.col("n") * F.col("piece") / F.col("pieces"))).withColumn("piece_to", F.floor(F.col("n") * (F.col("piece") + 1) / F.col("pieces")))


def merged_small(classes: DataFrame, least: int) -> DataFrame:
    """Segments of at least ``least`` values: the smallest (first on a tie) joins its larger neighbour (left on a tie) until none is smaller.

    The merge is sequential inside one block, whose windows are bounded, so blocks are merged in Arrow groups.
    """
    import pyarrow as pa

    def merge(t: pa.Table) -> pa.Table:
        rows = sorted(zip(t.column("segment").to_pylist(), t.column("class").to_pylist(), t.column("n").to_pylist(), strict=True))
        runs = [[c, n] for _, c, n in rows]
        while len(runs) > 1 and min(n for _, n in runs) < least:
            i = min(range(len(runs)), key=lambda k: (runs[k][1], k))
            left, right = runs[i - 1][1] if i else -1, runs[i + 1][1] if i + 1 < len(runs) else -1
            j = i - 1 if left >= right else i + 1
            runs[j][1] += runs[i][1]
            del runs[i]
            j -= j > i
            for k in (j, j - 1):  # neighbours of one class are one segment
                if 0 <= k and k + 1 < len(runs) and runs[k][0] == runs[k + 1][0]:
                    runs[k][1] += runs[k + 1][1]
                    del runs[k + 1]
        block = t.column("block_id")[0].as_py()
        return pa.table({"block_id": pa.array([block] * len(runs), pa.int64()), "segment": pa.array(range(1, len(runs) + 1), pa.int64()), "class": pa.array([c for c, _ in runs], pa.int64()), "n": pa.array([n for _, n in runs], pa.int64())})

    return segments(classes).select("block_id", "segment", "class", "n").groupBy("block_id").applyInArrow(merge, "block_id long, segment long, class long, n long")
