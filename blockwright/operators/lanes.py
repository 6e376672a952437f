"""Lanes: a numeric column cut into blocks by a dense key, and the sequence operators over it.

A lane is long: (block_id, pos, v). ``block_id = key div size`` needs no global sort, so windows are partitioned by block
and a block is the unit of parallelism. A null value is carried as null and breaks the difference at its place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockwright.functions.scalars import ring_delta


def by_block():
    return Window.partitionBy("block_id").orderBy("pos")


def so_far():
    return by_block().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def whole():
    return Window.partitionBy("block_id")


def lane(table: DataFrame, key: str, value: str, size: int) -> DataFrame:
    at = F.col(key)
    return table.select(F.floor(at / size).alias("block_id"), (at % size).cast("long").alias("pos"), F.expr(value).alias("v"))


def micros(column: str) -> str:
    """A timestamp without time zone as microseconds since 1970."""
    return f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {column})"


def delta(rows: DataFrame) -> DataFrame:
    """Adds d, the difference to the block's previous value (null at its first)."""
    return rows.withColumn("d", F.col("v") - F.lag("v").over(by_block()))


def delta_of_delta(rows: DataFrame) -> DataFrame:
    return delta(rows).withColumn("dd", F.col("d") - F.lag("d").over(by_block()))


def undelta(rows: DataFrame) -> DataFrame:
    """Adds back, the values rebuilt from the first value and the differences d."""
    return rows.withColumn("back", F.sum(F.coalesce("d", "v")).over(so_far()))


def undelta_of_delta(rows: DataFrame) -> DataFrame:
    """Adds back, rebuilt from the first value, the first difference and the second differences dd."""
    first = rows.withColumn("d2", F.sum(F.coalesce("dd", "d", F.lit(0))).over(so_far()))
    return first.withColumn("back", F.sum(F.when(F.col("pos") == F.min("pos").over(whole()), F.col("v")).otherwise(F.col("d2"))).over(so_far())).drop("d2")


def frame_of_reference(rows: DataFrame) -> DataFrame:
    """Adds base and offset."""
    return rows.withColumn("base", F.min("v").over(whole())).withColumn("offset", F.col("v") - F.col("base"))


def ring_deltas(rows: DataFrame, bits: int) -> DataFrame:
    return delta(rows).withColumn("d", ring_delta(F.col("d"), bits))


def runs(rows: DataFrame) -> DataFrame:
    """One row per run of equal values: block_id, run, start, length, v."""
    new = F.when(F.col("v").eqNullSafe(F.lag("v").over(by_block())) & F.lag("pos").over(by_block()).isNotNull(), 0).otherwise(1)
    marked = rows.withColumn("new", new).withColumn("run", F.sum("new").over(so_far()))
    return marked.groupBy("block_id", "run").agg(F.min("pos").alias("start"), F.count("*").alias("length"), F.first("v").alias("v"))


def byte_lane(table: DataFrame, key: str, text: str) -> DataFrame:
    """A lane of the UTF-8 bytes of each row's text: the row is the block."""
    # As Latin-1 each byte is one character, so the bytes are split and read without searching for their places.
    letters = F.split(F.decode(F.encode(F.col(text), "UTF-8"), "ISO-8859-1"), "")
    some = table.where(F.octet_length(text) > 0).select(F.col(key).alias("block_id"), F.posexplode(letters).alias("pos", "c"))
    return some.select("block_id", F.col("pos").cast("long").alias("pos"), F.ascii("c").cast("long").alias("v"))


def byte_blocks(table: DataFrame, key: str, text: str | None = None, data: str | None = None) -> DataFrame:
    """(block_id, latin, codes): each row's bytes as a Latin-1 string and as an array; rows without bytes are left out.

    For statistics that need neighbours only: an array keeps the order, so nothing is sorted or shuffled.
    """
    raw = F.encode(F.col(text), "UTF-8") if text else F.col(data)
    rows = table.where(F.octet_length(text or data) > 0).select(F.col(key).alias("block_id"), F.decode(raw, "ISO-8859-1").alias("latin"))
    return rows.withColumn("codes", F.transform(F.split("latin", ""), lambda c: F.ascii(c)))


def byte_delta(rows: DataFrame) -> DataFrame:
    """Adds d, the byte difference mod 256, the first byte against 0."""
    return rows.withColumn("d", F.pmod(F.col("v") - F.coalesce(F.lag("v").over(by_block()), F.lit(0)), F.lit(256)))


def byte_undelta(rows: DataFrame) -> DataFrame:
    return rows.withColumn("back", F.pmod(F.sum("d").over(so_far()), F.lit(256)))


def sample_windows(rows: DataFrame, length: int = 64) -> DataFrame:
    """Keeps the values of the four sample windows (0, n/3, 2n/3, n - 64) and numbers merged windows, in ``window``."""
    n = F.count("*").over(whole())
    w = rows.withColumn("n", n).withColumn("wl", F.least(F.lit(length), F.col("n")))
    last = F.col("n") - F.col("wl")
    starts = [F.least(s.cast("long"), last) for s in (F.lit(0), F.floor(F.col("n") / 3), F.floor(2 * F.col("n") / 3), last)]
    inside = [(F.col("pos") >= s) & (F.col("pos") < s + F.col("wl")) for s in starts]
    kept = w.where(inside[0] | inside[1] | inside[2] | inside[3]).drop("wl")
    gap = F.when(F.col("pos") - F.lag("pos").over(by_block()) == 1, 0).otherwise(1)
    return kept.withColumn("gap", gap).withColumn("window", F.sum("gap").over(so_far())).drop("gap")
