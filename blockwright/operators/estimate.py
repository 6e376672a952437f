"""Exact sizes of reversible layouts, without encoding anything."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockwright.functions.scalars import bit_width, gamma_bits, packed_bytes, zigzag
from blockwright.operators import lanes

#: Bytes of the payload headers; fixed values of the format.
NUMERIC_HEADER, SERIES_HEADER = 40, 28


def every_mode(rows: DataFrame) -> DataFrame:
    """One row per block and mode (1 FOR, 2 delta, 3 delta of delta): n, width, bytes."""
    d = lanes.delta_of_delta(rows)
    s = d.groupBy("block_id").agg(
        F.count("*").alias("n"), bit_width(F.max("v") - F.min("v")).alias("w1"), bit_width(F.coalesce(F.max(zigzag(F.col("d"))), F.lit(0))).alias("w2"),
        bit_width(F.coalesce(F.max(zigzag(F.col("dd"))), F.lit(0))).alias("w3"),
    )
    modes = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.greatest(F.col("n") - (m - 1), F.lit(0)).alias("stream"), F.col(f"w{m}").alias("width")) for m in (1, 2, 3)]))
    out = s.select("block_id", "n", modes.alias("m")).select("block_id", "n", "m.*")
    return out.withColumn("bytes", F.lit(NUMERIC_HEADER) + packed_bytes(F.col("stream"), F.col("width"))).drop("stream")


def best_mode(rows: DataFrame) -> DataFrame:
    """Per block the mode of fewest bytes, the lower mode on a tie."""
    best = every_mode(rows).groupBy("block_id").agg(F.min(F.struct("bytes", "mode", "width", "n")).alias("b"))
    return best.select("block_id", "b.n", "b.mode", "b.width", "b.bytes")


def patched(rows: DataFrame) -> DataFrame:
    """Per block the patched frame of reference of fewest bytes: bits kept in place, exceptions, bytes.

    A width histogram gives the number of exceptions of every width by a reverse running sum, so the search reads each
    value once.
    """
    off = lanes.frame_of_reference(rows).withColumn("w", bit_width(F.col("offset")))
    hist = off.groupBy("block_id", "w").agg(F.count("*").alias("c"))
    tops = hist.groupBy("block_id").agg(F.sum("c").alias("n"), F.max("w").alias("top"))
    grid = tops.select("block_id", "n", "top", F.explode(F.sequence(F.lit(0), F.col("top").cast("int"))).alias("bits"))
    full = grid.join(hist.select("block_id", F.col("w").cast("int").alias("bits"), "c"), ["block_id", "bits"], "left")
    above = Window.partitionBy("block_id").orderBy(F.col("bits").desc()).rowsBetween(Window.unboundedPreceding, -1)
    full = full.withColumn("exceptions", F.coalesce(F.sum("c").over(above), F.lit(0)))
    place = bit_width(F.col("n") - 1)
    size = F.lit(NUMERIC_HEADER + 1) + packed_bytes(F.col("n"), F.col("bits")) + packed_bytes(F.col("exceptions"), place) + packed_bytes(F.col("exceptions"), F.col("top") - F.col("bits"))
    best = full.withColumn("bytes", size).groupBy("block_id").agg(F.min(F.struct("bytes", "bits", "exceptions", "n")).alias("b"))
    return best.select("block_id", "b.n", F.col("b.bits").cast("long").alias("bits"), "b.exceptions", "b.bytes")


def run_delta_bytes(rows: DataFrame) -> DataFrame:
    """The exact size of run/delta coding: per change gamma(run before it) and gamma(zigzag change), then a terminator."""
    r = lanes.runs(rows)
    along = Window.partitionBy("block_id").orderBy("run")
    r = r.withColumn("next", F.lead("v").over(along))
    bits = gamma_bits(F.col("length")) + F.when(F.col("next").isNull(), F.lit(1)).otherwise(gamma_bits(zigzag(F.col("next") - F.col("v"))))
    return r.groupBy("block_id").agg(F.count("*").alias("runs"), F.sum("length").alias("n"), (F.lit(SERIES_HEADER) + F.ceil(F.sum(bits) / F.lit(8))).cast("long").alias("bytes"))


def rle_bytes(rows: DataFrame) -> DataFrame:
    """The exact size of byte run-length packets: runs are cut at 128, a piece of 4 or more costs 2 bytes, and shorter
    ones join the literals around them, which cost a byte each and one more per 128."""
    r = lanes.runs(rows)
    rest = F.col("length") % 128
    r = r.withColumn("packets", F.floor(F.col("length") / 128) + F.when(rest >= 4, 1).otherwise(0)).withColumn("literals", F.when(rest < 4, rest).otherwise(0))
    r = r.withColumn("group", F.sum("packets").over(Window.partitionBy("block_id").orderBy("run").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    g = r.groupBy("block_id", "group").agg(F.sum("packets").alias("p"), F.sum("literals").alias("l"))
    return g.groupBy("block_id").agg(F.sum(2 * F.col("p") + F.col("l") + F.ceil(F.col("l") / 128)).cast("long").alias("bytes"))


def huffman_bound(rows: DataFrame) -> DataFrame:
    """Bytes that no order-0 code can undercut: the entropy of the bytes, and their number."""
    h = rows.groupBy("block_id", "v").agg(F.count("*").alias("n")).withColumn("all", F.sum("n").over(Window.partitionBy("block_id")))
    return h.groupBy("block_id").agg(F.sum("n").alias("size"), F.ceil(F.round(F.sum(-F.col("n") * F.log2(F.col("n") / F.col("all"))), 4) / 8).cast("long").alias("least_bytes"))


def alp_parameters(rows: DataFrame) -> DataFrame:
    """Per block of doubles the exponents (e, f) that its sample (four windows of 16 values) codes in the fewest bits, the
    lower ones on a tie, and how many values of the whole block do not come back from them, with the exact bytes."""
    import pyarrow as pa

    from blockwright.functions import fixed

    def run(t: pa.Table) -> pa.Table:
        data = t.sort_by("pos").column("v").to_numpy().astype("<f8")
        v = data.view("<u8")
        e, f = fixed.alp_exponents(v, 8)
        lost = int((~fixed.digits(v, 8, e, f)[1]).sum())
        return pa.table({"block_id": [t.column("block_id")[0].as_py()], "n": [len(v)], "e": pa.array([e], pa.int32()), "f": pa.array([f], pa.int32()), "exceptions": [lost], "bytes": [fixed.alp_size(data.tobytes(), 8)]})

    return rows.groupBy("block_id").applyInArrow(run, "block_id long, n long, e int, f int, exceptions long, bytes long")


def columnar_gain(table: DataFrame, key: str, columns: list[str], size: int) -> DataFrame:
    """Bytes of each column of a record table as its own lane, against fixed eight-byte fields: block_id, column, bytes, raw."""
    parts = [best_mode(lanes.lane(table, key, c, size)).select("block_id", F.lit(c).alias("column"), "bytes", (F.col("n") * 8).alias("raw")) for c in columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


