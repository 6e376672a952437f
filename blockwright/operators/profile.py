"""Profiles of blocks: histograms, entropy, runs, repetition, and the numeric, run and float profiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockwright.functions import measure
from blockwright.functions.scalars import bit_width, zigzag
from blockwright.operators import lanes
from blockwright.operators.lanes import by_block
from blockwright.sources import small_batches


def _share(condition: Column) -> Column:
    """Share of the rows where the condition is known in which it holds."""
    return F.avg(F.when(condition, 1.0).when(~condition, 0.0))


def histogram(rows: DataFrame, value: str = "v") -> DataFrame:
    return rows.groupBy("block_id", F.col(value).alias("value")).agg(F.count("*").alias("n"))


def entropy(counts: DataFrame, name: str) -> DataFrame:
    """Order-0 entropy in bits of a histogram, rounded to six digits; sums go through sorted values of few counts."""
    p = F.col("n") / F.sum("n").over(Window.partitionBy("block_id"))
    return counts.withColumn("p", p).groupBy("block_id").agg(F.round(F.sum(-F.col("p") * F.log2("p")), 6).alias(name))


def sampled_entropy_h1(blocks: DataFrame, stride: int = 8) -> DataFrame:
    """Entropy of a byte given the one before it, over every ``stride``-th transition of each block of (block_id, data binary), in
    one pass over its bytes and without a shuffle; blocks of less than two bytes have none."""

    def run(batches):
        for b in batches:
            made = [measure.entropy_after(np.frombuffer(x.as_buffer(), np.uint8), stride) for x in b.column("data")]
            yield pa.RecordBatch.from_arrays([b.column("block_id"), pa.array(made, pa.float64())], names=["block_id", "h1"])

    some = small_batches(blocks.where(F.octet_length("data") > 1).select("block_id", "data"))
    return some.mapInArrow(run, f"block_id {some.schema['block_id'].dataType.simpleString()}, h1 double")


def run_stats(rows: DataFrame, least: int = 4) -> DataFrame:
    """Runs of ``least`` equal bytes or more: how many, their bytes, the longest of any length."""
    r = lanes.runs(rows)
    long = F.col("length") >= least
    return r.groupBy("block_id").agg(F.count_if(long).alias("runs"), F.sum(F.when(long, F.col("length")).otherwise(0)).alias("run_bytes"), F.max("length").alias("longest"))


def repetition_hits(blocks: DataFrame) -> DataFrame:
    """Four-byte prints at every 16th place that equal the print last seen in their slot of 4096: probes and hits.

    The slot table only ever holds a slot's previous print, so a lag over (block, slot) is exact, collisions included.
    ``blocks`` as of ``byte_blocks``; one row in 16 bytes is windowed.
    """
    at = F.when(F.size("codes") >= 4, F.sequence(F.lit(0), F.size("codes") - 4, F.lit(16))).otherwise(F.array().cast("array<int>"))
    code = lambda i: F.get("codes", i).cast("long")
    word = F.transform(at, lambda i: code(i) + code(i + 1) * 256 + code(i + 2) * 65536 + code(i + 3) * 16777216)
    prints = blocks.select("block_id", F.posexplode(word).alias("pos", "word"))
    # The multiplier is a fixed value; the product is split so that it stays inside 63 bits.
    low, high = F.col("word") % 65536, F.floor(F.col("word") / 65536)
    product = F.pmod(low * 2654435761 + F.pmod(high * 2654435761, F.lit(65536)) * 65536, F.lit(1 << 32))
    prints = prints.withColumn("slot", F.floor(product / (1 << 20)) % 4096)
    same = F.lag("word").over(Window.partitionBy("block_id", "slot").orderBy("pos")) == F.col("word")
    return prints.withColumn("hit", F.coalesce(same, F.lit(False))).groupBy("block_id").agg(F.count("*").alias("probes"), F.count_if("hit").alias("hits"))


def byte_runs(blocks: DataFrame) -> DataFrame:
    """Runs of 4 equal bytes or more (how many, their bytes), and the longest run of any length, by pattern."""
    runs = F.transform(F.regexp_extract_all("latin", F.lit(r"(?s)(.)\1{3,}+"), F.lit(0)), lambda r: F.length(r))
    short = F.when(F.col("latin").rlike(r"(?s)(.)\1\1"), 3).when(F.col("latin").rlike(r"(?s)(.)\1"), 2).otherwise(1)
    r = blocks.select("block_id", runs.alias("r"), short.alias("short"))
    return r.select("block_id", F.size("r").cast("long").alias("runs"), F.aggregate("r", F.lit(0).cast("long"), lambda a, x: a + x).alias("run_bytes"), F.coalesce(F.array_max("r"), "short").cast("long").alias("longest"))


PROFILE = (
    "size long, h0 double, h1 double, zero_ratio double, unique_bytes long, runs long, longest long, run_score double, delta_score double, repetition double, match_length double, incompressibility double"
)


def _profiled(level: str):
    names = [c.split()[0] for c in PROFILE.split(", ")]

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                made = [measure.block_profile(x.as_buffer().to_pybytes(), level) for x in part.column("data")]
                columns = [pa.array([m[n] for m in made], pa.float64() if k.endswith("double") else pa.int64()) for n, k in zip(names, PROFILE.split(", "), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("block_id"), *columns], names=["block_id", *names])

    return run


def block_profile(blocks: DataFrame, level: str = "balanced") -> DataFrame:
    """The profile of each block of (block_id, data binary), in one pass over its bytes and without a shuffle: size,
    entropies, zero and unique bytes, runs, delta score, repetition, mean match length, incompressibility. Blocks without
    bytes have none."""
    some = small_batches(blocks.where(F.octet_length("data") > 0).select("block_id", "data"))
    return some.mapInArrow(_profiled(level), f"block_id {some.schema['block_id'].dataType.simpleString()}, {PROFILE}")


def _prefilter_terms(rows: DataFrame, sample: int, small_bits: int) -> DataFrame:
    d = lanes.delta_of_delta(rows.where(F.col("pos") < sample)).withColumn("prev_d", F.lag("d").over(by_block()))
    return d.groupBy("block_id").agg(
        F.count("*").alias("n"), _share(F.col("d") >= 0).alias("monotonic"), _share(F.col("d") != 0).alias("nonzero"),
        _share(bit_width(zigzag(F.col("d"))) <= small_bits).alias("small"), F.coalesce(_share(F.col("d") == F.col("prev_d")), F.lit(0.0)).alias("constant"),
        F.min("d").alias("min_d"), F.max("d").alias("max_d"),
    )


def numeric_prefilter(rows: DataFrame, sample: int = 1024, small_bits: int = 20) -> DataFrame:
    """Ratios over the first ``sample`` values of a block, their confidence, and the verdicts likely and strong."""
    t = _prefilter_terms(rows, sample, small_bits).where("n >= 2")
    c = 0.10 + 0.30 * F.col("monotonic") + 0.25 * F.col("small") + 0.30 * F.col("constant") + 0.20 * F.col("nonzero")
    t = t.withColumn("confidence", F.round(F.least(c, F.lit(1.0)), 6))
    likely = (F.col("confidence") >= 0.72) & (F.col("monotonic") >= 0.8) & (F.col("nonzero") >= 0.1) & (F.col("small") >= 0.8)
    strong = (F.col("confidence") >= 0.995) & (F.least("monotonic", "nonzero", "small", "constant") >= 0.999)
    r = {k: F.round(k, 6).alias(k) for k in ("monotonic", "nonzero", "small", "constant")}
    return t.select("block_id", "confidence", *r.values(), likely.alias("likely"), strong.alias("strong"))


def fixed_step(rows: DataFrame) -> DataFrame:
    """Blocks of 16 values or more whose every difference is one positive step: first value, step, count."""
    d = lanes.delta(rows).groupBy("block_id").agg(F.min_by("v", "pos").alias("first_value"), F.min("d").alias("step"), F.max("d").alias("top"), F.count("*").alias("n"))
    return d.where("n >= 16 and step = top and step > 0").drop("top")


def width_histogram(rows: DataFrame, of: str) -> DataFrame:
    """Counts of the zigzag bit widths of the column ``of``."""
    return rows.where(F.col(of).isNotNull()).groupBy("block_id", bit_width(zigzag(F.col(of))).alias("width")).agg(F.count("*").alias("n"))


def percentile_width(widths: DataFrame, percent: int, name: str) -> DataFrame:
    """The least width whose cumulative count reaches the nearest rank."""
    up = Window.partitionBy("block_id").orderBy("width").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = F.sum("n").over(Window.partitionBy("block_id"))
    target = F.floor((whole - 1) * percent / 100) + 1
    return widths.withColumn("reached", F.sum("n").over(up) >= target).where("reached").groupBy("block_id").agg(F.min("width").alias(name))


def numeric_profile(rows: DataFrame, sample: int = 4096) -> DataFrame:
    """Delta and delta-of-delta statistics over the first ``sample`` values, read as a 64-bit lane."""
    d = lanes.delta_of_delta(rows.where(F.col("pos") < sample))
    wide = lambda c: bit_width(zigzag(F.col(c)))
    base = d.groupBy("block_id").agg(
        F.count("*").alias("n"), _share(F.col("d") >= 0).alias("monotonic"), _share(F.col("d") == 0).alias("delta_zero"), _share(wide("d") <= 8).alias("delta_small"),
        _share(F.col("dd") == 0).alias("dod_zero"), _share(wide("dd") <= 8).alias("dod_small"),
    ).where("n >= 16")
    dw = width_histogram(d, "d")
    p95 = percentile_width(dw, 95, "delta_p95")
    over = dw.join(p95, "block_id").groupBy("block_id").agg((F.sum(F.when(F.col("width") > F.col("delta_p95"), F.col("n")).otherwise(0)) / F.sum("n")).alias("exceptions"))
    out = base.join(p95, "block_id").join(percentile_width(width_histogram(d, "dd"), 95, "dod_p95"), "block_id").join(over, "block_id")
    bonus = F.when(F.col("delta_p95") <= 20, 0.25).when(F.col("delta_p95") <= 32, 0.10).otherwise(0.0)
    c = 0.15 + 0.30 * F.col("monotonic") + 0.25 * F.col("delta_small") + 0.20 * F.col("dod_small") + bonus
    out = out.withColumn("confidence", F.round(F.least(c, F.lit(1.0)), 6))
    six = [F.round(k, 6).alias(k) for k in ("monotonic", "delta_zero", "delta_small", "dod_zero", "dod_small", "exceptions")]
    return out.select("block_id", "n", "confidence", *six, "delta_p95", "dod_p95")


def _of_lanes(rows: DataFrame, measured, schema: str) -> DataFrame:
    """One row a block, from its values in order: ``measured`` gives a dict, or None for a block without a row."""

    def run(t: pa.Table) -> pa.Table:
        found = measured(t.sort_by("pos").column("v").to_numpy())
        names = [c.split()[0] for c in schema.split(", ")]
        rows = [{"block_id": t.column("block_id")[0].as_py(), **found}] if found else []
        return pa.table({n: pa.array([r[n] for r in rows], _KINDS[c.split()[1]]) for n, c in zip(names, schema.split(", "), strict=True)})

    return rows.groupBy("block_id").applyInArrow(run, schema)


_KINDS = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "int": pa.int32()}


def run_profile(rows: DataFrame) -> DataFrame:
    """Shares of equal, nearly equal (255 at most, the shorter way round) and one-byte values in the sample windows of a
    64-bit lane, and whether run coding is admitted; blocks of 64 values and more."""

    def measured(v):
        p = measure.run_profile(v.astype("<i8").tobytes(), 8)
        return p and {"n": p["n"], **{k: round(p[k], 6) for k in ("equal", "small", "splat")}, "admitted": p["admitted"]}

    return _of_lanes(rows, measured, "block_id long, n long, equal double, small double, splat double, admitted boolean")


def float_profile(rows: DataFrame) -> DataFrame:
    """Float statistics over the sample windows of a double lane, from the values' bits, and the first rule it fails."""

    def measured(v):
        p = measure.float_profile(v.astype("<f8").view("<u8"), 8)
        six = {k: round(getattr(p, k), 6) for k in ("non_finite", "zero", "subnormal", "implausible", "xor_zero", "xor_bits", "sign_changes")}
        return {"n": p.n, **six, "exponents": p.exponents, "verdict": p.verdict}

    schema = "block_id long, n long, non_finite double, zero double, subnormal double, implausible double, xor_zero double, xor_bits double, sign_changes double, exponents long, verdict string"
    return _of_lanes(rows, measured, schema)
