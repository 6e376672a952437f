"""Benchmark statistics: medians of batches, deviations, outliers, gates and repeatability."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Parts of a key's span of values; the median's part alone is looked at value by value.
PARTS = 4096


def medians(rows: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """The exact median of ``value`` by ``keys`` (one row for every key; null without values), for hot keys too.

    Values are counted by equal parts of their key's span, with map-side combining; only the parts that hold the middle
    ranks are then counted by value. So no task holds all values of a key, and nothing depends on how rows are dealt.
    """
    x = rows.select(F.struct(*keys).alias("_k"), F.col(value).cast("double").alias("_v"))
    span = x.groupBy("_k").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("_v").alias("_n"))
    x = x.where("_v is not null").join(span, "_k")
    part = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * PARTS), F.lit(PARTS - 1))).otherwise(F.lit(0))
    x = x.select("_k", "_n", part.cast("int").alias("_part"), "_v")
    up = lambda *by: Window.partitionBy("_k").orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    low, high = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)  # ranks from 0
    parts = x.groupBy("_k", "_n", "_part").agg(F.count("*").alias("_c")).withColumn("_to", F.sum("_c").over(up("_part")))  # PARTS rows a key at most
    parts = parts.where((F.col("_to") > low) & (F.col("_to") - F.col("_c") <= high)).select("_k", "_part", (F.col("_to") - F.col("_c")).alias("_from"))
    inside = x.join(parts, ["_k", "_part"]).groupBy("_k", "_n", "_part", "_from", "_v").agg(F.count("*").alias("_c"))
    along = Window.partitionBy("_k", "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("_to", F.col("_from") + F.sum("_c").over(along))
    middle = inside.where((F.col("_to") > low) & (F.col("_to") - F.col("_c") <= high)).groupBy("_k").agg(((F.min("_v") + F.max("_v")) / 2).alias(name))
    return span.select("_k").join(middle, "_k", "left").select("_k.*", name)


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """``a`` with the further columns of ``b``, joined by keys that may be null."""
    other = b.select(F.struct(*keys).alias("_k"), *[c for c in b.columns if c not in keys])
    return a.withColumn("_k", F.struct(*keys)).join(other, "_k", "left").drop("_k")


def sample_stats(samples: DataFrame, key: str, batch: str, value: str) -> DataFrame:
    """Per key: the median of batch medians, spread, and moments of all samples."""
    v = F.col(value)
    t = samples.groupBy(key, batch).agg(F.count("*").alias("n"), F.sum(v).alias("s"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    batches = _same(t, medians(samples, [key, batch], value, "m"), [key, batch])
    t = batches.groupBy(key).agg(F.min("m").alias("best"), F.max("m").alias("worst"), F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mean"), F.min("lo").alias("least"), F.max("hi").alias("most"))
    t = _same(t, medians(batches, [key], "m", "median_of_medians"), [key])
    return t.select(key, *[F.round(c, 6).alias(c) for c in ("median_of_medians", "best", "worst", "mean", "least", "most")], "n")


def mad_outliers(samples: DataFrame, key: str, value: str, limit: float = 3.5) -> DataFrame:
    """Per key: median, median absolute deviation, samples more than ``limit`` deviations away."""
    dev = _same(samples, medians(samples, [key], value), [key]).withColumn("dev", F.abs(F.col(value) - F.col("median")))
    out = _same(dev, medians(dev, [key], "dev", "mad"), [key])
    out = out.groupBy(key).agg(F.max("median").alias("median"), F.max("mad").alias("mad"), F.count("*").alias("n"), F.count_if((F.col("mad") > 0) & (F.col("dev") > limit * F.col("mad"))).alias("outliers"))
    return out.select(key, F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"), "n", "outliers")


def ab_gate(samples: DataFrame, key: str, side: str, value: str, least: float = 0.97) -> DataFrame:
    """Candidate over baseline medians by key, and PASS, FAIL or MISSING where a side has no sample."""
    m = medians(samples, [key, side], value, "m")
    m = m.groupBy(key).agg(F.max(F.when(F.col(side) == "A", F.col("m"))).alias("a"), F.max(F.when(F.col(side) == "B", F.col("m"))).alias("b"))
    r = F.col("b") / F.col("a")
    status = F.when(F.col("a").isNull() | F.col("b").isNull(), "MISSING").when(r >= least, "PASS").otherwise("FAIL")
    return m.select(key, F.round("a", 6).alias("baseline"), F.round("b", 6).alias("candidate"), F.round(r, 6).alias("ratio"), status.alias("status"))


def repeatability(samples: DataFrame, key: str, run: str, value: str, warn: float = 0.05, fail: float = 0.15) -> DataFrame:
    """Spread of run medians over their median, with a verdict."""
    runs = medians(samples, [key, run], value, "m")
    s = _same(runs.groupBy(key).agg(F.count("*").alias("runs"), (F.max("m") - F.min("m")).alias("span")), medians(runs, [key], "m", "middle"), [key]).withColumn("spread", F.col("span") / F.col("middle"))
    return s.select(key, "runs", F.round("spread", 6).alias("spread"), F.when(F.round("spread", 6) <= warn, "STABLE").when(F.round("spread", 6) <= fail, "NOISY").otherwise("UNSTABLE").alias("verdict"))


def spread_stats(samples: DataFrame, key: str, value: str) -> DataFrame:
    """Per key: n, mean, sample deviation, coefficient of variation, and the least values that 95 and 99 percent do not exceed,
    within a ten-thousandth of the ranks (a mergeable sketch, so a hot key is no single task's work)."""
    v = F.col(value).cast("double")
    p = F.percentile_approx(v, [0.95, 0.99], 10_000)
    t = samples.groupBy(key).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), p.alias("p"))
    cv = F.when(F.col("mean") != 0, F.col("sd") / F.col("mean"))
    return t.select(key, "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), F.round(cv, 6).alias("cv"), F.col("p")[0].alias("p95"), F.col("p")[1].alias("p99"))


def estimator_error(pairs: DataFrame, key: str, estimate: str, actual: str) -> DataFrame:
    """Mean absolute error, mean absolute share, bias and 95th percentile of an estimator by key."""
    e = F.col(estimate) - F.col(actual)
    x = pairs.withColumn("e", e).withColumn("share", F.abs(e) / F.greatest(F.col(actual), F.lit(1)))
    return x.groupBy(key).agg(F.round(F.avg(F.abs("e")), 6).alias("mae"), F.round(F.avg("share"), 6).alias("mape"), F.round(F.avg("e"), 6).alias("bias"), F.round(F.percentile("share", 0.95), 6).alias("p95"))
