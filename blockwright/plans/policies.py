"""Admission rules, penalties and budgets of the planner, as columns and small relations. Thresholds are fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROFILES = ("fast", "balanced", "dense")


def early_raw(p: DataFrame) -> Column:
    """Nothing to gain: near-uniform bytes without runs, trends or repetition."""
    return (F.col("h0") > 7.985) & (F.greatest("run_score", "delta_score", "repetition") < 0.002) & (F.col("match_length") < 4.5)


def fast_path(profile: str) -> Column:
    """The layout that a clear profile decides at once, else null."""
    fast = F.lit(profile == "fast")
    extreme = (F.col("zero_ratio") > 0.985) | (F.col("run_score") > 0.92)
    return (
        F.when((F.col("incompressibility") > 0.985) & (F.col("h0") > 7.985) & (F.col("repetition") < 0.003), "raw").when(extreme & fast, "rle").when(extreme, F.lit(None))
        .when(fast & (F.col("repetition") > 0.55) & (F.col("match_length") >= 12), "lz_fast+huffman").when(fast & (F.col("delta_score") > 0.75) & (F.col("h0") > 4.0), "delta+raw+huffman")
    )


def eligible(route: Column) -> Column:
    """Whether a candidate's codec may compete on a block's route."""
    codec = F.col("codec")
    return F.when(route == "numeric-fast", codec == "numeric").when(route == "numeric-general", codec.isin("numeric", "raw", "rle", "series", "lz")).otherwise(codec != "numeric")


def weak_rans(estimates: DataFrame, profile: str = "balanced") -> DataFrame:
    """Adds penalty: 1 where a range coder gains too little over the same layout with prefix codes. It sorts before the score."""
    least = {"fast": 0.05, "balanced": 0.02, "dense": 0.0}[profile]
    peer = estimates.where("entropy = 'huffman'").select("block_id", "transform", "codec", F.coalesce("lz", F.lit("")).alias("mode"), F.col("estimate").alias("peer"))
    x = estimates.withColumn("mode", F.coalesce("lz", F.lit(""))).join(peer, ["block_id", "transform", "codec", "mode"], "left").drop("mode")
    weak = F.col("entropy").isin("rans", "rans4x") & F.col("peer").isNotNull() & ((F.col("peer") - F.col("estimate")) < F.lit(least) * F.col("peer"))
    return x.withColumn("penalty", F.when(weak, 1).otherwise(0)).drop("peer")


def dominant(estimates: DataFrame, profile: str = "balanced") -> DataFrame:
    """Candidates whose loss against the block's best is small, absolutely or relatively."""
    loss, share = {"fast": (4096, 20000), "balanced": (2048, 10000), "dense": (512, 5000)}[profile]
    best = F.min("estimate").over(Window.partitionBy("block_id"))
    x = estimates.withColumn("loss", F.col("estimate") - best).withColumn("best", best)
    return x.where((F.col("loss") <= loss) | (F.col("loss") * 1000000 <= F.col("best") * share)).drop("best")


def beats_by_margin(plain: Column, other: Column, min_gain: int = 32) -> Column:
    """A container must save min_gain bytes, or a hundredth if that is more."""
    return (plain - other) >= F.greatest(F.lit(min_gain), F.floor(plain / 100))


def raw_fallback(label: Column, framed: Column, raw: Column, min_gain: int = 32) -> Column:
    return F.when(framed + min_gain >= raw, "raw").otherwise(label)


def series_beats_generic(series: Column, generic: Column, size: Column, exact: bool = True) -> Column:
    """A series layout replaces the generic one if clearly smaller, and if the saving is a 32nd of the block."""
    return (series <= F.lit(0.9 if exact else 0.75) * generic) & ((generic - series) * 32 >= size)


def confidence_class(error: Column) -> Column:
    return F.when(error < 0.05, "high").when(error <= 0.15, "medium").otherwise("low")


def hybrid_budget(numeric: Column, generic: Column, profile: str = "balanced") -> Column:
    """How much trial work generic layouts deserve against an exact numeric size."""
    ratio = F.when(generic == 0, F.lit(1.0)).otherwise(numeric / generic)
    return F.when(ratio <= {"fast": 0.7, "balanced": 0.8, "dense": 0.9}[profile], "none").when(ratio <= 0.97, "one-stage").otherwise("full")


def adaptive_k(confidence: Column, profile: str = "balanced") -> Column:
    """How many candidates are verified: fewer where the estimate is sure."""
    low, mid, high = {"fast": (2, 2, 1), "balanced": (4, 3, 2), "dense": (6, 5, 4)}[profile]
    return F.when(confidence >= 0.95, high).when(confidence >= 0.80, mid).otherwise(low)


def second_stage(scores: DataFrame, profile: str = "balanced", margin: float = 0.03) -> DataFrame:
    """How many candidates the second stage encodes, by block: one more where the sizes of the two best by score are closer
    than ``margin`` or the best one's confidence is low; three at least when dense; never more than there are."""
    w = Window.partitionBy("block_id").orderBy("score", "plan")
    every = F.count("*").over(Window.partitionBy("block_id"))
    x = scores.withColumn("rank", F.row_number().over(w)).withColumn("next", F.lead("estimate").over(w)).withColumn("all", every).where("rank = 1")
    gap = F.greatest(F.col("next") - F.col("estimate"), F.lit(0)) / F.greatest(F.col("estimate"), F.lit(1))
    close = F.col("next").isNotNull() & ((gap < margin) | (F.col("confidence") < 0.8))
    k = F.lit({"fast": 1, "balanced": 2, "dense": 3}[profile]) + F.when(F.coalesce(close, F.lit(False)), 1).otherwise(0)
    return x.select("block_id", "plan", "estimate", "next", F.least(F.greatest(k, F.lit(3 if profile == "dense" else 1)), F.col("all")).cast("int").alias("k"))


def sample_ranges(sizes: DataFrame, windows: int, length: int) -> DataFrame:
    """Evenly spaced sample windows of each block: sample, from, to."""
    n = F.least(F.lit(windows), F.greatest(F.floor(F.col("size") / length), F.lit(1))).cast("long")
    x = sizes.withColumn("count", n).withColumn("sample", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)))
    room = F.greatest(F.col("size") - length, F.lit(0))
    start = F.when(F.col("count") == 1, F.lit(0)).otherwise(F.floor(room * F.col("sample") / (F.col("count") - 1))).cast("long")
    return x.select("block_id", "sample", start.alias("from"), F.least(start + length, F.col("size")).alias("to"))


def blend_weight(codec: Column, confidence: Column, stage: int, profile: str) -> Column:
    """Percent of a verified sample in the blended estimate."""
    lz = F.when(confidence >= 0.9, 20).when(confidence >= 0.75, 25).otherwise(30)
    other = F.when(confidence >= 0.9, 25).when(confidence >= 0.75, 40).otherwise(55)
    w = F.when(codec == "lz", lz).otherwise(other)
    if stage == 2:
        w = F.least(w + 5, F.lit(60))
    return {"dense": w - 5, "fast": F.least(w + 5, F.lit(65)), "balanced": w}[profile]


def preferred(estimates: DataFrame, tier: Column, profile: str = "balanced", ppm: int = 15_000) -> DataFrame:
    """Per block the smallest candidate of the best preference tier inside the size envelope."""
    best = F.min("estimate").over(Window.partitionBy("block_id"))
    inside = estimates.withColumn("tier", tier).withColumn("best", best).where(F.expr(f"estimate <= best + (best * {ppm} + 999999) div 1000000"))
    pick = inside.groupBy("block_id").agg(F.min(F.struct("tier", "estimate", "plan")).alias("b"))
    return pick.select("block_id", "b.plan", "b.tier", "b.estimate")


def regret(scores: DataFrame, chosen: DataFrame) -> DataFrame:
    """How many bytes the chosen layouts lose against the smallest ones: recall, mean, 95th and 99th percentile."""
    best = scores.groupBy("block_id").agg(F.min("estimate").alias("best"))
    x = chosen.join(best, "block_id").withColumn("loss", F.col("estimate") - F.col("best"))
    return x.agg(F.count("*").alias("blocks"), F.round(F.avg((F.col("loss") == 0).cast("int")), 6).alias("recall"), F.round(F.avg("loss"), 6).alias("mean"), F.expr("cast(percentile_disc(0.95) within group (order by loss) as bigint)").alias("p95"), F.expr("cast(percentile_disc(0.99) within group (order by loss) as bigint)").alias("p99"))


def symbol_model(histogram: DataFrame, scale: int = 4096) -> DataFrame:
    """Frequencies on a fixed scale: the floor, at least 1, and the remainder that decides who gets what is left."""
    whole = F.sum("n").over(Window.partitionBy("block_id"))
    exact = F.col("n") * scale
    return histogram.select("block_id", "value", F.greatest(F.floor(exact / whole), F.lit(1)).alias("base"), (exact % whole).alias("rest"))
