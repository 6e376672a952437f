"""Cost-based choice of a layout per block, as relations: candidates x profiles, filters, ranks and a stable arg-min.

Scores are integers, so the choice does not depend on the order of evaluation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockwright.functions.scalars import label

#: The candidate layouts: number, transform, codec, mode, entropy coder, least size for profile balanced. Fixed values.
CANDIDATES = [
    (1, "", "raw", None, "none", 0), (2, "", "raw", None, "huffman", 0), (3, "", "raw", None, "rans", 4096), (4, "", "raw", None, "rans4x", 16384),
    (5, "", "rle", None, "none", 0), (6, "", "rle", None, "huffman", 0), (7, "", "rle", None, "rans", 4096), (8, "", "rle", None, "rans4x", 16384),
    (9, "delta", "raw", None, "huffman", 0), (10, "delta", "raw", None, "rans", 4096), (11, "delta", "raw", None, "rans4x", 16384),
    (12, "", "lz", "fast", "huffman", 0), (13, "", "lz", "fast", "rans", 4096), (14, "", "lz", "fast", "rans4x", 16384),
    (15, "", "lz", "balanced", "huffman", 0), (16, "", "lz", "balanced", "rans", 4096), (17, "", "lz", "balanced", "rans4x", 16384),
    (18, "delta", "lz", "fast", "huffman", 0), (19, "delta", "lz", "fast", "rans", 4096), (20, "delta", "lz", "balanced", "huffman", 0), (21, "delta", "lz", "balanced", "rans", 4096),
]
#: More than the number of any layout.
_PLANS = 64
#: Weights of size, encoding, decoding and memory, and the scales of the two work terms, by profile. Fixed values.
WEIGHTS = {"fast": (20, 55, 20, 5, 34000, 6000), "balanced": (60, 18, 17, 5, 3500, 1300), "dense": (86, 5, 5, 4, 550, 300)}
#: Parts per million over the best size that a candidate may cost and stay in the running.
ENVELOPE = {"fast": 250_000, "balanced": 15_000, "dense": 3_000}


def candidates(spark: SparkSession) -> DataFrame:
    """The fixed dimension of layouts (21 rows)."""
    made = F.explode(F.array(*[F.struct(F.lit(i).alias("plan"), F.lit(t).alias("transform"), F.lit(c).alias("codec"), F.lit(z).cast("string").alias("lz"), F.lit(e).alias("entropy"), F.lit(s).alias("least_size")) for i, t, c, z, e, s in CANDIDATES]))
    return spark.range(1).select(made.alias("c")).select("c.*").withColumn("label", label(F.col("transform"), F.col("codec"), F.col("lz"), F.col("entropy")))


def _clamp(v: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def estimated(profiles: DataFrame, plans: DataFrame) -> DataFrame:
    """Every block with every layout open to it: analytic size and work. The dimension is fixed and broadcast."""
    x = profiles.join(F.broadcast(plans), F.col("size") >= F.col("least_size"))
    h = _clamp(F.col("h0") / 8, 0.02, 1.0)
    entropy = F.when(F.col("entropy") == "none", 1.0).when(F.col("entropy") == "huffman", _clamp(0.04 + 0.96 * h, 0.04, 1.03)).otherwise(_clamp(0.025 + 0.94 * h, 0.03, 1.02))
    signal = F.greatest("repetition", _clamp(F.col("match_length") / 48, 0.0, 1.0))
    delta = F.when(F.col("transform") == "delta", 1 - 0.55 * _clamp(F.col("delta_score"), 0.0, 0.85)).otherwise(1.0)
    rle = F.when(F.col("codec") == "rle", _clamp(1 - 0.9 * F.greatest("run_score", "zero_ratio"), 0.015, 1.05)).otherwise(1.0)
    lz = F.when(F.col("codec") == "lz", _clamp(1 - signal * F.when(F.col("lz") == "balanced", 0.72).otherwise(0.62), 0.05, 1.04)).otherwise(1.0)
    meta = F.when(F.col("entropy") == "none", 0).when(F.col("entropy") == "huffman", 260).when(F.col("entropy") == "rans", 516).otherwise(2064)
    size = F.greatest(F.round(F.round(F.col("size") * delta * rle * lz * entropy, 3)), F.lit(1.0)).cast("long") + meta
    enc = F.when(F.col("codec") == "raw", 1).when(F.col("codec") == "rle", 2).when(F.col("lz") == "fast", 4).otherwise(9) + F.when(F.col("entropy") == "none", 0).when(F.col("entropy") == "huffman", 4).when(F.col("entropy") == "rans", 9).otherwise(5) + F.when(F.col("transform") == "delta", 1).otherwise(0)
    dec = F.when(F.col("codec") == "raw", 1).when(F.col("codec") == "rle", 2).otherwise(3) + F.when(F.col("entropy") == "none", 0).when(F.col("entropy") == "huffman", 6).when(F.col("entropy") == "rans", 5).otherwise(3) + F.when(F.col("transform") == "delta", 1).otherwise(0)
    memory = F.col("size") * F.when(F.col("codec") == "lz", 3).otherwise(2)
    sure = F.greatest(
        F.lit(0.78), F.when(F.col("transform") == "delta", _clamp(0.60 + F.col("delta_score") * 0.35, 0.0, 0.98)), F.when(F.col("codec") == "rle", _clamp(0.62 + F.greatest("run_score", "zero_ratio") * 0.36, 0.0, 0.99)),
        F.when(F.col("codec") == "lz", _clamp(0.54 + signal * 0.34, 0.0, 0.94)),
    )
    return x.select("block_id", "size", "plan", "label", "codec", "entropy", "transform", "lz", size.cast("long").alias("estimate"), enc.cast("long").alias("encode"), dec.cast("long").alias("decode"), memory.cast("long").alias("memory"), F.round(sure, 6).alias("confidence"))


def scored(estimates: DataFrame, profile: str = "balanced") -> DataFrame:
    """Adds the integer score of the weighted cost."""
    size, enc, dec, mem, es, ds = WEIGHTS[profile]
    n = F.greatest(F.col("size"), F.lit(1))
    ppm = F.expr("estimate * 1000000 div greatest(size, 1)")
    memory = F.floor(F.col("memory") * 1000 / n)
    return estimates.withColumn("score", (ppm * size + F.col("encode") * es * enc + F.col("decode") * ds * dec + memory * mem).cast("long"))


def ranked(scores: DataFrame) -> DataFrame:
    """Adds rank by (score, plan) within the block."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("block_id").orderBy("score", "plan")))


def enveloped(scores: DataFrame, profile: str = "balanced") -> DataFrame:
    """Keeps candidates within the size envelope of the block's smallest."""
    best = F.min("estimate").over(Window.partitionBy("block_id"))
    limit = F.expr(f"best + ((best * {ENVELOPE[profile]}) + 999999) div 1000000")
    return scores.withColumn("best", best).where(F.col("estimate") <= limit).drop("best")


def selected(scores: DataFrame) -> DataFrame:
    """The arg-min by (score, plan) of each block."""
    best = scores.groupBy("block_id").agg(F.min(F.struct("score", "plan", "label", "estimate", "size")).alias("b"))
    return best.select("block_id", "b.plan", "b.label", "b.estimate", "b.size", "b.score")


def selected_by_tier(estimates: DataFrame, tiers: dict[str, str]) -> DataFrame:
    """(block_id, tier, plan, label): what ``selected`` chooses by each tier's profile, from one pass over the estimates.

    A score and its plan are one integer, so a block's least is kept in a hash table of numbers before anything is shuffled.
    """
    for tier, profile in tiers.items():
        estimates = scored(estimates, profile).withColumn(f"of_{tier}", F.col("score") * _PLANS + F.col("plan")).drop("score")
    best = estimates.groupBy("block_id").agg(*[F.min(f"of_{t}").alias(f"of_{t}") for t in tiers])
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("tier"), (F.col(f"of_{t}") % _PLANS).cast("int").alias("plan")) for t in tiers])).alias("t")
    return best.select("block_id", each).select("block_id", "t.*").join(F.broadcast(candidates(estimates.sparkSession).select("plan", "label")), "plan")


def family_representatives(scores: DataFrame, k: int = 3) -> DataFrame:
    """The first ``k`` candidates of a block, and the best of each codec family that is not among them."""
    family = Window.partitionBy("block_id", "codec").orderBy("score", "plan")
    r = ranked(scores).withColumn("in_family", F.row_number().over(family))
    return r.where((F.col("rank") <= k) | (F.col("in_family") == 1)).drop("in_family")


def route(prefilter: DataFrame, steps: DataFrame, profile: str = "balanced") -> DataFrame:
    """generic, numeric-general or numeric-fast, from the prefilter and the fixed-step evidence."""
    least = {"fast": 0.995, "balanced": 0.98, "dense": 0.97}[profile]
    x = prefilter.join(steps.select("block_id", "step"), "block_id", "left")
    fast = F.col("strong") & (F.col("confidence") >= least) & F.col("step").isNotNull()
    return x.select("block_id", "confidence", F.when(~F.col("likely"), "generic").when(fast, "numeric-fast").otherwise("numeric-general").alias("route"))


def data_class(profiles: DataFrame) -> DataFrame:
    """zero-heavy, incompressible, numeric or structured."""
    c = (
        F.when((F.col("zero_ratio") >= 0.985) | (F.col("run_score") >= 0.92), "zero-heavy")
        .when((F.col("incompressibility") >= 0.96) & (F.col("repetition") < 0.01) & (F.col("run_score") < 0.01), "incompressible")
        .when(F.col("delta_score") >= 0.08, "numeric").otherwise("structured")
    )
    return profiles.select("block_id", c.alias("data_class"))


def block_size(numeric: DataFrame, access: str, profile: str) -> DataFrame:
    """Recommended block size and its reason, from the first block's numeric profile."""
    numeric_ok = (F.col("confidence") >= 0.85) & F.lit(access != "random")
    size = F.when(F.lit(access == "random"), 262144).when(numeric_ok, 1048576).when(F.lit(access == "sequential" or profile == "fast"), 524288).otherwise(262144)
    reason = F.when(F.lit(access == "random"), "random-access-cap").when(numeric_ok, "numeric-sequential").when(F.lit(access == "sequential" or profile == "fast"), "sequential-throughput").otherwise("balanced-default")
    return numeric.select("block_id", size.cast("long").alias("block_size"), reason.alias("reason"))


def explained(scores: DataFrame, profile: str = "balanced") -> DataFrame:
    """One row per block: the selected layout, and all candidates by rank, as labels."""
    order = F.transform(F.array_sort(F.collect_list(F.struct("score", "plan", "label"))), lambda c: c["label"])
    return scores.groupBy("block_id").agg(order.alias("all")).select("block_id", F.element_at("all", 1).alias("selected"), F.array_join("all", ",").alias("candidates"))


def plan_distribution(chosen: DataFrame) -> DataFrame:
    return chosen.groupBy("label").agg(F.count("*").alias("blocks"), F.sum("estimate").alias("bytes"), F.sum("size").alias("raw"))
