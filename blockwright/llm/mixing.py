"""Mixing sources to target weights, with built-in functions only.

Tokens (words) are summed per source, each source gets a target and so a repetition rate, and every document is taken
floor(rate) times plus once more if a hash-seeded Bernoulli draw falls below the fraction.

Defined cases: null text has size 0 and is taken as often as any document; a null source is a source of its own and
comes last; an empty table gives an empty table; rows equal in id and text share one draw; other columns pass through
(the plan's columns replace clashing ones; the mix itself returns all columns as they are).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockwright.llm._store import quoted, stored, table

WORD = r"[^\x20\x09-\x0D]+"
#: A source is repeated at most so often.
MOST = 3
SEED = "mix-1"
#: Columns that stand beside the caller's on the way.
_SOURCE, _ROW = "_mix_source", "_mix_row"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def uniform(doc_id: Column, text: Column, seed: str) -> Column:
    """A number in [0, 1) that the seed, the id and the text decide."""
    key = F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def targets(sized: DataFrame, weights: Column | None = None, most: int = MOST) -> DataFrame:
    """One row per source: source, source_size, target, rate.

    ``sized`` has source and size. ``weights`` is an expression over source and ``rank`` (the source's place by code
    point, null last, from 0); by default 1, 2, 3, repeating. Targets share the sum of all sizes by weight, stop at
    ``most`` times their source's size, and the excess is reshared by weight until none is above. In closed form: with
    sources in order of size/weight, the shared level is the largest of (what is left) / (weight that is left).
    The windows here see one row per source, never a document.
    """
    weights = F.col("rank") % 3 + 1 if weights is None else weights
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    per = per.withColumn("weight", weights.cast("double")).withColumn("cap", (F.col("source_size") * most).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    every = Window.partitionBy()
    per = per.withColumn("spent", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    per = per.withColumn("left", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    per = per.withColumn("level", F.max((F.sum("source_size").over(every).cast("double") - F.col("spent")) / F.col("left")).over(every))
    target = F.least(F.col("cap"), F.col("weight") * F.col("level"))
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0))
    return per.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def mix_plan(docs: DataFrame, weights: Column | None = None, most: int = MOST, seed: str = SEED) -> DataFrame:
    """``docs`` with size, source_size, target, rate, copies (times the mix takes the document) and taken (its words).

    Two passes over the text and no shuffle of it: the per-source table is written first, and joined by a broadcast
    only while its file size allows that; beyond it the join is shuffled and hot sources are split at run time.
    """
    sized = docs.withColumn("size", word_count(F.col("text")))
    per = stored(targets(sized.select("source", "size"), weights, most), "mix-targets").withColumnRenamed("source", _SOURCE)
    sized = sized.drop("source_size", "target", "rate", "copies", "taken", _SOURCE)
    joined = sized.join(per, sized["source"].eqNullSafe(per[_SOURCE]), "left").drop(_SOURCE)
    whole = F.floor("rate")
    more = uniform(F.col("doc_id"), F.col("text"), seed) < F.col("rate") - whole
    joined = joined.withColumn("copies", (whole + more.cast("int")).cast("long"))
    return joined.withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, weights: Column | None = None, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The mix itself: the columns of ``docs``, each document as often as the plan takes it."""
    # The caller's columns travel as one, so that the plan's columns take none of their places.
    packed = docs.select("doc_id", "source", "text", F.struct(*map(quoted, docs.columns)).alias(_ROW))
    plan = mix_plan(packed, weights, most, seed).where("copies > 0")
    return plan.select(_ROW, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(f"{_ROW}.*")


def op1_mixing(spark, sf_dir):
    return mix_plan(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken", "copies")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
ranked AS (
  SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight,
         row_number() OVER (ORDER BY source ASC NULLS LAST) AS place, (source_size * 3)::DOUBLE AS cap FROM per),
spent AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS spent,
         sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS remaining,
         sum(source_size) OVER () AS whole FROM ranked),
lev AS (SELECT *, max((whole::DOUBLE - spent) / remaining) OVER () AS level FROM spent),
t AS (
  SELECT source, source_size, least(cap, weight * level) AS target,
         CASE WHEN source_size > 0 THEN least(cap, weight * level) / source_size ELSE 0.0 END AS rate FROM lev),
j AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         floor(t.rate)::BIGINT + (CASE WHEN ('0x' || substr(md5('mix-1|' || coalesce(d.doc_id::VARCHAR, '') || '|' || md5(d.text)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE
                                       < t.rate - floor(t.rate) THEN 1 ELSE 0 END) AS copies
  FROM d LEFT JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies::BIGINT AS copies FROM j
"""
