"""Dictionary training: document frequencies of 8-byte grams and a greedy cover."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM = 8


def gram_frequencies(samples: DataFrame, key: str, text: str, least: int = 2) -> DataFrame:
    """(gram, df): how many samples hold each gram of 8 characters, where at least ``least`` do."""
    n = F.length(text)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), n - (GRAM - 1)), lambda i: F.substring(F.col(text), i, F.lit(GRAM))))
    each = samples.where(n >= GRAM).select(F.explode(grams).alias("gram"))
    return each.groupBy("gram").agg(F.count("*").alias("df")).where(F.col("df") >= least)


def train(samples: DataFrame, key: str, text: str, size: int = 4096, segment: int = 64, candidates: int = 2000) -> bytes:
    """A dictionary of at most ``size`` bytes: segments that cover most frequent grams, the best last; the last one taken is cut to the room left.

    The greedy cover is exact over all segments. In each round every task scores its segments by the grams not yet covered
    and hands its best to the driver, ``candidates`` by all tasks together (one by each at least), with the name and score of
    the next one; the driver takes segments as long as they come before all of those, since scores only fall. Each round takes
    one segment at least, so there are at most ``size`` / 8 of them, and what a round collects is bounded however many
    tasks there are.
    """
    freq = gram_frequencies(samples, key, text)
    at = F.sequence(F.lit(1), F.greatest(F.length(text) - (segment - 1), F.lit(1)), F.lit(segment // 2))
    seg = samples.where(F.length(text) >= GRAM).select(F.explode(F.transform(at, lambda i: F.substring(F.col(text), i, F.lit(segment)))).alias("segment")).distinct()
    n = F.length("segment")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - (GRAM - 1), F.lit(1))), lambda i: F.substring(F.col("segment"), i, F.lit(GRAM))))
    best = seg.select("segment", F.explode(grams).alias("gram")).join(freq, "gram").groupBy("segment").agg(F.sum("df").alias("score"), F.collect_list(F.struct("gram", "df")).alias("grams"))
    best = best.select("segment", "grams").persist(StorageLevel.DISK_ONLY)
    each = max(candidates // max(best.select(F.spark_partition_id().alias("task")).distinct().count(), 1), 1)
    out: list[bytes] = []
    room, seen, more = size, set(), True
    while room > 0 and more:
        open_ = F.filter("grams", lambda g: ~g["gram"].isin(*sorted(seen))) if seen else F.col("grams")
        now = best.select("segment", open_.alias("grams")).withColumn("score", F.aggregate("grams", F.lit(0).cast("long"), lambda n, g: n + g["df"]))
        place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # in the order of the task
        now = now.where("score > 0").sortWithinPartitions(F.desc("score"), "segment").withColumn("place", place).where(F.col("place") <= each)
        rows = now.select("segment", "score", F.when(F.col("place") < each, F.col("grams")).alias("grams")).collect()
        bound = min(((-r["score"], r["segment"].encode()) for r in rows if r["grams"] is None), default=None)
        more = bound is not None
        rows = [r for r in rows if r["grams"] is not None]
        left = {r["segment"]: {g["gram"]: g["df"] for g in r["grams"]} for r in rows}
        while left and room > 0:
            gain, pick = min((-sum(d for g, d in left[s].items() if g not in seen), s.encode()) for s in left)
            if not gain or bound and (gain, pick) > bound:
                break
            seen |= set(left.pop(pick.decode()))
            out.append(pick[:room])
            room -= len(out[-1])
    best.unpersist()
    return b"".join(reversed(out))


def dictionary_id(data: bytes) -> int:
    """FNV-1a over 64 bits; 0 stands for none, so it becomes 1."""
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h or 1
