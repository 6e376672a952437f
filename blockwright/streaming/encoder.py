"""Bounded-memory encoding as a stream of blocks: the same rows as the batch encoder, whatever the batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwright.sources import blocks


def encode_stream(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, label: str = "lz_fast", block_size: int = blocks.BLOCK_SIZE, files_per_batch: int = 4, expected: int | None = None) -> int:
    """Encodes files (file_id, data) that arrive under ``source`` into a block table at ``out``; returns the blocks written.

    Every micro-batch holds whole files, so blocks need no state; rows are keyed by (file_id, block_id), and a batch that
    runs again writes the same rows once. With ``expected`` the total of original bytes must match, or ValueError.
    """
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def write(batch: DataFrame, epoch: int) -> None:
        # A batch is a few files, and so a few tasks: their blocks are dealt to all cores.
        cut = blocks.chunk(batch, block_size).repartition(spark.sparkContext.defaultParallelism, "file_id", "block_id").withColumn("label", F.lit(label))
        blocks.encode(cut).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    query = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    done = spark.read.parquet(out).agg(F.count("*").alias("n"), F.coalesce(F.sum("original_size"), F.lit(0)).alias("bytes")).first()
    if expected is not None and done["bytes"] != expected:
        raise ValueError(f"{done['bytes']} bytes came, {expected} were announced")
    return done["n"]


def windowed_counts(events: DataFrame, late: str = "10 minutes", window: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums of events by type and event-time window (sliding by ``slide``, else tumbling), late ones dropped past the watermark."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark needs an instant
    return events.withWatermark("ts", late).groupBy(F.window("ts", window, slide), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def session_counts(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """The same by sessions: a session of a type ends when nothing comes for ``gap``."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
