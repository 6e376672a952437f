"""Tables in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Tables under this many bytes may be a single row group, and so a single task.
SMALL = 64 << 20
#: Bytes of an Arrow batch that holds blocks, and the setting and default of Spark's own.
BATCH, _BATCH, _DEFAULT = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch", "67108864"


def spread(table: DataFrame) -> DataFrame:
    """Deals the rows of a small table to all cores before heavy per-row work; a large one has splits enough and is left alone."""
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return table.repartition(table.sparkSession.sparkContext.defaultParallelism) if size < SMALL else table


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose blocks will go through Arrow: the session's batches are cut to BATCH bytes unless someone has set their size,
    since a batch stands in memory on both sides of the pipe, of every pipe of a task."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH).rstrip("b") == _DEFAULT:
        conf.set(_BATCH, str(BATCH))
    return df
