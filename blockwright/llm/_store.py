"""Tables in the shared folder that the cluster names in ``spark.checkpoint.dir``.

A written table cuts lineage, survives lost executors and has known file sizes, so Catalyst itself decides from
``spark.sql.autoBroadcastJoinThreshold`` whether a join against it may broadcast; beyond the threshold the same join
is shuffled and adaptive execution splits hot keys.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is set and the master is this machine."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="blockwright-")
    context.setCheckpointDir(made)
    return made


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; the table goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, p = _path(spark, path)
    fs.deleteOnExit(p)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def release(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read again."""
    for t in tables:
        if path := getattr(t, "_stored_at", None):
            fs, p = _path(t.sparkSession, path)
            fs.delete(p, True)


def quoted(name: str) -> str:
    """A column's name where SQL or DDL reads it: spaces, dots and quotes are part of it."""
    return "`" + name.replace("`", "``") + "`"


def fields(df: DataFrame) -> str:
    """The columns of ``df`` as DDL."""
    return ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in df.schema.fields)


#: Rows of an Arrow batch that holds texts, and the setting and default of Spark's own.
BATCH_ROWS, _BATCH, _DEFAULT = 2000, "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose texts will go through Arrow: the session's batches are cut to BATCH_ROWS rows unless someone has set
    their size, since a batch stands in memory on both sides of the pipe and texts may be long."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH, _DEFAULT) == _DEFAULT:
        conf.set(_BATCH, str(BATCH_ROWS))
    return df


def plain_names(df: DataFrame):
    """``df`` with names that a map over Arrow batches can resolve (no dots, spaces or quotes), and the way back."""
    safe = {c: c if c.isidentifier() else f"_named_{i}" for i, c in enumerate(df.columns)}
    own = {s: c for c, s in safe.items()}
    return df.select(*[F.col(quoted(c)).alias(s) for c, s in safe.items()]), lambda out: out.select(*[F.col(s).alias(own.get(s, s)) for s in out.columns])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
