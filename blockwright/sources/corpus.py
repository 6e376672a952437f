"""Synthetic lanes for tests and benchmarks, from ``spark.range`` and column arithmetic alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_I = F.col


def _noise(seed: int, top: int):
    return F.pmod(F.xxhash64("pos", F.lit(seed)), F.lit(top))


#: Name to the value at pos (from 0); a fixed list of shapes.
WORKLOADS = {
    "zeros": lambda: F.lit(0), "low-cardinality": lambda: _I("pos") % 4, "runs": lambda: (F.floor(_I("pos") / 4096) * 17) % 256, "u32-counter": lambda: 10000 + 3 * (_I("pos") + 1),
    "random": lambda: _noise(1, 256), "u64-fixed-step": lambda: 1780000000000 + 1000 * _I("pos"), "u64-timestamps": lambda: 1780000000000 + 1000 * _I("pos") + F.floor(_I("pos") / 3) * 3 + _I("pos") % 3,
    "gauge-sawtooth": lambda: 100000 + _I("pos") % 4096, "monotonic-outliers": lambda: _I("pos") + F.floor(_I("pos") / 1024) * 100000, "delta-variable": lambda: F.floor(_I("pos") / 17) * 153 + (_I("pos") % 17) * ((_I("pos") % 17) + 1) / 2,
    "int-counter-reset": lambda: (_I("pos") % 5000) * 2 + _noise(2, 2), "f64-constant": lambda: F.lit(21.5), "f64-step": lambda: F.when(F.floor(_I("pos") / 1000) % 2 == 0, 0.5).otherwise(-0.5),
    "f64-financial-price": lambda: (10000 + _noise(3, 500)) / 100,
}


def workload(spark: SparkSession, name: str, n: int, block: int = 4096) -> DataFrame:
    """A lane (block_id, pos, v) of ``n`` values of the named shape."""
    if name not in WORKLOADS:
        raise ValueError(f"{name!r}: expected one of {', '.join(WORKLOADS)}")
    v = WORKLOADS[name]()
    rows = spark.range(n).select(F.col("id").alias("pos")).select("pos", v.alias("v"))
    v = F.col("v") if name.startswith("f64") else F.col("v").cast("long")
    return rows.select(F.floor(F.col("pos") / block).alias("block_id"), (F.col("pos") % block).alias("pos"), v.alias("v"))
