"""A store of trained dictionaries as a Parquet folder: (dict_id string, scope string, bytes binary, crc long)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwright.functions.codecs import crc32c
from blockwright.operators.dictionary import dictionary_id

MAX_BYTES = 65535
SCHEMA = "dict_id string, scope string, bytes binary, crc long"


class DictionaryStore:
    """put, get, all, remove. Ids are decided by the bytes, so putting the same bytes again changes nothing."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, dict_id: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/dict={dict_id}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def put(self, data: bytes, scope: str = "external") -> str:
        if not 0 < len(data) <= MAX_BYTES:
            raise ValueError(f"{len(data)} bytes: a dictionary has 1 to {MAX_BYTES}")
        if scope not in ("file", "external"):
            raise ValueError(f"scope {scope!r}")
        name = str(dictionary_id(data))
        row = self.spark.range(1).select(F.lit(name).alias("dict_id"), F.lit(scope).alias("scope"), F.lit(data).alias("bytes"), F.lit(crc32c(data)).cast("long").alias("crc"))
        row.write.mode("overwrite").parquet(f"{self.path}/dict={name}")
        return name

    def get(self, dict_id: str) -> bytes | None:
        fs, p = self._folder(dict_id)
        if not fs.exists(p):
            return None
        row = self.spark.read.schema(SCHEMA).parquet(p.toString()).first()
        data = bytes(row["bytes"])
        if crc32c(data) != row["crc"]:
            raise ValueError(f"dictionary {dict_id} is damaged")
        return data

    def all(self) -> DataFrame:
        """Every dictionary, for ``ranges.resolve_dictionaries``."""
        fs, p = self._folder("")
        fs.mkdirs(p.getParent())
        return self.spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(self.path)

    def remove(self, dict_id: str) -> bool:
        fs, p = self._folder(dict_id)
        return fs.delete(p, True)
