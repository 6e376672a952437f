"""The engine as one object: configure, encode with a plan per block, decode, verify, inspect, explain, read ranges, train.

Every block is planned, encoded and checked in one Arrow batch (``plans.blockplan``): nothing about single bytes is shuffled,
and a lost executor costs its blocks only.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwright.functions import codecs, measure
from blockwright.operators import dictionary
from blockwright.plans import blockplan, planner
from blockwright.sources import blocks
from blockwright.sources.records import RecordSchema

#: Bytes that a file pays for a dictionary besides the dictionary itself.
DICTIONARY_SECTION = 28
PLAN_SCHEMA = "route string, reason string, estimate long, saved long, inner array<string>"


@dataclass(frozen=True)
class Limits:
    """What a decoder accepts at most."""

    max_block_size: int = 4 << 20
    max_encoded_size: int = 8 << 20
    max_blocks: int = 16 << 20
    max_file_size: int = 1 << 44
    max_dictionary_size: int = 65535
    max_dictionaries: int = 64
    max_columns: int = 255
    max_segment_window: int = 4 << 20
    max_range: int = 1 << 30


@dataclass(frozen=True)
class Config:
    """Block size (None: recommended from the first block), profile, what may be tried, records, dictionaries and limits."""

    block_size: int | None = blocks.BLOCK_SIZE
    profile: str = "balanced"
    schema: RecordSchema | None = None
    limits: Limits = field(default_factory=Limits)
    numeric: bool = True
    floats: bool = True
    #: Least bytes of a segment, 0 for none, and the window that segments are made of.
    segment: int = 0
    segment_window: int = 65536
    dictionary: bytes = b""
    access: str = "mixed"

    def __post_init__(self):
        limits = self.limits
        if self.profile not in planner.WEIGHTS:
            raise ValueError(f"profile {self.profile!r}: expected one of {', '.join(planner.WEIGHTS)}")
        if self.block_size is not None and not 0 < self.block_size <= limits.max_block_size:
            raise ValueError(f"block size {self.block_size} out of bounds")
        if self.access not in ("mixed", "random", "sequential"):
            raise ValueError(f"access {self.access!r}")
        if len(self.dictionary) > limits.max_dictionary_size:
            raise ValueError(f"dictionary of {len(self.dictionary)} bytes")
        if self.schema and len(self.schema.fields) > limits.max_columns:
            raise ValueError("too many columns")
        if self.segment < 0 or not 0 < self.segment_window <= limits.max_segment_window:
            raise ValueError("segments out of bounds")

    @property
    def aligned(self) -> int | None:
        return self.schema.aligned(self.block_size) if self.schema and self.block_size else self.block_size

    def options(self, dictionary: bytes | None = None) -> blockplan.Options:
        known = self.dictionary if dictionary is None else dictionary
        fields = tuple((self.schema.dtype.fields[n][0].itemsize, kind[0]) for n, kind in self.schema.fields) if self.schema else ()
        return blockplan.Options(self.profile, self.numeric, self.floats, known, dictionary_id(known), self.segment, self.segment_window, fields=fields)


def dictionary_id(data: bytes) -> int:
    return dictionary.dictionary_id(data) if data else 0


def _encoded(o: blockplan.Options):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = ["file_id", "block_id", "original_offset", "original_size"]
        for b in batches:
            for part in blocks.pieces(b, "data"):
                made, crc = [], []
                for x in part.column("data"):
                    raw = x.as_buffer().to_pybytes()
                    made.append(blockplan.encode(raw, o))
                    crc.append(codecs.crc32c(raw))
                columns = {
                    "label": pa.array([m.label for m in made], pa.string()), "crc": pa.array(crc, pa.int64()), "payload": pa.array([m.payload for m in made], pa.binary()),
                    "route": pa.array([m.plan.route for m in made], pa.string()), "reason": pa.array([m.plan.reason for m in made], pa.string()), "estimate": pa.array([m.plan.estimate for m in made], pa.int64()),
                    "saved": pa.array([m.saved for m in made], pa.int64()), "inner": pa.array([m.inner for m in made], pa.list_(pa.string())),
                }
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *columns.values()], names=[*keep, *columns])

    return run


def _explained(o: blockplan.Options, exhaustive: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                part = b.slice(i, 1)
                raw = part.column("data")[0].as_py()
                p = blockplan.plan(raw, o)
                kind, _, found = blockplan.route(raw, o)
                oracle = blockplan.exhaustive(raw, o) if exhaustive else []
                made = {
                    "label": [p.label], "route": [kind], "reason": [p.reason], "estimate": pa.array([p.estimate], pa.int64()), "pool": pa.array([p.pool], pa.int32()), "second": pa.array([p.second], pa.int32()),
                    "candidates": pa.array([[{"label": c.label, "size": c.size, "score": c.score, "confidence": c.confidence} for c in p.ranked]], pa.list_(pa.struct([("label", pa.string()), ("size", pa.int64()), ("score", pa.int64()), ("confidence", pa.float64())]))),
                    "qualified": pa.array([[c.label for c in p.qualified]], pa.list_(pa.string())), "verdict": [found.get("verdict")], "profile": [json.dumps(measure.block_profile(raw, o.profile), sort_keys=True)],
                    "best_label": pa.array([oracle[0][1] if oracle else None], pa.string()), "best_size": pa.array([oracle[0][0] if oracle else None], pa.int64()),
                    "plan_size": pa.array([next((n for n, label in oracle if label == p.label), None)], pa.int64()),
                }
                keep = ["file_id", "block_id", "original_size"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(v if isinstance(v, pa.Array) else pa.array(v, pa.string()) for v in made.values())], names=[*keep, *made])

    return run


EXPLAIN_SCHEMA = (
    "file_id string, block_id long, original_size int, label string, route string, reason string, estimate long, pool int, second int, candidates array<struct<label:string,size:bigint,score:bigint,confidence:double>>, "
    "qualified array<string>, verdict string, profile string, best_label string, best_size long, plan_size long"
)


class Engine:
    def __init__(self, config: Config | None = None, dictionaries: list[bytes] | None = None):
        """``dictionaries`` are known to the decoder besides the configured one; each is small, and so is their number."""
        self.config = config or Config()
        known = [d for d in [self.config.dictionary, *(dictionaries or [])] if d]
        limits = self.config.limits
        if len(known) > limits.max_dictionaries or any(len(d) > limits.max_dictionary_size for d in known):
            raise ValueError("too many or too large dictionaries")
        self.dictionaries = {dictionary_id(d): d for d in known}

    def chunk(self, files: DataFrame) -> DataFrame:
        return blocks.chunk(files, self.config.aligned or self.recommended(files))

    def recommended(self, files: DataFrame) -> int:
        """The block size for this access and profile, from the first bytes of the first file."""
        head = files.select("file_id", F.expr("substring(data, 1, 262144)").alias("data")).orderBy("file_id").first()
        numeric = bool(head) and measure.numeric_prefilter(bytes(head["data"]))["confidence"] >= 0.85 and self.config.access != "random"
        size = 262144 if self.config.access == "random" else 1048576 if numeric else 524288 if self.config.access == "sequential" or self.config.profile == "fast" else 262144
        return self.config.schema.aligned(size) if self.config.schema else size

    def compress_with_stats(self, files: DataFrame) -> DataFrame:
        """(file_id, data) to stored blocks, each by its own plan, with route, reason, estimate, bytes that a dictionary saved, and the labels of inner blocks."""
        return blocks.small_batches(self.chunk(files)).mapInArrow(_encoded(self.config.options()), f"{blocks.SCHEMA}, {PLAN_SCHEMA}")

    def compress(self, files: DataFrame) -> DataFrame:
        """(file_id, data) to stored blocks, each by its own plan; a layout that does not pay falls back to raw."""
        return self.compress_with_stats(files).drop(*(c.split()[0] for c in PLAN_SCHEMA.split(", ")))

    def compress_embedded(self, files: DataFrame) -> tuple[DataFrame, bytes]:
        """Stored blocks and the dictionary that belongs with them: none, and blocks without one, where it saves less than it costs."""
        used = self.config.dictionary
        saved = self.compress_with_stats(files).agg(F.sum("saved")).first()[0] or 0
        if used and saved > len(used) + DICTIONARY_SECTION:
            return self.compress(files), used
        return Engine(replace(self.config, dictionary=b"")).compress(files), b""

    def stats(self, stored: DataFrame) -> dict:
        """Counters of a result of ``compress_with_stats``: blocks, bytes, ratio, and blocks by label, route and reason."""
        by = {}
        for name in ("label", "route", "reason"):
            by[name] = {r[name]: r["n"] for r in stored.groupBy(name).agg(F.count("*").alias("n")).collect()}
        t = stored.agg(F.count("*").alias("blocks"), F.sum("original_size").alias("raw"), F.sum(F.octet_length("payload")).alias("bytes"), F.sum("saved").alias("dictionary_saved")).first()
        out = {k: int(t[k] or 0) for k in ("blocks", "raw", "bytes", "dictionary_saved")}
        return out | {"ratio": out["raw"] / out["bytes"] if out["bytes"] else 1.0} | by

    def _fits(self) -> Column:
        limits = self.config.limits
        return (
            (F.col("original_size") <= limits.max_block_size) & (F.octet_length("payload") <= limits.max_encoded_size) & (F.col("block_id") < limits.max_blocks)
            & (F.col("original_offset") + F.col("original_size") <= limits.max_file_size)
        )

    def decompress(self, stored: DataFrame) -> DataFrame:
        """(file_id, block_id, ..., data, error). Blocks beyond the limits are refused before they are decoded."""
        checked = stored.withColumn("payload", F.when(self._fits(), F.col("payload")).otherwise(F.raise_error(F.lit("block beyond the decode limits")).cast("binary")))
        return blocks.decode(checked, self.dictionaries)

    def files(self, stored: DataFrame) -> DataFrame:
        """Whole files again: (file_id, data). For files that fit one row; use ``blocks.stream_blocks`` for others."""
        parts = self.decompress(stored).groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("block_id", "data"))).alias("parts"))
        return parts.select("file_id", F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["data"])).alias("data"))

    def verify(self, stored: DataFrame) -> DataFrame:
        return blocks.verify(stored, self.dictionaries)

    def check(self, stored: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
        """The sizes of each block and what is wrong with it, without its bytes (``blocks.check``)."""
        return blocks.check(stored, self.dictionaries, carried)

    inspect = staticmethod(blocks.inspect)
    train = staticmethod(dictionary.train)

    def read_range(self, stored: DataFrame, file_id: str, first: int, last: int) -> DataFrame:
        if last - first > self.config.limits.max_range:
            raise ValueError(f"range of {last - first} bytes")
        return blocks.read_range(stored, file_id, first, last, self.dictionaries)

    def decode_block(self, stored: DataFrame, file_id: str, block_id: int) -> bytes:
        """One block; a damaged one raises ValueError."""
        row = self.decompress(stored.where((F.col("file_id") == file_id) & (F.col("block_id") == block_id))).first()
        if row is None or row["error"]:
            raise ValueError(row["error"] if row else f"no block {block_id} in {file_id!r}")
        return bytes(row["data"])

    def explain(self, files: DataFrame, exhaustive: bool = False) -> DataFrame:
        """One row per block: the layout planned, its route and reason, all candidates by rank with size, score and confidence,
        those inside the envelope, and the profile. ``exhaustive`` also encodes every layout, and names the smallest."""
        return blocks.small_batches(self.chunk(files)).mapInArrow(_explained(self.config.options(), exhaustive), EXPLAIN_SCHEMA)

    def decompress_stream(self, spark: SparkSession, source: str, out: str, checkpoint: str) -> int:
        """Decodes blocks that arrive under ``source`` as a block table into (file_id, block_id, ..., data, error) at ``out``; returns how many."""
        arriving = spark.readStream.schema(blocks.SCHEMA).parquet(source)
        query = self.decompress(arriving).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.parquet(out).count()
