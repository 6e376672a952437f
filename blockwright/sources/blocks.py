"""Block tables: the native container. Blocks are rows of a Parquet table with their plan, checksum and payload.

``encode`` and ``decode`` run in Arrow batches, one block a row, so they are embarrassingly parallel; order is data
(``block_id``), never arrival. Reading a range prunes by the block's offset, which Parquet keeps as row-group statistics.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockwright.functions import codecs
from blockwright.plans import blockplan
from blockwright.sources import BATCH, small_batches  # noqa: F401

BLOCK_SIZE = 256 * 1024
#: Bytes of blocks that a worker takes from a batch at once.
PIECE = 1 << 20
SCHEMA = "file_id string, block_id long, original_offset long, original_size int, label string, crc long, payload binary"


def chunk(files: DataFrame, block_size: int = BLOCK_SIZE) -> DataFrame:
    """Cuts (file_id, data binary) into blocks: file_id, block_id, original_offset, original_size, data."""
    n = F.octet_length("data")
    count = F.when(n > 0, F.ceil(n / block_size)).otherwise(0)
    at = F.when(count > 0, F.sequence(F.lit(0).cast("long"), count.cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))
    cut = files.select("file_id", "data", F.explode(at).alias("block_id"))
    piece = F.expr(f"substring(data, cast(block_id * {block_size} + 1 as int), {block_size})")
    cut = cut.select("file_id", "block_id", (F.col("block_id") * block_size).alias("original_offset"), piece.alias("data"))
    return cut.select("file_id", "block_id", "original_offset", F.octet_length("data").alias("original_size"), "data")


def pieces(batch: pa.RecordBatch, column: str, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batch as slices of about ``most`` bytes of a binary column, a row at least: what is made of a slice is handed on
    before the next is read, so memory follows the slice and the largest block, not the batch."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, taken = 0, 0
    while at < batch.num_rows:
        end = max(int(np.searchsorted(ends, taken + most, side="right")), at + 1)
        yield batch.slice(at, end - at)
        at, taken = end, int(ends[end - 1])


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keep = ["file_id", "block_id", "original_offset", "original_size"]
    for batch in batches:
        for b in pieces(batch, "data"):
            labels, crc, payload = [], [], []
            for data, label in zip(b.column("data"), b.column("label").to_pylist(), strict=True):
                raw = data.as_py()
                out = codecs.encode_plan(raw, label)
                if len(out) + blockplan.MIN_GAIN >= len(raw):  # the raw layout costs about the same and decodes at once
                    label, out = "raw", raw
                labels.append(label)
                crc.append(codecs.crc32c(raw))
                payload.append(out)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(labels, pa.string()), pa.array(crc, pa.int64()), pa.array(payload, pa.binary())], names=[*keep, "label", "crc", "payload"])


def encode(blocks: DataFrame) -> DataFrame:
    """Blocks with a label (the plan chosen for each) to stored blocks."""
    return small_batches(blocks).select("file_id", "block_id", "original_offset", "original_size", "data", "label").mapInArrow(_encode, SCHEMA)


def _decoded(b: pa.RecordBatch, dictionaries: dict[int, bytes]) -> Iterator[tuple[bytes | None, str | None]]:
    """Each block's bytes, or what is wrong with it."""
    for payload, label, size, crc in zip(b.column("payload"), b.column("label").to_pylist(), b.column("original_size").to_pylist(), b.column("crc").to_pylist(), strict=True):
        try:
            raw = payload.as_py()
            out = blockplan.decode(raw, label, size, _named(raw, label, dictionaries))
            bad = None if codecs.crc32c(out) == crc else "checksum"
        except (ValueError, KeyError, IndexError, codecs.struct.error) as e:
            out, bad = None, str(e) or type(e).__name__
        yield None if bad else out, bad


def _decode(dictionaries: dict[int, bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = ["file_id", "block_id", "original_offset", "original_size"]
        for b in batches:
            for part in pieces(b, "payload"):
                data, error = zip(*_decoded(part, dictionaries), strict=True)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(data, pa.binary()), pa.array(error, pa.string())], names=[*keep, "data", "error"])

    return run


def _check(dictionaries: dict[int, bytes], carried: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = ["file_id", "block_id", "original_size", "label", *carried]
        for b in batches:
            found = [(None if out is None else len(out), bad) for out, bad in _decoded(b, dictionaries)]  # the bytes stay here
            made = [pc.binary_length(b.column("payload")), pa.array([n for n, _ in found], pa.int32()), pa.array([bad for _, bad in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *made], names=[*keep, "stored", "decoded", "error"])

    return run


def _named(payload: bytes, label: str, dictionaries: dict[int, bytes]) -> bytes:
    """The dictionary that a block asks for; blocks inside a container share the only one there is."""
    if label.startswith("dict"):
        name = int.from_bytes(payload[:8], "little")
        if name not in dictionaries:
            raise ValueError(f"dictionary {name} missing")
        return dictionaries[name]
    return next(iter(dictionaries.values()), b"") if label == "seg" else b""


def decode(stored: DataFrame, dictionaries: dict[int, bytes] | None = None) -> DataFrame:
    """Stored blocks to data; a damaged block has a null and an error, and does not stop the others. ``dictionaries`` by id: few and small."""
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    return small_batches(stored).select(*columns).mapInArrow(_decode(dictionaries or {}), "file_id string, block_id long, original_offset long, original_size int, data binary, error string")


def check(stored: DataFrame, dictionaries: dict[int, bytes] | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """(file_id, block_id, original_size, label, ``carried``, stored, decoded, error): every block decoded where it lies, with its
    sizes and what is wrong with it; no bytes come back."""
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    more = "".join(f", {c} {stored.schema[c].dataType.simpleString()}" for c in carried)
    return small_batches(stored).select(*columns, *carried).mapInArrow(_check(dictionaries or {}, carried), f"file_id string, block_id long, original_size int, label string{more}, stored int, decoded int, error string")


def verify(stored: DataFrame, dictionaries: dict[int, bytes] | None = None) -> DataFrame:
    """One row per file: blocks, damaged blocks, whether ids run from 0 without a gap, decoded bytes."""
    return check(stored, dictionaries).groupBy("file_id").agg(
        F.count("*").alias("blocks"), F.count_if(F.col("error").isNotNull()).alias("damaged"),
        ((F.min("block_id") == 0) & (F.max("block_id") + 1 == F.count("*")) & (F.countDistinct("block_id") == F.count("*"))).alias("complete"), F.sum("decoded").alias("bytes"),
    )


def inspect(stored: DataFrame) -> DataFrame:
    """Blocks, bytes and ratio by file and label, with sub-totals."""
    r = stored.rollup("file_id", "label").agg(F.count("*").alias("blocks"), F.sum("original_size").alias("raw"), F.sum(F.octet_length("payload")).alias("bytes"))
    return r.withColumn("ratio", F.round(F.when(F.col("bytes") == 0, 1.0).otherwise(F.col("raw") / F.col("bytes")), 6))


def write(stored: DataFrame, path: str) -> None:
    """Sorted by offset inside files, so that row groups have narrow offset ranges."""
    stored.repartitionByRange("file_id", "original_offset").sortWithinPartitions("file_id", "original_offset").write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def read_range(stored: DataFrame, file_id: str, first: int, last: int, dictionaries: dict[int, bytes] | None = None) -> DataFrame:
    """The bytes [first, last) of a file, by block: only blocks that touch the range are read and decoded."""
    if not 0 <= first <= last:
        raise ValueError(f"range {first}..{last}")
    hit = stored.where((F.col("file_id") == file_id) & (F.col("original_offset") < last) & (F.col("original_offset") + F.col("original_size") > first))
    d = decode(hit, dictionaries)
    a = F.greatest(F.lit(first) - F.col("original_offset"), F.lit(0))
    z = F.least(F.lit(last) - F.col("original_offset"), F.col("original_size").cast("long"))
    return d.select("file_id", "block_id", (F.col("original_offset") + a).alias("offset"), F.expr("data").substr((a + 1).cast("int"), (z - a).cast("int")).alias("data"), "error")


def stream_blocks(rows: DataFrame) -> Iterator[bytes]:
    """The data of decoded blocks in order, block by block, with one partition in memory at a time."""
    for r in rows.orderBy("file_id", "block_id").select("data").toLocalIterator():
        yield bytes(r["data"])


def lane_payloads(rows: DataFrame, codec: str, size: int) -> DataFrame:
    """Encodes each block of a lane (block_id, pos, v) and decodes it again: block_id, n, bytes, ok. ``codec`` names the layout.

    A block's values are bounded by the lane's block size, ``size``, so a block is one Arrow group.
    """

    def run(t: pa.Table) -> pa.Table:
        v = t.sort_by("pos").column("v").to_numpy()
        if codec.startswith("num1"):
            best = min((len(codecs.numeric_encode(v, m)), m) for m in (1, 2, 3))[1] if codec == "num1" else int(codec[-1])
            out = codecs.numeric_encode(v, best)
            back = codecs.numeric_decode(out)
        elif codec == "patched":
            out = min((codecs.patched_encode(v, b) for b in range(int(v.max() - v.min()).bit_length() + 1)), key=len)
            back = codecs.patched_decode(out)
        elif codec == "run_delta":
            out = codecs.run_delta_encode(v)
            back = codecs.run_delta_decode(out)
        elif codec == "gorilla":
            out = codecs.gorilla_encode(v)
            back = codecs.gorilla_decode(out)
        elif codec == "alp":
            raw = v.astype("<f8").tobytes()
            out = codecs.encode_plan(raw, "alp8")
            back = np.frombuffer(codecs.decode_plan(out, "alp8", len(raw)), "<f8")
        else:
            raw = v.astype(np.uint8).tobytes()
            out = codecs.encode_plan(raw, codec)
            back = np.frombuffer(codecs.decode_plan(out, codec, len(raw)), np.uint8).astype(v.dtype)
        same = v.view(np.uint64) == back.view(np.uint64) if v.dtype == np.float64 else v == back
        return pa.table({"block_id": [t.column("block_id")[0].as_py()], "n": [len(v)], "bytes": [len(out)], "ok": [bool(len(v) == len(back) and same.all())]})

    return rows.where(F.col("pos") < size).groupBy("block_id").applyInArrow(run, "block_id long, n long, bytes long, ok boolean")


def block_offsets(sizes: DataFrame) -> DataFrame:
    """Running original offsets of a file's blocks from their sizes."""
    before = Window.partitionBy("file_id").orderBy("block_id").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("original_offset", F.coalesce(F.sum("original_size").over(before), F.lit(0)))
