"""Fixed-width records: a schema in short words, records to bytes and back, and columns of records as streams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_NUMPY = {"u8": "u1", "u16": "<u2", "u32": "<u4", "u64": "<u8", "i8": "i1", "i16": "<i2", "i32": "<i4", "i64": "<i8", "f32": "<f4", "f64": "<f8"}
_SPARK = {"u8": T.ShortType(), "u16": T.IntegerType(), "u32": T.LongType(), "u64": T.LongType(), "i8": T.ByteType(), "i16": T.ShortType(), "i32": T.IntegerType(), "i64": T.LongType(), "f32": T.FloatType(), "f64": T.DoubleType()}


class RecordSchema:
    """Columns from text such as "ts:u64,price:f64,tag:b4"; a u64 is carried as the bits of a bigint. No field may be null."""

    def __init__(self, text: str):
        self.fields: list[tuple[str, str]] = []
        for i, part in enumerate(p.strip() for p in text.split(",")):
            name, _, kind = part.rpartition(":")
            if kind not in _NUMPY and not re.fullmatch(r"b[1-9]\d*", kind):
                raise ValueError(f"{kind!r}: expected one of {', '.join(_NUMPY)} or bN")
            self.fields.append((name or f"c{i}", kind))
        if len({n for n, _ in self.fields}) != len(self.fields):
            raise ValueError("column names repeat")

    @property
    def dtype(self) -> np.dtype:
        return np.dtype([(n, _NUMPY.get(k) or f"S{k[1:]}") for n, k in self.fields])

    @property
    def record_size(self) -> int:
        return self.dtype.itemsize

    @property
    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(n, _SPARK.get(k, T.BinaryType())) for n, k in self.fields])

    def aligned(self, block_size: int) -> int:
        return max(block_size // self.record_size, 1) * self.record_size


def to_records(rows: DataFrame, schema: RecordSchema, key: str, order: list[str]) -> DataFrame:
    """(key, data): the rows of each key as consecutive records. A key is a block, so its rows are bounded by the block size."""
    names = [n for n, _ in schema.fields]

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([(o, "ascending") for o in order])
        out = np.zeros(t.num_rows, schema.dtype)
        for n, k in schema.fields:
            column = t.column(n)
            if column.null_count:
                raise ValueError(f"{n} holds nulls")
            if k.startswith("b"):
                out[n] = [v if len(v) <= int(k[1:]) else _too_long(n) for v in column.to_pylist()]
            else:
                v = column.to_numpy()
                out[n] = v.view(np.uint64) if k == "u64" else v
        return pa.table({"key": [t.column(key)[0].as_py()], "data": pa.array([out.tobytes()], pa.binary())})

    return rows.select(*{key: 0, **dict.fromkeys(names + order)}).groupBy(key).applyInArrow(run, f"key {dict(rows.dtypes)[key]}, data binary")


def _too_long(name: str):
    raise ValueError(f"{name}: value longer than its field")


def from_records(blocks: DataFrame, schema: RecordSchema) -> DataFrame:
    """(key, pos, fields...): the records of (key, data); a partial record raises ValueError."""
    kind = dict(blocks.dtypes)["key"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.struct.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, data in zip(b.column("key"), b.column("data"), strict=True):
                raw = data.as_buffer()
                if len(raw) % schema.record_size:
                    raise ValueError(f"{len(raw)} bytes are not whole records of {schema.record_size}")
                a = np.frombuffer(raw, schema.dtype)
                columns = [pa.array([key.as_py()] * len(a), b.column("key").type), pa.array(np.arange(len(a)))]
                for f, (n, k) in zip(schema.struct.fields, schema.fields, strict=True):
                    if k.startswith("b"):
                        width = int(k[1:])
                        columns.append(pa.array([bytes(v).ljust(width, b"\0") for v in a[n]], pa.binary()))
                    else:
                        columns.append(pa.array(a[n].view(np.int64) if k == "u64" else a[n]).cast({"smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "tinyint": pa.int8(), "float": pa.float32(), "double": pa.float64()}[f.dataType.simpleString()]))
                yield pa.RecordBatch.from_arrays(columns, names=["key", "pos", *schema.struct.names])

    return blocks.select("key", "data").mapInArrow(run, f"key {kind}, pos long, {fields}")


def split_columns(blocks: DataFrame, schema: RecordSchema) -> DataFrame:
    """(key, column, stream): all bytes of one column, record by record; what is left past whole records is column -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, data in zip(b.column("key"), b.column("data"), strict=True):
                raw = data.as_buffer()
                whole = len(raw) // schema.record_size * schema.record_size
                a = np.frombuffer(raw, schema.dtype, count=whole // schema.record_size)
                streams = [np.ascontiguousarray(a[n]).tobytes() for n, _ in schema.fields]
                yield pa.RecordBatch.from_pydict({"key": pa.array([key.as_py()] * (len(streams) + 1), b.column("key").type), "column": pa.array([*range(len(streams)), -1], pa.int32()), "stream": pa.array([*streams, bytes(raw)[whole:]], pa.binary())})

    return blocks.select("key", "data").mapInArrow(run, f"key {dict(blocks.dtypes)['key']}, column int, stream binary")


def join_columns(streams: DataFrame, schema: RecordSchema) -> DataFrame:
    """The inverse of ``split_columns``: (key, data)."""

    def run(t: pa.Table) -> pa.Table:
        by = dict(zip(t.column("column").to_pylist(), t.column("stream").to_pylist(), strict=True))
        widths = [schema.dtype.fields[n][0].itemsize for n, _ in schema.fields]
        counts = {len(by[i]) // w for i, w in enumerate(widths)}
        if len(counts) != 1 or any(len(by[i]) % w for i, w in enumerate(widths)):
            raise ValueError("column streams differ in length")
        out = np.zeros(counts.pop(), schema.dtype)
        for i, (n, _) in enumerate(schema.fields):
            out[n] = np.frombuffer(by[i], schema.dtype.fields[n][0])
        return pa.table({"key": t.column("key")[:1], "data": pa.array([out.tobytes() + by.get(-1, b"")], pa.binary())})

    return streams.groupBy("key").applyInArrow(run, f"key {dict(streams.dtypes)['key']}, data binary")


def read_lanes(blocks: DataFrame, width: int) -> DataFrame:
    """(key, pos, v): little-endian unsigned values of 1, 2 or 4 bytes, or the bits of 8; tails are dropped."""
    kind = {1: "u1", 2: "<u2", 4: "<u4", 8: "<i8"}[width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, data in zip(b.column("key"), b.column("data"), strict=True):
                raw = data.as_buffer()
                v = np.frombuffer(raw, kind, count=len(raw) // width).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(v), b.column("key").type), pa.array(np.arange(len(v))), pa.array(v)], names=["key", "pos", "v"])

    return blocks.select("key", "data").mapInArrow(run, f"key {dict(blocks.dtypes)['key']}, pos long, v long")


def write_lanes(rows: DataFrame, width: int) -> DataFrame:
    """(block_id, data): the values of each block of a lane (block_id, pos, v) in order, little-endian at ``width`` bytes;
    integers wrap, doubles are their bits at 8 and floats at 4 bytes."""
    real = dict(rows.dtypes)["v"] in ("double", "float")
    if width not in ((4, 8) if real else (1, 2, 4, 8)):
        raise ValueError(f"width {width}")

    def run(t: pa.Table) -> pa.Table:
        v = t.sort_by("pos").column("v").to_numpy()
        data = v.astype(f"<f{width}") if real else v.astype("<i8").view("<u8").astype(f"<u{width}")
        return pa.table({"block_id": [t.column("block_id")[0].as_py()], "data": pa.array([data.tobytes()], pa.binary())})

    return rows.groupBy("block_id").applyInArrow(run, f"block_id {dict(rows.dtypes)['block_id']}, data binary")
