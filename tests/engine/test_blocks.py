import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from blockwright.functions import scalars
from blockwright.operators import dictionary, lanes, segments
from blockwright.sources import blocks
from blockwright.streaming import encoder

FILES = [("a", b"hello world " * 900), ("b", b""), ("c", bytes(range(256)) * 40), ("d", b"z" * 10001)]


@pytest.fixture(scope="module")
def stored(spark):
    files = spark.createDataFrame(FILES, "file_id string, data binary")
    return blocks.encode(blocks.chunk(files, 1000).withColumn("label", F.lit("lz_balanced+huffman"))).cache()


def test_round_trip_and_order(stored):
    data = {}
    for r in blocks.decode(stored).orderBy("file_id", "block_id").collect():
        assert r["error"] is None
        data[r["file_id"]] = data.get(r["file_id"], b"") + bytes(r["data"])
    assert data == {k: v for k, v in FILES if v}
    assert b"".join(blocks.stream_blocks(blocks.decode(stored))) == b"".join(v for _, v in FILES)
    assert stored.where("label = 'raw'").count() > 0  # what does not shrink stays raw


def test_partitions_do_not_matter(spark):
    files = spark.createDataFrame(FILES, "file_id string, data binary")
    cut = blocks.chunk(files, 700).withColumn("label", F.lit("rle+rans"))
    rows = [sorted(map(tuple, blocks.encode(cut.repartition(k)).collect()), key=lambda r: r[:2]) for k in (1, 4, 9)]
    assert rows[0] == rows[1] == rows[2]


@pytest.mark.parametrize(("first", "last"), [(0, 0), (0, 1), (999, 1001), (2500, 7777), (10799, 10800), (10000, 99999)])
def test_ranges(stored, first, last, tmp_path):
    got = b"".join(bytes(r["data"]) for r in blocks.read_range(stored, "a", first, last).orderBy("offset").collect())
    assert got == FILES[0][1][first:last]


def test_range_prunes(spark, stored, tmp_path):
    blocks.write(stored, str(tmp_path / "t"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = blocks.read_range(blocks.read(spark, str(tmp_path / "t")), "a", 10, 20)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PushedFilters: [" in plan and "LessThan(original_offset,20)" in plan


def test_damage(spark, stored):
    flipped = stored.withColumn("payload", F.when((F.col("file_id") == "c") & (F.col("block_id") == 2), F.encode(F.lit("nonsense"), "UTF-8")).otherwise(F.col("payload")))
    v = {r["file_id"]: (r["damaged"], r["complete"]) for r in blocks.verify(flipped).collect()}
    assert v["c"] == (1, True) and v["a"] == (0, True)
    assert {r["file_id"]: r["complete"] for r in blocks.verify(stored.where("not (file_id = 'a' and block_id = 3)")).collect()}["a"] is False


def test_inspect(stored):
    rows = blocks.inspect(stored).where("file_id is null and label is null").collect()
    assert rows[0]["raw"] == sum(len(v) for _, v in FILES)


def test_stream_equals_batch(spark, tmp_path):
    files = spark.createDataFrame([(f"f{i}", bytes([i]) * (500 * i)) for i in range(12)], "file_id string, data binary")
    files.repartition(6).write.parquet(str(tmp_path / "in"))
    total = sum(500 * i for i in range(12))
    n = encoder.encode_stream(spark, str(tmp_path / "in"), "file_id string, data binary", str(tmp_path / "out"), str(tmp_path / "log"), "rle", 512, 2, total)
    batch = blocks.encode(blocks.chunk(files, 512).withColumn("label", F.lit("rle")))
    assert n == batch.count()
    assert spark.read.parquet(str(tmp_path / "out")).drop("epoch").exceptAll(batch).count() == 0
    with pytest.raises(ValueError):
        encoder.encode_stream(spark, str(tmp_path / "in"), "file_id string, data binary", str(tmp_path / "out"), str(tmp_path / "log"), "rle", 512, 2, total + 1)


def test_dictionary(spark):
    rows = [(i, f'{{"user": "u{i}", "kind": "click", "page": "/home/index.html"}}') for i in range(40)]
    samples = spark.createDataFrame(rows, "id int, text string")
    data = dictionary.train(samples, "id", "text", size=256)
    assert 0 < len(data) <= 256 and b'"kind": "click"' in data
    assert dictionary.train(samples.repartition(7), "id", "text", size=256) == data
    assert dictionary.dictionary_id(b"") == 0xCBF29CE484222325 and dictionary.train(samples.limit(0), "id", "text") == b""


def test_scalars(spark):
    v = spark.createDataFrame([(x,) for x in (-5, -1, 0, 1, 7, 2**40, -(2**40))], "v long")
    for r in v.select("v", scalars.zigzag(F.col("v")).alias("z"), scalars.unzigzag(scalars.zigzag(F.col("v"))).alias("b"), scalars.bit_width(F.abs("v")).alias("w"), scalars.ring_delta(F.col("v"), 8).alias("r")).collect():
        assert r["b"] == r["v"] and r["w"] == abs(r["v"]).bit_length() and r["z"] == (2 * r["v"] if r["v"] >= 0 else -2 * r["v"] - 1) and r["r"] == (r["v"] + 128) % 256 - 128


def test_empty_and_null_lanes(spark):
    rows = lanes.lane(spark.createDataFrame([(0, 5), (1, None), (2, 9)], "k long, x long"), "k", "x", 10)
    assert [r["d"] for r in lanes.delta(rows).orderBy("pos").collect()] == [None, None, None]
    assert segments.segments(segments.window_classes(rows.limit(0), 4)).count() == 0


def test_stream_deals_blocks(spark, tmp_path):
    """A batch of one file is encoded by all cores, to the same blocks."""
    data = bytes(range(256)) * 200
    spark.createDataFrame([("a", data)], "file_id string, data binary").coalesce(1).write.parquet(str(tmp_path / "in"))
    n = encoder.encode_stream(spark, str(tmp_path / "in"), "file_id string, data binary", str(tmp_path / "out"), str(tmp_path / "log"), "rle", 1024)
    assert n == 50 and len(list((tmp_path / "out").glob("epoch=0/part-*"))) == spark.sparkContext.defaultParallelism
    assert b"".join(blocks.stream_blocks(blocks.decode(spark.read.parquet(str(tmp_path / "out"))))) == data


def test_batches_hold_few_bytes(spark):
    """Blocks come and go by the megabyte: no batch that a worker holds grows with the table."""
    blob = [bytes([k % 251, k % 13]) * 2048 for k in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(["a"] * 2000), pa.array(range(2000)), pa.array(range(2000)), pa.array([4096] * 2000, pa.int32()), pa.array(blob, pa.binary()), pa.array(["raw"] * 2000)], names=["file_id", "block_id", "original_offset", "original_size", "data", "label"])
    out = list(blocks._encode(iter([batch])))
    assert max(b.num_rows for b in out) == 256 and sum(b.num_rows for b in out) == 2000
    files = spark.range(0, 3000, 1, 1).select(F.col("id").cast("string").alias("file_id"), F.expr("cast(repeat('xy', 4096) as binary)").alias("data"))
    seen = blocks.small_batches(files).mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches), "n long").collect()
    assert max(r["n"] for r in seen) * 8192 <= blocks.BATCH + 8192
