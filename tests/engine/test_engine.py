import pytest
from pyspark.sql import functions as F

from blockwright.engine import Config, Engine, Limits
from blockwright.operators import estimate, profile
from blockwright.sources import blocks, corpus, records

FILES = [("json", b'{"id": 17, "name": "record", "value": 3.5}\n' * 300), ("zeros", bytes(9000)), ("ramp", bytes(range(256)) * 30), ("empty", b"")]


@pytest.mark.parametrize("kind", ["fast", "balanced", "dense"])
def test_compress_decompress(spark, kind):
    engine = Engine(Config(block_size=4096, profile=kind))
    files = spark.createDataFrame(FILES, "file_id string, data binary")
    stored = engine.compress(files).cache()
    assert {r["file_id"]: bytes(r["data"]) for r in engine.files(stored).collect()} == {k: v for k, v in FILES if v}
    total = engine.inspect(stored).where("file_id is null").first()
    assert total["bytes"] < total["raw"] / (1 if kind == "fast" else 3)
    assert engine.verify(stored).where("damaged > 0 or not complete").count() == 0
    labels = {(r["file_id"], r["block_id"]): r["label"] for r in engine.explain(files).collect()}
    assert len(labels) == stored.count()


def test_limits_and_config(spark):
    with pytest.raises(ValueError):
        Config(profile="best")
    with pytest.raises(ValueError):
        Config(block_size=0)
    assert Config(block_size=1000, schema=records.RecordSchema("u64,f32")).aligned == 996
    stored = blocks.encode(blocks.chunk(spark.createDataFrame(FILES[:1], "file_id string, data binary"), 4096).withColumn("label", F.lit("raw")))
    with pytest.raises(Exception, match="decode limits"):
        Engine(Config(block_size=512, limits=Limits(max_block_size=1024))).decompress(stored).collect()


def test_records(spark):
    schema = records.RecordSchema("ts:u64,price:f64,qty:u32,tag:b4,flag:i8")
    assert schema.record_size == 25 and schema.aligned(100) == 100 and schema.aligned(10) == 25
    rows = spark.createDataFrame([(i % 3, i, i * 0.5, i, f"t{i}".encode(), i % 7 - 3) for i in range(50)], "key long, ts long, price double, qty long, tag binary, flag byte")
    data = records.to_records(rows, schema, "key", ["ts"])
    back = records.from_records(data, schema)
    got = {(r["key"], r["ts"], r["price"], r["qty"], bytes(r["tag"]).rstrip(b"\0"), r["flag"]) for r in back.collect()}
    assert got == {(r["key"], r["ts"], r["price"], r["qty"], bytes(r["tag"]), r["flag"]) for r in rows.collect()}
    streams = records.split_columns(data.withColumn("data", F.concat("data", F.lit(b"xy"))), schema)
    again = {r["key"]: bytes(r["data"]) for r in records.join_columns(streams, schema).collect()}
    assert again == {r["key"]: bytes(r["data"]) + b"xy" for r in data.collect()}
    assert records.read_lanes(data, 8).where("pos = 0").count() == 3
    for bad in ("u7", "a:u8,a:u8", "b0", ""):
        with pytest.raises(ValueError):
            records.RecordSchema(bad)
    with pytest.raises(Exception, match="whole records"):
        records.from_records(data.withColumn("data", F.concat("data", F.lit(b"x"))), schema).collect()


@pytest.mark.parametrize("name", list(corpus.WORKLOADS))
def test_workloads(spark, name):
    lane = corpus.workload(spark, name, 6000)
    assert lane.count() == 6000
    if name.startswith("f64"):
        out = blocks.lane_payloads(lane, "gorilla", 4096)
    else:
        out = blocks.lane_payloads(lane, "num1", 4096)
        sizes = {r["block_id"]: r["bytes"] for r in estimate.best_mode(lane).collect()}
        assert {r["block_id"]: r["bytes"] for r in out.collect()} == sizes
    assert out.where("not ok").count() == 0


def test_routes_of_workloads(spark):
    steps = profile.fixed_step(corpus.workload(spark, "u64-fixed-step", 5000)).collect()
    assert [r["step"] for r in steps] == [1000, 1000]
    assert profile.fixed_step(corpus.workload(spark, "gauge-sawtooth", 9000)).where("block_id = 0").count() == 1
    assert profile.fixed_step(corpus.workload(spark, "random", 5000)).count() == 0


def test_bad_workload(spark):
    with pytest.raises(ValueError):
        corpus.workload(spark, "nope", 1)
