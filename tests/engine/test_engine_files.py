import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockwright.__main__ import main
from blockwright.engine import Config, Engine, Limits
from blockwright.sources import blocks, records
from blockwright.streaming import encoder

TEXT = b"".join(b'{"id": %d, "name": "user-%d", "active": true}\n' % (i, i * 7 % 101) for i in range(900))
LANES = {"times": (1780000000000 + 1000 * np.arange(6000) + np.arange(6000) % 3).astype("<u8").tobytes(), "text": TEXT, "price": (np.round(100 + np.arange(5000) % 700 / 100, 2)).tobytes()}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in LANES.items()], "file_id string, data binary")


def test_stats_and_explain(files):
    engine = Engine(Config(block_size=16384))
    stored = engine.compress_with_stats(files).cache()
    s = engine.stats(stored)
    assert s["raw"] == sum(map(len, LANES.values())) and s["bytes"] < s["raw"] / 4 and s["blocks"] == sum(s["label"].values()) == sum(s["route"].values())
    assert {r["label"] for r in stored.where("file_id = 'times'").collect()} == {"num1"}
    plans = engine.explain(files, exhaustive=True).collect()
    assert all(r["candidates"] or r["reason"] in ("fixed-step", "fast-path", "dominant-float") for r in plans)
    assert all(r["best_size"] <= r["plan_size"] for r in plans if r["plan_size"] is not None)
    assert json.loads(plans[0]["profile"])["size"] == plans[0]["original_size"]
    assert {r["file_id"]: bytes(r["data"]) for r in engine.files(stored).collect()} == LANES
    assert engine.decode_block(stored, "text", 0) == TEXT[:16384]
    part = engine.read_range(stored, "times", 16000, 17000).orderBy("block_id").collect()
    assert b"".join(bytes(r["data"]) for r in part) == LANES["times"][16000:17000]
    with pytest.raises(ValueError):
        Engine(Config(limits=Limits(max_range=10))).read_range(stored, "times", 0, 100)


def test_dictionaries(spark, files):
    texts = spark.createDataFrame([(f"t{i}", bytearray(TEXT[i * 2000 : i * 2000 + 2000])) for i in range(1, 15)], "file_id string, data binary")
    own = TEXT[:1500]
    engine = Engine(Config(dictionary=own))
    stored, used = engine.compress_embedded(texts)
    assert used == own and stored.where("label like 'dict%'").count() > 0
    assert engine.verify(stored).where("damaged > 0").count() == 0
    assert Engine().decompress(stored).where("error like 'dictionary%missing'").count() > 0
    assert Engine(dictionaries=[own]).verify(stored).where("damaged > 0").count() == 0
    plain, none = Engine(Config(dictionary=bytes(range(256)) * 8)).compress_embedded(texts)
    assert none == b"" and plain.where("label like 'dict%'").count() == 0


def test_containers(spark):
    rng = np.random.default_rng(3)
    rows = np.zeros(3000, np.dtype([("ts", "<u8"), ("tag", "S4")]))
    rows["ts"], rows["tag"] = 10**12 + 50 * np.arange(3000), b"abcd"
    files = spark.createDataFrame([("records", bytearray(rows.tobytes()))], "file_id string, data binary")
    engine = Engine(Config(block_size=20000, schema=records.RecordSchema("ts:u64,tag:b4")))
    stored = engine.compress_with_stats(files).cache()
    assert {r["label"] for r in stored.collect()} == {"col"} and {len(r["inner"]) for r in stored.collect()} == {2}
    assert bytes(engine.files(stored).first()["data"]) == rows.tobytes()
    mixed = bytes(100_000) + TEXT * 3 + rng.bytes(100_000)
    engine = Engine(Config(block_size=1 << 20, segment=16384, segment_window=16384))
    stored = engine.compress(spark.createDataFrame([("mixed", bytearray(mixed))], "file_id string, data binary"))
    assert stored.first()["label"] == "seg" and bytes(engine.files(stored).first()["data"]) == mixed


def test_recommended_size(files):
    assert Engine(Config(None)).recommended(files.where("file_id = 'times'")) == 1 << 20
    assert Engine(Config(None, access="random")).recommended(files) == 1 << 18
    assert Engine(Config(None, access="sequential")).recommended(files.where("file_id = 'text'")) == 1 << 19
    assert Engine(Config(None)).compress(files).count() == 3


def test_streams(spark, files, tmp_path):
    engine = Engine(Config(block_size=8192))
    blocks.write(engine.compress(files), str(tmp_path / "stored"))
    n = engine.decompress_stream(spark, str(tmp_path / "stored"), str(tmp_path / "back"), str(tmp_path / "checkpoint"))
    back = spark.read.parquet(str(tmp_path / "back"))
    assert n == back.count() and back.where("error is not null").count() == 0
    got = {k: b"".join(bytes(r["data"]) for r in back.where(F.col("file_id") == k).orderBy("block_id").collect()) for k in LANES}
    assert got == LANES


def test_lanes_round_trip(spark):
    rows = spark.range(100).select((F.col("id") / 40).cast("long").alias("block_id"), (F.col("id") % 40).alias("pos"), (F.col("id") * 3 - 50).alias("v"))
    packed = records.write_lanes(rows, 8)
    back = records.read_lanes(packed.withColumnRenamed("block_id", "key"), 8)
    assert sorted(map(tuple, back.select("key", "pos", "v").collect())) == sorted(map(tuple, rows.collect()))
    with pytest.raises(ValueError):
        records.write_lanes(rows, 3)


def test_command_line(spark, tmp_path, capfdbinary):
    folder = tmp_path / "in"
    folder.mkdir()
    for k, v in LANES.items():
        (folder / k).write_bytes(v)
    (folder / "damaged").write_bytes(TEXT[:500])
    out = str(tmp_path / "out")
    assert main(["compress", str(folder), out, "--block-size", "16384"], spark) == 0
    assert main(["verify", out], spark) == 0
    capfdbinary.readouterr()
    assert main(["read-range", out, "text", "100", "20000"], spark) == 0
    assert capfdbinary.readouterr().out == TEXT[100:20000]
    assert main(["decode-block", out, "times", "1"], spark) == 0
    assert capfdbinary.readouterr().out == LANES["times"][16384:32768]
    assert main(["explain", str(folder)], spark) == 0
    assert len(capfdbinary.readouterr().out.splitlines()) == 4
    assert main(["decompress", out, str(tmp_path / "data")], spark) == 0
    assert spark.read.parquet(str(tmp_path / "data")).agg(F.sum(F.octet_length("data"))).first()[0] == sum(map(len, LANES.values())) + 500
    (tmp_path / "lines").write_bytes(TEXT)
    capfdbinary.readouterr()
    assert main(["train", str(tmp_path / "lines"), str(tmp_path / "store"), "--size", "512"], spark) == 0
    name = capfdbinary.readouterr().out.decode().strip()
    assert main(["compress", str(folder / "damaged"), str(tmp_path / "with"), "--dictionaries", str(tmp_path / "store"), "--dictionary", name], spark) == 0
    assert main(["verify", str(tmp_path / "with"), "--dictionaries", str(tmp_path / "store")], spark) == 0
    assert main(["version"], spark) == 0
    broken = blocks.read(spark, out).withColumn("payload", F.when(F.col("file_id") == "damaged", F.lit(b"xx").cast("binary")).otherwise(F.col("payload")))
    broken.write.parquet(str(tmp_path / "broken"))
    assert main(["verify", str(tmp_path / "broken")], spark) == 1


def test_windows(spark):
    """Tumbling, sliding and session windows, on a table as on a stream."""
    rows = [(f"2024-01-01 00:{m:02d}:00", "a", float(m)) for m in (0, 5, 20, 21, 50)]
    events = spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    counts = lambda out: sorted(r["n"] for r in out.collect())
    assert counts(encoder.windowed_counts(events, window="30 minutes")) == [1, 4]
    assert counts(encoder.windowed_counts(events, window="20 minutes", slide="10 minutes")) == [1, 1, 2, 2, 2, 2]
    assert counts(encoder.session_counts(events, "10 minutes")) == [1, 2, 2]
