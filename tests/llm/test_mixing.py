import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from blockwright.llm import mixing
from plain import water_filling


def test_targets_and_copies(docs, rows):
    out = mixing.mix_plan(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, t, _, s, _ in rows:
        sizes[s] += size(t)
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    want = water_filling(sizes, {s: i % 3 + 1 for i, s in enumerate(order)})
    assert len(out) == len(rows)
    for r in out:
        assert r["size"] == size(r["text"]) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        rate = r["target"] / r["source_size"] if r["source_size"] else 0
        assert int(rate + 1e-9) <= r["copies"] <= int(rate) + 1


def test_rerun_and_rows(docs):
    plan = mixing.mix_plan(docs)
    a, b = (Counter((r["doc_id"], r["text"], r["copies"]) for r in plan.repartition(k).collect()) for k in (1, 5))
    assert a == b
    assert mixing.mixed(docs).count() == plan.agg(F.sum("copies")).first()[0]
    assert mixing.mixed(docs).columns == docs.columns


def test_near_target(spark):
    many = spark.range(30000).select(F.col("id").alias("doc_id"), F.lit("a b c d e").alias("text"), F.concat(F.lit("s"), F.when(F.col("id") < 10000, 0).otherwise(F.col("id") % 5)).alias("source"))
    per = mixing.mix_plan(many).groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("n")).collect()
    for r in per:
        assert abs(r["n"] - r["t"]) < 0.05 * r["t"]


def test_empty_clash_and_sql(spark, docs, empty, tmp_path):
    assert mixing.mix_plan(empty).count() == 0 and mixing.mixed(empty).count() == 0
    clash = docs.withColumn("rate", F.lit("x")).withColumn("size", F.lit("y")).withColumn("copies", F.lit("z"))
    assert mixing.mix_plan(clash).select("size", "copies").dtypes == [("size", "bigint"), ("copies", "bigint")]
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = Counter(con.sql(mixing.OP1_SQL).fetchall())
    assert Counter(map(tuple, mixing.op1_mixing(spark, str(tmp_path)).collect())) == want


def test_private_names(docs):
    """The mix gives the caller's columns back as they are, whatever their names."""
    clash = docs.withColumn("_copy", F.lit("a")).withColumn("_source", F.lit("b")).withColumn("rate", F.lit("c")).withColumn("a b.c", F.lit("d"))
    out = mixing.mixed(clash)
    assert out.columns == clash.columns and out.where("_copy = 'a' and _source = 'b' and rate = 'c' and `a b.c` = 'd'").count() == mixing.mixed(docs).count()
