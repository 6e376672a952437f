"""Every query of the engine against its SQL, on the smallest tables."""

import math
import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from blockwright import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) and math.isfinite(v) else v


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    out = catalog.QUERIES[name](spark, SF)
    rows = out.collect()
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    found = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(out.columns) == sorted(found.columns)
    at = [found.columns.index(c) for c in out.columns]
    want = Counter(tuple(plain(r[i]) for i in at) for r in found.fetchall())
    assert Counter(tuple(plain(v) for v in r) for r in rows) == want


@pytest.mark.parametrize("name", ["engine_float_plan", "engine_numeric_plan", "engine_fixed_step"])
def test_engine_blocks_once(spark, name):
    """Blocks are encoded once and checked once, and nothing is joined."""
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "Join" not in plan


def test_entropy_h1_in_place(spark, duck):
    """No row per byte pair: nothing is aggregated in a task's memory or shuffled by block; blocks of one byte have no row."""
    out = catalog.QUERIES["entropy_h1"](spark, SF)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Window" not in plan
    few = spark.createDataFrame([(1, bytearray(b"a")), (2, bytearray(b"")), (3, bytearray(b"ab")), (4, None)], "block_id long, data binary")
    from blockwright.operators import profile

    assert [tuple(r) for r in profile.sampled_entropy_h1(few).collect()] == [(3, 0.0)]


def test_tiers_in_one_pass(spark):
    """Blocks are profiled once for all tiers, and the choice is that of each tier alone, ties included."""
    assert catalog.QUERIES["tier_plan"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    from blockwright.operators import profile
    from blockwright.plans import planner

    estimates = planner.estimated(profile.block_profile(catalog._texts(spark, SF)), planner.candidates(spark))
    tied = estimates.withColumn("estimate", F.floor(F.col("estimate") / 4096)).withColumn("encode", F.lit(1).cast("long")).withColumn("decode", F.lit(1).cast("long"))
    for x in (estimates, tied):
        got = {tuple(r) for r in planner.selected_by_tier(x, {"a": "fast", "b": "dense"}).select("tier", "block_id", "plan", "label").collect()}
        want = {(t, *r) for t, p in (("a", "fast"), ("b", "dense")) for r in planner.selected(planner.scored(x, p)).select("block_id", "plan", "label").collect()}
        assert got == want
