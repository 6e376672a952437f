"""Every query of the engine by name, with the SQL that must give the same rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwright.functions import scalars as S
from blockwright.operators import dictionary, estimate, lanes, profile, ranges, segments, telemetry
from blockwright.plans import planner, policies
from blockwright.sources import spread

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _keys(s, d):
    return lanes.lane(_table(s, d, "orders"), "o_orderkey", "o_orderkey", 4096)


def _customers(s, d):
    return lanes.lane(_table(s, d, "orders"), "o_orderkey", "o_custkey", 2048)


def _users(s, d):
    return lanes.lane(_table(s, d, "events"), "event_id", "user_id", 2048)


def _times(s, d):
    return lanes.lane(_table(s, d, "events"), "event_id", lanes.micros("ts"), 2048)


def _values(s, d):
    return lanes.lane(spread(_table(s, d, "events").select("event_id", "value")), "event_id", "value", 2048)


def _kinds(s, d):
    return lanes.lane(_table(s, d, "events"), "event_id", "cast(ascii(event_type) as bigint)", 2048)


def _bytes(s, d):
    return lanes.byte_lane(spread(_table(s, d, "documents").select("doc_id", "text")), "doc_id", "text")


def _texts(s, d):
    return spread(_table(s, d, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("block_id"), F.encode("text", "UTF-8").alias("data"))


def _byte_blocks(s, d):
    return lanes.byte_blocks(spread(_table(s, d, "documents").select("doc_id", "text")), "doc_id", text="text")


def _lane_sql(table: str, key: str, value: str, size: int) -> str:
    return f"l AS (SELECT {key} // {size} AS block_id, {key} % {size} AS pos, {value} AS v FROM {table})"


KEYS = _lane_sql("orders", "o_orderkey", "o_orderkey", 4096)
CUSTOMERS = _lane_sql("orders", "o_orderkey", "o_custkey", 2048)
USERS = _lane_sql("events", "event_id", "user_id", 2048)
TIMES = _lane_sql("events", "event_id", "epoch_us(ts)", 2048)
VALUES = _lane_sql("events", "event_id", "value", 2048)
KINDS = _lane_sql("events", "event_id", "ascii(event_type)::BIGINT", 2048)
BYTES = """h AS (SELECT doc_id AS block_id, hex(encode(text)) AS h FROM documents WHERE strlen(text) > 0),
l AS (SELECT block_id, i - 1 AS pos, ('0x' || substr(h, 2 * i::INT - 1, 2))::BIGINT AS v FROM (SELECT block_id, h, unnest(range(1, length(h) // 2 + 1)) AS i FROM h))"""
D = """d1 AS (SELECT *, v - lag(v) OVER (PARTITION BY block_id ORDER BY pos) AS d FROM l),
d AS (SELECT *, d - lag(d) OVER (PARTITION BY block_id ORDER BY pos) AS dd, lag(d) OVER (PARTITION BY block_id ORDER BY pos) AS pd FROM d1)"""
RUNS = """m AS (SELECT *, CASE WHEN v IS NOT DISTINCT FROM lag(v) OVER w AND lag(pos) OVER w IS NOT NULL THEN 0 ELSE 1 END AS new FROM l WINDOW w AS (PARTITION BY block_id ORDER BY pos)),
r0 AS (SELECT *, sum(new) OVER (PARTITION BY block_id ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM m),
r AS (SELECT block_id, run, min(pos) AS start, count(*) AS length, first(v) AS v FROM r0 GROUP BY block_id, run)"""


def _zz(x: str) -> str:
    return f"(CASE WHEN {x} >= 0 THEN 2 * {x} ELSE -2 * {x} - 1 END)"


def _bw(x: str) -> str:
    return f"(CASE WHEN {x} = 0 THEN 0 ELSE length(bin({x})) END)"


def _share(c: str) -> str:
    return f"avg(CASE WHEN {c} THEN 1.0::DOUBLE WHEN NOT ({c}) THEN 0.0::DOUBLE END)"


MODES = f"""{D},
s AS (SELECT block_id, count(*) AS n, {_bw('max(v) - min(v)')} AS w1, {_bw('coalesce(max(' + _zz('d') + '), 0)')} AS w2, {_bw('coalesce(max(' + _zz('dd') + '), 0)')} AS w3 FROM d GROUP BY block_id),
e AS (SELECT block_id, n, unnest([1, 2, 3]) AS mode, unnest([w1, w2, w3])::BIGINT AS width FROM s),
b AS (SELECT block_id, n, mode, width, (40 + ceil(greatest(n - (mode - 1), 0) * width / 8.0))::BIGINT AS bytes FROM e)"""


@_query("num1_best_mode", f"WITH {KEYS}, {MODES} SELECT block_id, n, mode, width, bytes FROM b QUALIFY row_number() OVER (PARTITION BY block_id ORDER BY bytes, mode) = 1")
def num1_best_mode(s, d):
    return estimate.best_mode(_keys(s, d))


@_query("num1_every_mode", f"WITH {CUSTOMERS}, {MODES} SELECT block_id, n, mode, width, bytes FROM b")
def num1_every_mode(s, d):
    return estimate.every_mode(_customers(s, d))


@_query("num1_timestamps", f"WITH {TIMES}, {MODES} SELECT block_id, n, mode, width, bytes FROM b QUALIFY row_number() OVER (PARTITION BY block_id ORDER BY bytes, mode) = 1")
def num1_timestamps(s, d):
    return estimate.best_mode(_times(s, d))


@_query("lane_delta", f"WITH {CUSTOMERS}, {D} SELECT block_id, pos, v, d FROM d1")
def lane_delta(s, d):
    return lanes.delta(_customers(s, d))


@_query("lane_dod", f"WITH {TIMES}, {D} SELECT block_id, pos, d, dd FROM d")
def lane_dod(s, d):
    return lanes.delta_of_delta(_times(s, d)).select("block_id", "pos", "d", "dd")


@_query("zigzag_bits", f"WITH {CUSTOMERS}, {D} SELECT block_id, max({_zz('d')})::BIGINT AS most, {_bw('max(' + _zz('d') + ')')}::BIGINT AS bits, bit_or({_zz('d')})::BIGINT AS ored FROM d GROUP BY block_id")
def zigzag_bits(s, d):
    z = S.zigzag(F.col("d"))
    return lanes.delta(_customers(s, d)).groupBy("block_id").agg(F.max(z).alias("most"), S.bit_width(F.max(z)).alias("bits"), F.bit_or(z).alias("ored"))


@_query("zigzag_roundtrip", f"WITH {USERS}, {D} SELECT block_id, count(d) AS n, count(d) AS same FROM d GROUP BY block_id")
def zigzag_roundtrip(s, d):
    back = S.unzigzag(S.zigzag(F.col("d")))
    return lanes.delta(_users(s, d)).groupBy("block_id").agg(F.count("d").alias("n"), F.count_if(back == F.col("d")).alias("same"))


@_query("for_offsets", f"WITH {CUSTOMERS} SELECT block_id, pos, min(v) OVER (PARTITION BY block_id) AS base, v - min(v) OVER (PARTITION BY block_id) AS \"offset\" FROM l")
def for_offsets(s, d):
    return lanes.frame_of_reference(_customers(s, d)).select("block_id", "pos", "base", "offset")


@_query("undelta_roundtrip", f"WITH {CUSTOMERS} SELECT block_id, count(*) AS n, count(*) AS same FROM l GROUP BY block_id")
def undelta_roundtrip(s, d):
    return lanes.undelta(lanes.delta(_customers(s, d))).groupBy("block_id").agg(F.count("*").alias("n"), F.count_if(F.col("back") == F.col("v")).alias("same"))


@_query("undod_roundtrip", f"WITH {TIMES} SELECT block_id, count(*) AS n, count(*) AS same FROM l GROUP BY block_id")
def undod_roundtrip(s, d):
    return lanes.undelta_of_delta(lanes.delta_of_delta(_times(s, d))).groupBy("block_id").agg(F.count("*").alias("n"), F.count_if(F.col("back") == F.col("v")).alias("same"))


@_query("u16_ring_delta", f"WITH {_lane_sql('orders', 'o_orderkey', '(o_orderkey * 7919) % 65536', 4096)}, {D} SELECT block_id, pos, ((d + 32768) % 65536 + 65536) % 65536 - 32768 AS d FROM d1")
def u16_ring_delta(s, d):
    return lanes.ring_deltas(lanes.lane(_table(s, d, "orders"), "o_orderkey", "(o_orderkey * 7919) % 65536", 4096), 16).select("block_id", "pos", "d")


@_query("byte_delta", f"WITH {KINDS} SELECT block_id, pos, ((v - coalesce(lag(v) OVER (PARTITION BY block_id ORDER BY pos), 0)) % 256 + 256) % 256 AS d FROM l")
def byte_delta(s, d):
    return lanes.byte_delta(_kinds(s, d)).select("block_id", "pos", "d")


@_query("byte_delta_roundtrip", f"WITH {KINDS} SELECT block_id, count(*) AS n, count(*) AS same FROM l GROUP BY block_id")
def byte_delta_roundtrip(s, d):
    return lanes.byte_undelta(lanes.byte_delta(_kinds(s, d))).groupBy("block_id").agg(F.count("*").alias("n"), F.count_if(F.col("back") == F.col("v")).alias("same"))


@_query("byte_histogram", f"WITH {BYTES} SELECT block_id, v AS value, count(*) AS n FROM l GROUP BY ALL")
def byte_histogram(s, d):
    return profile.histogram(_bytes(s, d))


H0 = "SELECT block_id, round(sum(-p * log2(p)), 6) AS {1} FROM (SELECT block_id, n / sum(n) OVER (PARTITION BY block_id) AS p FROM {0}) GROUP BY block_id"


@_query("entropy_h0", f"WITH {BYTES}, c AS (SELECT block_id, v, count(*) AS n FROM l GROUP BY ALL) {H0.format('c', 'h0')}")
def entropy_h0(s, d):
    return profile.entropy(profile.histogram(_bytes(s, d)), "h0")


@_query("entropy_h1", f"""WITH {BYTES}, p AS (SELECT *, lag(v) OVER (PARTITION BY block_id ORDER BY pos) AS prev FROM l),
j AS (SELECT block_id, prev, v, count(*) AS n FROM p WHERE prev IS NOT NULL AND (pos - 1) % 8 = 0 GROUP BY ALL),
b AS (SELECT block_id, -(n / sum(n) OVER (PARTITION BY block_id)) * log2(n / sum(n) OVER (PARTITION BY block_id, prev)) AS bits FROM j)
SELECT block_id, round(sum(bits), 6) AS h1 FROM b GROUP BY block_id""")
def entropy_h1(s, d):
    return profile.sampled_entropy_h1(_texts(s, d))


@_query("run_stats", f"WITH {KINDS}, {RUNS} SELECT block_id, count(*) FILTER (length >= 4) AS runs, coalesce(sum(length) FILTER (length >= 4), 0)::BIGINT AS run_bytes, max(length) AS longest FROM r GROUP BY block_id")
def run_stats(s, d):
    return profile.run_stats(_kinds(s, d))


@_query("lane_runs", f"WITH {KINDS}, {RUNS} SELECT block_id, run, start, length, v FROM r")
def lane_runs(s, d):
    return lanes.runs(_kinds(s, d))


REPETITION = """q AS (SELECT block_id, pos, v + 256 * lead(v, 1) OVER w + 65536 * lead(v, 2) OVER w + 16777216 * lead(v, 3) OVER w AS word FROM l WINDOW w AS (PARTITION BY block_id ORDER BY pos)),
q1 AS (SELECT *, (((word::HUGEINT * 2654435761) % 4294967296) // 1048576) % 4096 AS slot FROM q WHERE pos % 16 = 0 AND word IS NOT NULL),
q2 AS (SELECT block_id, pos, lag(pos) OVER (PARTITION BY block_id, slot ORDER BY pos) AS prev, coalesce(lag(word) OVER (PARTITION BY block_id, slot ORDER BY pos) = word, false) AS hit FROM q1),
q3 AS (SELECT q2.block_id, h, pos, prev, least(64, length(h) // 2 - pos, pos - prev) AS room FROM q2 JOIN h USING (block_id) WHERE hit),
q4 AS (SELECT block_id, sum(coalesce(list_min(list_filter(range(4, room), lambda k: substr(h, (2 * (pos + k) + 1)::INT, 2) <> substr(h, (2 * (prev + k) + 1)::INT, 2))), room))::BIGINT AS matched FROM q3 GROUP BY block_id),
rep AS (SELECT block_id, probes, hits, coalesce(matched, 0) AS matched FROM (SELECT block_id, count(*) AS probes, count(*) FILTER (hit) AS hits FROM q2 GROUP BY block_id) LEFT JOIN q4 USING (block_id))"""


@_query("repetition_hits", f"WITH {BYTES}, {REPETITION} SELECT block_id, probes, hits FROM rep")
def repetition_hits(s, d):
    return profile.repetition_hits(_byte_blocks(s, d))


PROFILE = f"""{BYTES}, c AS (SELECT block_id, v AS value, count(*) AS n FROM l GROUP BY ALL),
bd AS (SELECT block_id, ((v - coalesce(lag(v) OVER (PARTITION BY block_id ORDER BY pos), 0)) % 256 + 256) % 256 AS d FROM l),
cd AS (SELECT block_id, d, count(*) AS n FROM bd GROUP BY ALL),
basic AS (SELECT block_id, sum(n)::BIGINT AS size, count(*) AS unique_bytes, coalesce(sum(n) FILTER (value = 0), 0)::BIGINT AS zeros FROM c GROUP BY block_id),
e0 AS ({H0.format('c', 'h0')}), e1 AS ({H0.format('cd', 'h_delta')}), {RUNS},
rs AS (SELECT block_id, count(*) FILTER (length >= 4) AS runs, coalesce(sum(length) FILTER (length >= 4), 0)::BIGINT AS run_bytes, max(length) AS longest FROM r GROUP BY block_id),
{REPETITION},
p0 AS (SELECT block_id, size, h0, coalesce(h1, 0.0) AS h1, round(zeros / size, 6) AS zero_ratio, unique_bytes, runs, longest, round(run_bytes / size, 6) AS run_score,
       round(greatest(h0 - h_delta, 0.0) / 8, 6) AS delta_score, round(coalesce(hits / probes, 0.0), 6) AS repetition,
       round(CASE WHEN coalesce(hits, 0) > 0 THEN matched / hits ELSE 0.0 END, 6) AS match_length
       FROM basic JOIN e0 USING (block_id) JOIN e1 USING (block_id) JOIN rs USING (block_id) LEFT JOIN rep USING (block_id) LEFT JOIN ({ORACLE_SQL["entropy_h1"]}) USING (block_id)),
prof AS (SELECT *, round(least(greatest(0.72::DOUBLE * h0 / 8 + 0.28::DOUBLE * (1 - greatest(run_score, delta_score, repetition)), 0.0), 1.0), 4) AS incompressibility FROM p0)"""


@_query("block_profile", f"WITH {PROFILE} SELECT * FROM prof")
def block_profile(s, d):
    return profile.block_profile(_texts(s, d))


def _prefilter_sql(lane: str) -> str:
    return f"""{lane}, {D},
t AS (SELECT block_id, count(*) AS n, {_share('d >= 0')} AS monotonic, {_share('d <> 0')} AS nonzero, {_share(_bw(_zz('d')) + ' <= 20')} AS small, coalesce({_share('d = pd')}, 0.0) AS constant FROM d WHERE pos < 1024 GROUP BY block_id),
pf0 AS (SELECT *, round(least(0.10::DOUBLE + 0.30::DOUBLE * monotonic + 0.25::DOUBLE * small + 0.30::DOUBLE * constant + 0.20::DOUBLE * nonzero, 1.0), 6) AS confidence FROM t WHERE n >= 2),
pf AS (SELECT block_id, confidence, round(monotonic, 6) AS monotonic, round(nonzero, 6) AS nonzero, round(small, 6) AS small, round(constant, 6) AS constant,
       confidence >= 0.72 AND monotonic >= 0.8 AND nonzero >= 0.1 AND small >= 0.8 AS likely, confidence >= 0.995 AND least(monotonic, nonzero, small, constant) >= 0.999 AS strong FROM pf0),
fs0 AS (SELECT block_id, min_by(v, pos) AS first_value, min(d) AS step, max(d) AS top, count(*) AS n FROM d GROUP BY block_id),
fs AS (SELECT block_id, first_value, step, n FROM fs0 WHERE n >= 16 AND step = top AND step > 0)"""


@_query("numeric_prefilter", f"WITH {_prefilter_sql(USERS)} SELECT * FROM pf")
def numeric_prefilter(s, d):
    return profile.numeric_prefilter(_users(s, d))


@_query("fixed_step_evidence", f"WITH {_prefilter_sql(KEYS)} SELECT * FROM fs")
def fixed_step_evidence(s, d):
    return profile.fixed_step(_keys(s, d))


def _p95(source: str, name: str) -> str:
    return f"""SELECT block_id, min(width) AS {name} FROM (SELECT block_id, width, sum(n) OVER (PARTITION BY block_id ORDER BY width ROWS UNBOUNDED PRECEDING) >= floor((sum(n) OVER (PARTITION BY block_id) - 1) * 95 / 100) + 1 AS reached FROM {source}) WHERE reached GROUP BY block_id"""


@_query("width_p95", f"WITH {TIMES}, {D}, w AS (SELECT block_id, {_bw(_zz('d'))}::BIGINT AS width, count(*) AS n FROM d WHERE d IS NOT NULL GROUP BY ALL) {_p95('w', 'p95')}")
def width_p95(s, d):
    return profile.percentile_width(profile.width_histogram(lanes.delta(_times(s, d)), "d"), 95, "p95")


NUMERIC = f"""{TIMES}, {D}, wd AS (SELECT block_id, {_bw(_zz('d'))}::BIGINT AS width, count(*) AS n FROM d WHERE d IS NOT NULL AND pos < 4096 GROUP BY ALL),
wdd AS (SELECT block_id, {_bw(_zz('dd'))}::BIGINT AS width, count(*) AS n FROM d WHERE dd IS NOT NULL AND pos < 4096 GROUP BY ALL),
pd AS ({_p95('wd', 'delta_p95')}), pdd AS ({_p95('wdd', 'dod_p95')}),
ov AS (SELECT block_id, coalesce(sum(n) FILTER (width > delta_p95), 0) / sum(n) AS exceptions FROM wd JOIN pd USING (block_id) GROUP BY block_id),
t AS (SELECT block_id, count(*) AS n, {_share('d >= 0')} AS monotonic, {_share('d = 0')} AS delta_zero, {_share(_bw(_zz('d')) + ' <= 8')} AS delta_small, {_share('dd = 0')} AS dod_zero, {_share(_bw(_zz('dd')) + ' <= 8')} AS dod_small FROM d WHERE pos < 4096 GROUP BY block_id HAVING count(*) >= 16),
num AS (SELECT block_id, n, round(least(0.15::DOUBLE + 0.30::DOUBLE * monotonic + 0.25::DOUBLE * delta_small + 0.20::DOUBLE * dod_small + CASE WHEN delta_p95 <= 20 THEN 0.25::DOUBLE WHEN delta_p95 <= 32 THEN 0.10::DOUBLE ELSE 0.0::DOUBLE END, 1.0), 6) AS confidence,
round(monotonic, 6) AS monotonic, round(delta_zero, 6) AS delta_zero, round(delta_small, 6) AS delta_small, round(dod_zero, 6) AS dod_zero, round(dod_small, 6) AS dod_small, round(exceptions, 6) AS exceptions, delta_p95, dod_p95
FROM t JOIN pd USING (block_id) JOIN pdd USING (block_id) JOIN ov USING (block_id))"""


@_query("numeric_profile", f"WITH {NUMERIC} SELECT * FROM num")
def numeric_profile(s, d):
    return profile.numeric_profile(_times(s, d))


WINDOWS = """z AS (SELECT *, count(*) OVER (PARTITION BY block_id) AS n FROM l), z1 AS (SELECT *, least(64, n) AS wl FROM z),
z2 AS (SELECT * FROM z1 WHERE (pos >= least(0, n - wl) AND pos < least(0, n - wl) + wl) OR (pos >= least(n // 3, n - wl) AND pos < least(n // 3, n - wl) + wl)
       OR (pos >= least(2 * n // 3, n - wl) AND pos < least(2 * n // 3, n - wl) + wl) OR (pos >= n - wl)),
z3 AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY block_id ORDER BY pos) = 1 THEN 0 ELSE 1 END AS gap FROM z2),
z4 AS (SELECT *, sum(gap) OVER (PARTITION BY block_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS win FROM z3),
z5 AS (SELECT *, lag(v) OVER (PARTITION BY block_id, win ORDER BY pos) AS prev FROM z4)"""


@_query("run_prefilter", f"""WITH {USERS}, {WINDOWS}, t AS (SELECT block_id, max(n) AS n, coalesce({_share('v - prev = 0')}, 0.0) AS equal, coalesce({_share('abs(v - prev) <= 255')}, 0.0) AS small, {_share('v = 0')} AS splat FROM z5 GROUP BY block_id)
SELECT block_id, n, round(equal, 6) AS equal, round(small, 6) AS small, round(splat, 6) AS splat, (equal >= 0.8 OR (equal >= 0.5 AND small >= 0.95)) AND splat <= 0.5 AS admitted FROM t WHERE n >= 64""")
def run_prefilter(s, d):
    return profile.run_profile(_users(s, d))


@_query("float_profile", f"""WITH {VALUES}, {WINDOWS}, f AS (SELECT *, CASE WHEN isnan(v) OR isinf(v) THEN 2047 WHEN abs(v) < 2.2250738585072014e-308 THEN 0 ELSE floor(log2(abs(v))) + 1023 END AS exponent, xor(v::BIT, prev::BIT)::VARCHAR AS x FROM z5),
t AS (SELECT block_id, max(n) AS n, {_share('exponent = 2047')} AS non_finite, {_share('v = 0')} AS zero, {_share('exponent = 0 AND v <> 0')} AS subnormal, count(DISTINCT exponent) AS exponents,
{_share('exponent BETWEEN 1 AND 2046 AND abs(exponent - 1023) > 200')} AS implausible, coalesce({_share("rtrim(x, '0') = ''")}, 0.0) AS xor_zero, coalesce({_share("x[1] = '1'")}, 0.0) AS sign_changes, coalesce(avg(length(trim(x, '0'))) FILTER (trim(x, '0') <> ''), 0.0) AS xor_bits FROM f GROUP BY block_id)
SELECT block_id, n, round(non_finite, 6) AS non_finite, round(zero, 6) AS zero, round(subnormal, 6) AS subnormal, round(implausible, 6) AS implausible, round(xor_zero, 6) AS xor_zero, round(xor_bits, 6) AS xor_bits, round(sign_changes, 6) AS sign_changes, exponents,
CASE WHEN n < 64 THEN 'too-short' WHEN non_finite > 0.05 THEN 'non-finite' WHEN zero > 0.25 THEN 'zero-dominated' WHEN subnormal > 0.05 THEN 'subnormal' WHEN exponents > 16 THEN 'exponent-spread' WHEN implausible > 0.05 THEN 'implausible-magnitude' WHEN xor_bits > 48 THEN 'noisy-mantissa' ELSE 'admitted' END AS verdict FROM t""")
def float_profile(s, d):
    return profile.float_profile(_values(s, d))


@_query("patched_for_plan", f"""WITH {CUSTOMERS}, o AS (SELECT block_id, v - min(v) OVER (PARTITION BY block_id) AS o FROM l), hi AS (SELECT block_id, {_bw('o')} AS w, count(*) AS c FROM o GROUP BY ALL),
tops AS (SELECT block_id, sum(c)::BIGINT AS n, max(w) AS top FROM hi GROUP BY block_id), g AS (SELECT block_id, n, top, unnest(range(0, top + 1)) AS bits FROM tops),
x AS (SELECT g.block_id, n, top, bits, coalesce((SELECT sum(c) FROM hi WHERE hi.block_id = g.block_id AND hi.w > bits), 0)::BIGINT AS exceptions FROM g),
y AS (SELECT *, (41 + ceil(n * bits / 8.0) + ceil(exceptions * {_bw('(n - 1)')} / 8.0) + ceil(exceptions * (top - bits) / 8.0))::BIGINT AS bytes FROM x)
SELECT block_id, n, bits, exceptions, bytes FROM y QUALIFY row_number() OVER (PARTITION BY block_id ORDER BY bytes, bits) = 1""")
def patched_for_plan(s, d):
    return estimate.patched(_customers(s, d))


@_query("run_delta_size", f"""WITH {USERS}, {RUNS}, g AS (SELECT *, lead(v) OVER (PARTITION BY block_id ORDER BY run) AS next FROM r),
b AS (SELECT block_id, length, 2 * ({_bw('(length + 1)')} - 1) + 1 + CASE WHEN next IS NULL THEN 1 ELSE 2 * ({_bw('(' + _zz('(next - v)') + ' + 1)')} - 1) + 1 END AS bits FROM g)
SELECT block_id, count(*) AS runs, sum(length)::BIGINT AS n, (28 + ceil(sum(bits) / 8.0))::BIGINT AS bytes FROM b GROUP BY block_id""")
def run_delta_size(s, d):
    return estimate.run_delta_bytes(_users(s, d))


@_query("rle_size", f"""WITH {KINDS}, {RUNS}, p AS (SELECT block_id, run, length // 128 + CASE WHEN length % 128 >= 4 THEN 1 ELSE 0 END AS packets, CASE WHEN length % 128 < 4 THEN length % 128 ELSE 0 END AS literals FROM r),
g AS (SELECT *, sum(packets) OVER (PARTITION BY block_id ORDER BY run ROWS UNBOUNDED PRECEDING) AS grp FROM p), a AS (SELECT block_id, grp, sum(packets) AS p, sum(literals) AS q FROM g GROUP BY ALL)
SELECT block_id, sum(2 * p + q + ceil(q / 128.0))::BIGINT AS bytes FROM a GROUP BY block_id""")
def rle_size(s, d):
    return estimate.rle_bytes(_kinds(s, d))


@_query("huffman_bound", f"""WITH {BYTES}, c AS (SELECT block_id, v, count(*) AS n FROM l GROUP BY ALL), a AS (SELECT *, sum(n) OVER (PARTITION BY block_id) AS whole FROM c)
SELECT block_id, sum(n)::BIGINT AS size, ceil(round(sum(-n * log2(n / whole)), 4) / 8)::BIGINT AS least_bytes FROM a GROUP BY block_id""")
def huffman_bound(s, d):
    return estimate.huffman_bound(_bytes(s, d))


ALP = f"""{VALUES}, li AS (SELECT block_id, v, row_number() OVER (PARTITION BY block_id ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY block_id) AS n FROM l),
smp AS (SELECT * FROM li WHERE n <= 64 OR i - (n - 16) * 0 // 3 BETWEEN 0 AND 15 OR i - (n - 16) * 1 // 3 BETWEEN 0 AND 15 OR i - (n - 16) * 2 // 3 BETWEEN 0 AND 15 OR i - (n - 16) BETWEEN 0 AND 15),
g AS (SELECT e, f FROM range(0, 19) a(e), range(0, 19) b(f) WHERE f <= e),
x AS (SELECT block_id, e, f, v, round(v * ('1e' || e)::DOUBLE * (1.0::DOUBLE / ('1e' || f)::DOUBLE)) AS q, v * ('1e' || e)::DOUBLE * (1.0::DOUBLE / ('1e' || f)::DOUBLE) AS x FROM smp, g),
xo AS (SELECT *, coalesce(q * ('1e' || f)::DOUBLE * (1.0::DOUBLE / ('1e' || e)::DOUBLE) = v, false) AND abs(x) < 9007199254740992.0 AS kept FROM x),
y AS (SELECT block_id, e, f, count(*) FILTER (NOT kept) * 72 + count(*) * CASE WHEN count(*) FILTER (kept) = 0 THEN 0 ELSE {_bw("(max(CASE WHEN kept THEN q::BIGINT END) - min(CASE WHEN kept THEN q::BIGINT END))")} END AS cost FROM xo GROUP BY ALL),
best AS (SELECT block_id, e, f FROM y QUALIFY row_number() OVER (PARTITION BY block_id ORDER BY cost, e, f) = 1),
bx AS (SELECT li.block_id, n, i, e, f, v, v * ('1e' || e)::DOUBLE * (1.0::DOUBLE / ('1e' || f)::DOUBLE) AS x FROM li JOIN best USING (block_id)),
bk AS (SELECT *, round(x) AS q, coalesce(round(x) * ('1e' || f)::DOUBLE * (1.0::DOUBLE / ('1e' || e)::DOUBLE) = v, false) AND abs(x) < 9007199254740992.0 AS kept FROM bx),
gaps AS (SELECT block_id, sum(2 * {_bw("(i - prev)")} - 1)::BIGINT AS bits FROM (SELECT block_id, i, coalesce(lag(i) OVER (PARTITION BY block_id ORDER BY i), -1) AS prev FROM bk WHERE NOT kept) GROUP BY block_id),
al AS (SELECT block_id, any_value(n) AS n, any_value(e)::INT AS e, any_value(f)::INT AS f, count(*) FILTER (NOT kept) AS exceptions, coalesce({_bw("(max(CASE WHEN kept THEN q::BIGINT END) - min(CASE WHEN kept THEN q::BIGINT END))")}, 0) AS width FROM bk GROUP BY block_id),
alp AS (SELECT block_id, n, e, f, exceptions, (28 + ceil((81 + 2 * {_bw("(exceptions + 1)")} - 1 + coalesce(bits, 0) + exceptions * 64 + n * width) / 8.0))::BIGINT AS bytes FROM al LEFT JOIN gaps USING (block_id))"""


@_query("alp_params_grid", f"WITH {ALP} SELECT * FROM alp")
def alp_params_grid(s, d):
    return estimate.alp_parameters(_values(s, d))


_PLANS = ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in (*c, (c[1] + "+" if c[1] else "") + c[2] + ("_" + c[3] if c[3] else "") + ("+" + c[4] if c[4] != "none" else ""))) + ")" for c in planner.CANDIDATES)
PLANS = f"plans(plan, transform, codec, lz, entropy, least_size, label) AS (VALUES {_PLANS})"


def _clamp(x: str, low: float, high: float) -> str:
    return f"least(greatest({x}, {low}::DOUBLE), {high}::DOUBLE)"


COSTS = f"""{PROFILE}, {PLANS}, x AS (SELECT prof.*, plans.*, {_clamp('h0 / 8', 0.02, 1.0)} AS h FROM prof JOIN plans ON size >= least_size),
est AS (SELECT block_id, size, plan, label, codec, entropy, transform, lz,
  greatest(round(round(size * CASE WHEN transform = 'delta' THEN 1 - 0.55::DOUBLE * {_clamp('delta_score', 0.0, 0.85)} ELSE 1.0 END
    * CASE WHEN codec = 'rle' THEN {_clamp('1 - 0.9::DOUBLE * greatest(run_score, zero_ratio)', 0.015, 1.05)} ELSE 1.0 END
    * CASE WHEN codec = 'lz' THEN {_clamp("1 - greatest(repetition, least(match_length / 48, 1.0::DOUBLE)) * CASE WHEN lz = 'balanced' THEN 0.72::DOUBLE ELSE 0.62::DOUBLE END", 0.05, 1.04)} ELSE 1.0 END
    * CASE entropy WHEN 'none' THEN 1.0::DOUBLE WHEN 'huffman' THEN {_clamp('0.04::DOUBLE + 0.96::DOUBLE * h', 0.04, 1.03)} ELSE {_clamp('0.025::DOUBLE + 0.94::DOUBLE * h', 0.03, 1.02)} END, 3)), 1.0)::BIGINT
    + CASE entropy WHEN 'none' THEN 0 WHEN 'huffman' THEN 260 WHEN 'rans' THEN 516 ELSE 2064 END AS estimate,
  (CASE WHEN codec = 'raw' THEN 1 WHEN codec = 'rle' THEN 2 WHEN lz = 'fast' THEN 4 ELSE 9 END + CASE entropy WHEN 'none' THEN 0 WHEN 'huffman' THEN 4 WHEN 'rans' THEN 9 ELSE 5 END + CASE WHEN transform = 'delta' THEN 1 ELSE 0 END)::BIGINT AS encode,
  (CASE WHEN codec = 'raw' THEN 1 WHEN codec = 'rle' THEN 2 ELSE 3 END + CASE entropy WHEN 'none' THEN 0 WHEN 'huffman' THEN 6 WHEN 'rans' THEN 5 ELSE 3 END + CASE WHEN transform = 'delta' THEN 1 ELSE 0 END)::BIGINT AS decode,
  size * CASE WHEN codec = 'lz' THEN 3 ELSE 2 END AS memory,
  round(greatest(0.78::DOUBLE, CASE WHEN transform = 'delta' THEN least(0.60::DOUBLE + 0.35::DOUBLE * delta_score, 0.98::DOUBLE) ELSE 0.0 END, CASE codec WHEN 'rle' THEN least(0.62::DOUBLE + 0.36::DOUBLE * greatest(run_score, zero_ratio), 0.99::DOUBLE)
    WHEN 'lz' THEN least(0.54::DOUBLE + 0.34::DOUBLE * greatest(repetition, least(match_length / 48, 1.0::DOUBLE)), 0.94::DOUBLE) ELSE 0.0 END), 6) AS confidence FROM x),
sc AS (SELECT *, (estimate * 1000000 // greatest(size, 1)) * 60 + encode * 3500 * 18 + decode * 1300 * 17 + (memory * 1000 // greatest(size, 1)) * 5 AS score FROM est)"""


def _scores(s, d):
    return planner.scored(planner.estimated(profile.block_profile(_texts(s, d)), planner.candidates(s)))


@_query("candidate_costs", f"WITH {COSTS} SELECT block_id, plan, label, estimate, encode, decode, memory, score::BIGINT AS score FROM sc")
def candidate_costs(s, d):
    return _scores(s, d).select("block_id", "plan", "label", "estimate", "encode", "decode", "memory", "score")


@_query("top_k_candidates", f"WITH {COSTS} SELECT block_id, plan, label, score::BIGINT AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY score, plan) AS rank FROM sc) WHERE rank <= 3")
def top_k_candidates(s, d):
    return planner.ranked(_scores(s, d)).where("rank <= 3").select("block_id", "plan", "label", "score", "rank")


@_query("family_pool", f"WITH {COSTS} SELECT block_id, plan, codec, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY score, plan) AS rank, row_number() OVER (PARTITION BY block_id, codec ORDER BY score, plan) AS f FROM sc) WHERE rank <= 3 OR f = 1")
def family_pool(s, d):
    return planner.family_representatives(_scores(s, d)).select("block_id", "plan", "codec", "rank")


@_query("quality_envelope", f"WITH {COSTS}, mb AS (SELECT *, min(estimate) OVER (PARTITION BY block_id) AS best FROM sc) SELECT block_id, plan, estimate FROM mb WHERE estimate <= best + (best * 15000 + 999999) // 1000000")
def quality_envelope(s, d):
    return planner.enveloped(_scores(s, d)).select("block_id", "plan", "estimate")


SELECTED = "sel AS (SELECT block_id, plan, label, estimate, size, score::BIGINT AS score FROM sc QUALIFY row_number() OVER (PARTITION BY block_id ORDER BY score, plan) = 1)"


@_query("selected_plan", f"WITH {COSTS}, {SELECTED} SELECT * FROM sel")
def selected_plan(s, d):
    return planner.selected(_scores(s, d))


@_query("plan_distribution", f"WITH {COSTS}, {SELECTED} SELECT label, count(*) AS blocks, sum(estimate)::BIGINT AS bytes, sum(size)::BIGINT AS raw FROM sel GROUP BY label")
def plan_distribution(s, d):
    return planner.plan_distribution(planner.selected(_scores(s, d)))


@_query("plan_rollup", f"WITH {COSTS}, e AS (SELECT codec, entropy, count(*) AS candidates, sum(estimate)::BIGINT AS bytes FROM sc GROUP BY ROLLUP (codec, entropy)) SELECT * FROM e")
def plan_rollup(s, d):
    return _scores(s, d).rollup("codec", "entropy").agg(F.count("*").alias("candidates"), F.sum("estimate").alias("bytes"))


@_query("explain_plans", f"WITH {COSTS} SELECT block_id, first(label ORDER BY score, plan) AS selected, string_agg(label, ',' ORDER BY score, plan) AS candidates FROM sc GROUP BY block_id")
def explain_plans(s, d):
    return planner.explained(_scores(s, d))


@_query("data_class", f"WITH {PROFILE} SELECT block_id, CASE WHEN zero_ratio >= 0.985 OR run_score >= 0.92 THEN 'zero-heavy' WHEN incompressibility >= 0.96 AND repetition < 0.01 AND run_score < 0.01 THEN 'incompressible' WHEN delta_score >= 0.08 THEN 'numeric' ELSE 'structured' END AS data_class FROM prof")
def data_class(s, d):
    return planner.data_class(profile.block_profile(_texts(s, d)))


def _route_sql(lane: str) -> str:
    return f"WITH {_prefilter_sql(lane)} SELECT block_id, confidence, CASE WHEN NOT likely THEN 'generic' WHEN strong AND confidence >= 0.98 AND step IS NOT NULL THEN 'numeric-fast' ELSE 'numeric-general' END AS route FROM pf LEFT JOIN fs USING (block_id)"


@_query("route_orders", _route_sql(KEYS))
def route_orders(s, d):
    return planner.route(profile.numeric_prefilter(_keys(s, d)), profile.fixed_step(_keys(s, d)))


@_query("route_events", _route_sql(TIMES))
def route_events(s, d):
    return planner.route(profile.numeric_prefilter(_times(s, d)), profile.fixed_step(_times(s, d)))


@_query("auto_block_size", f"WITH {NUMERIC} SELECT block_id, CASE WHEN confidence >= 0.85 THEN 1048576 ELSE 262144 END::BIGINT AS block_size, CASE WHEN confidence >= 0.85 THEN 'numeric-sequential' ELSE 'balanced-default' END AS reason FROM num")
def auto_block_size(s, d):
    return planner.block_size(profile.numeric_profile(_times(s, d)), "balanced", "balanced")


INDEX = f"{TIMES}, i0 AS (SELECT block_id, count(*) AS values, count(*) * 8 AS size FROM l GROUP BY block_id), i AS (SELECT *, coalesce(sum(size) OVER (ORDER BY block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS original_offset FROM i0)"
RANGES = [(0, 0, 64), (1, 1000, 5000), (2, 16384, 16392), (3, 30000, 60000), (4, 7, 7)]
HITS = f"""{INDEX}, rg(range_id, first, last) AS (VALUES {', '.join(map(str, RANGES))}),
hit AS (SELECT range_id, block_id, size, greatest(first - original_offset, 0) AS take_from, least(last - original_offset, size) AS take_to FROM i JOIN rg ON original_offset < last AND original_offset + size > first)"""


def _ranges(s):
    return s.range(1).select(F.explode(F.array(*[F.struct(F.lit(i).alias("range_id"), F.lit(a).cast("long").alias("first"), F.lit(b).cast("long").alias("last")) for i, a, b in RANGES])).alias("r")).select("r.*")


@_query("block_index", f"WITH {INDEX} SELECT * FROM i")
def block_index(s, d):
    return ranges.block_index(_times(s, d))


@_query("range_intersect", f"WITH {HITS} SELECT * FROM hit")
def range_intersect(s, d):
    return ranges.intersecting(ranges.block_index(_times(s, d)), _ranges(s)).select("range_id", "block_id", "size", "take_from", "take_to")


@_query("range_metrics", f"WITH {HITS} SELECT range_id, count(*) AS blocks, sum(size)::BIGINT AS physical, sum(take_to - take_from)::BIGINT AS logical, round(CASE WHEN sum(take_to - take_from) = 0 THEN 0.0 ELSE sum(size) / sum(take_to - take_from) END, 6) AS amplification FROM hit GROUP BY range_id")
def range_metrics(s, d):
    return ranges.range_metrics(ranges.intersecting(ranges.block_index(_times(s, d)), _ranges(s)))


@_query("range_read", "SELECT event_id, user_id, value FROM events WHERE event_id >= 1500 AND event_id < 4700")
def range_read(s, d):
    return ranges.read_values(_table(s, d, "events"), "event_id", 1500, 4700, "user_id", "value")


DICTS = """b AS (SELECT doc_id AS block_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END AS dict_id FROM documents),
em AS (SELECT DISTINCT source AS dict_id, 'own-' || source AS bytes FROM documents WHERE source < 'src15'), rg AS (SELECT DISTINCT source AS dict_id, 'reg-' || source AS bytes FROM documents WHERE source >= 'src12' AND source < 'src5')"""


def _dicts(s, d):
    docs = _table(s, d, "documents")
    blocks = docs.select(F.col("doc_id").alias("block_id"), F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("dict_id"))
    own = docs.where("source < 'src15'").select(F.col("source").alias("dict_id"), F.concat(F.lit("own-"), "source").alias("bytes")).distinct()
    registry = docs.where("source >= 'src12' and source < 'src5'").select(F.col("source").alias("dict_id"), F.concat(F.lit("reg-"), "source").alias("bytes")).distinct()
    return blocks, own, registry


@_query("dict_resolve", f"WITH {DICTS} SELECT block_id, b.dict_id, coalesce(em.bytes, rg.bytes) AS bytes, CASE WHEN em.bytes IS NOT NULL THEN 'embedded' WHEN rg.bytes IS NOT NULL THEN 'registry' ELSE 'missing' END AS scope FROM b LEFT JOIN em ON b.dict_id = em.dict_id LEFT JOIN rg ON b.dict_id = rg.dict_id")
def dict_resolve(s, d):
    return ranges.resolve_dictionaries(*_dicts(s, d)).select("block_id", "dict_id", "bytes", "scope")


@_query("dict_missing", f"WITH {DICTS} SELECT block_id, dict_id FROM b WHERE dict_id IS NOT NULL AND dict_id NOT IN (SELECT dict_id FROM em UNION SELECT dict_id FROM rg)")
def dict_missing(s, d):
    return ranges.missing_dictionaries(*_dicts(s, d)).select("block_id", "dict_id")


WIN = f"{USERS}, wz AS (SELECT *, least(pos // 256, greatest((max(pos) OVER (PARTITION BY block_id) + 1) // 256, 1) - 1) AS win FROM l), wc AS (SELECT block_id, win, count(*) AS n, count(DISTINCT v) AS \"distinct\" FROM wz GROUP BY block_id, win), wcl AS (SELECT *, CASE WHEN \"distinct\" <= 1 THEN 0 WHEN \"distinct\" <= 16 THEN 1 WHEN \"distinct\" <= 64 THEN 2 WHEN \"distinct\" <= 192 THEN 3 ELSE 4 END::BIGINT AS \"class\" FROM wc)"
SEG = """sm AS (SELECT *, CASE WHEN lag("class") OVER (PARTITION BY block_id ORDER BY win) = "class" THEN 0 ELSE 1 END AS new FROM wcl), sr AS (SELECT *, sum(new) OVER (PARTITION BY block_id ORDER BY win ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM sm),
sg0 AS (SELECT block_id, segment, first("class") AS "class", min(win) AS first_win, count(*) AS windows, sum(n)::BIGINT AS n FROM sr GROUP BY block_id, segment),
sg AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY block_id ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM sg0)"""


@_query("segment_windows", f"WITH {WIN} SELECT * FROM wcl")
def segment_windows(s, d):
    return segments.window_classes(_users(s, d), 256)


@_query("segment_islands", f"WITH {WIN}, {SEG} SELECT * FROM sg")
def segment_islands(s, d):
    return segments.segments(segments.window_classes(_users(s, d), 256))


@_query("even_split", f"WITH {WIN}, {SEG}, e AS (SELECT block_id, segment, n, ceil(n / 300.0)::BIGINT AS pieces FROM sg), f AS (SELECT *, unnest(range(0, pieces)) AS piece FROM e) SELECT block_id, segment, piece, n * piece // pieces AS piece_from, n * (piece + 1) // pieces AS piece_to FROM f")
def even_split(s, d):
    return segments.even_split(segments.segments(segments.window_classes(_users(s, d), 256)), 300).select("block_id", "segment", "piece", "piece_from", "piece_to")


@_query("segment_merge")
def segment_merge(s, d):
    return segments.merged_small(segments.window_classes(_times(s, d), 128), 512)


@_query("columnar_streams", "SELECT event_id, 'user_id' AS \"column\", user_id::VARCHAR AS value FROM events UNION ALL SELECT event_id, 'event_type', event_type FROM events UNION ALL SELECT event_id, 'props', props FROM events")
def columnar_streams(s, d):
    return _table(s, d, "events").selectExpr("event_id", "stack(3, 'user_id', cast(user_id as string), 'event_type', event_type, 'props', props) as (column, value)")


def _gain_sql() -> str:
    parts = [f"SELECT block_id, '{c}' AS \"column\", bytes, n * 8 AS raw FROM (WITH {_lane_sql('orders', 'o_orderkey', c, 4096)}, {MODES} SELECT block_id, n, bytes FROM b QUALIFY row_number() OVER (PARTITION BY block_id ORDER BY bytes, mode) = 1)" for c in ("o_orderkey", "o_custkey")]
    return " UNION ALL ".join(parts)


@_query("columnar_gain", _gain_sql())
def columnar_gain(s, d):
    return estimate.columnar_gain(_table(s, d, "orders"), "o_orderkey", ["o_orderkey", "o_custkey"], 4096)


@_query("dict_grams", "WITH g AS (SELECT DISTINCT page_id, substr(url, i::INT, 8) AS gram FROM (SELECT page_id, url, unnest(range(1, length(url) - 6)) AS i FROM pages WHERE length(url) >= 8)) SELECT gram, count(*) AS df FROM g GROUP BY gram HAVING count(*) >= 2")
def dict_grams(s, d):
    return dictionary.gram_frequencies(_table(s, d, "pages"), "page_id", "url")


@_query("dict_train")
def dict_train(s, d):
    data = dictionary.train(_table(s, d, "pages").select("page_id", "url"), "page_id", "url", size=1024)
    return s.range(1).select(F.lit(str(dictionary.dictionary_id(data))).alias("dict_id"), F.lit(len(data)).alias("bytes"), F.lit(data).alias("data"))


@_query("sample_stats", """WITH b AS (SELECT event_type, event_id % 5 AS batch, median(value) AS m, count(*) AS n, sum(value) AS s, min(value) AS lo, max(value) AS hi FROM events GROUP BY ALL)
SELECT event_type, round(median(m), 6) AS median_of_medians, round(min(m), 6) AS best, round(max(m), 6) AS worst, round(sum(s) / sum(n), 6) AS mean, round(min(lo), 6) AS least, round(max(hi), 6) AS most, sum(n)::BIGINT AS n FROM b GROUP BY event_type""")
def sample_stats(s, d):
    return telemetry.sample_stats(_table(s, d, "events").withColumn("batch", F.col("event_id") % 5), "event_type", "batch", "value")


@_query("mad_outliers", """WITH m AS (SELECT event_type, median(value) AS median FROM events GROUP BY event_type), dv AS (SELECT e.event_type, m.median, abs(value - m.median) AS dev FROM events e JOIN m USING (event_type)),
a AS (SELECT event_type, median(dev) AS mad FROM dv GROUP BY event_type) SELECT dv.event_type, round(first(dv.median), 6) AS median, round(first(mad), 6) AS mad, count(*) AS n, count(*) FILTER (mad > 0 AND dev > 3.5 * mad) AS outliers FROM dv JOIN a USING (event_type) GROUP BY dv.event_type""")
def mad_outliers(s, d):
    return telemetry.mad_outliers(_table(s, d, "events"), "event_type", "value")


@_query("ab_gate", """WITH m AS (SELECT user_id % 20 AS k, median(value) FILTER (event_id % 2 = 0) AS a, median(value) FILTER (event_id % 2 = 1) AS b FROM events GROUP BY ALL)
SELECT k, round(a, 6) AS baseline, round(b, 6) AS candidate, round(b / a, 6) AS ratio, CASE WHEN a IS NULL OR b IS NULL THEN 'MISSING' WHEN b / a >= 0.97 THEN 'PASS' ELSE 'FAIL' END AS status FROM m""")
def ab_gate(s, d):
    e = _table(s, d, "events").withColumn("k", F.col("user_id") % 20).withColumn("side", F.when(F.col("event_id") % 2 == 0, "A").otherwise("B"))
    return telemetry.ab_gate(e, "k", "side", "value")


@_query("repeatability_spread", """WITH r AS (SELECT event_type, event_id % 4 AS run, median(value) AS m FROM events GROUP BY ALL), s AS (SELECT event_type, count(*) AS runs, round((max(m) - min(m)) / median(m), 6) AS spread FROM r GROUP BY event_type)
SELECT event_type, runs, spread, CASE WHEN spread <= 0.05 THEN 'STABLE' WHEN spread <= 0.15 THEN 'NOISY' ELSE 'UNSTABLE' END AS verdict FROM s""")
def repeatability_spread(s, d):
    return telemetry.repeatability(_table(s, d, "events").withColumn("run", F.col("event_id") % 4), "event_type", "run", "value")


@_query("estimator_error", f"""WITH {COSTS}, hb AS (SELECT block_id, greatest(ceil(round(sum(-n * log2(n / whole)), 4) / 8), 1)::BIGINT AS actual FROM (SELECT block_id, value, n, sum(n) OVER (PARTITION BY block_id) AS whole FROM c) GROUP BY block_id),
j AS (SELECT label, estimate - actual AS e, abs(estimate - actual) / greatest(actual, 1) AS share FROM sc JOIN hb USING (block_id) WHERE entropy = 'huffman')
SELECT label, round(avg(abs(e)), 6) AS mae, round(avg(share), 6) AS mape, round(avg(e), 6) AS bias, round(quantile_cont(share, 0.95), 6) AS p95 FROM j GROUP BY label""")
def estimator_error(s, d):
    bound = estimate.huffman_bound(_bytes(s, d)).select("block_id", F.greatest("least_bytes", F.lit(1)).alias("actual"))
    return telemetry.estimator_error(_scores(s, d).where("entropy = 'huffman'").join(bound, "block_id"), "label", "estimate", "actual")


def _codec_query(name, lane, codec, size, sql=None):
    from blockwright.sources import blocks

    _query(name, sql)(lambda s, d: blocks.lane_payloads(lane(s, d), codec, size))


_codec_query("codec_num1", _keys, "num1", 4096, f"WITH {KEYS}, {MODES} SELECT block_id, n, bytes, true AS ok FROM b QUALIFY row_number() OVER (PARTITION BY block_id ORDER BY bytes, mode) = 1")
_codec_query("codec_num1_for", _customers, "num1_1", 2048, f"WITH {CUSTOMERS}, {MODES} SELECT block_id, n, bytes, true AS ok FROM b WHERE mode = 1")
_codec_query("codec_num1_dod", _times, "num1_3", 2048, f"WITH {TIMES}, {MODES} SELECT block_id, n, bytes, true AS ok FROM b WHERE mode = 3")
_codec_query("codec_patched", _customers, "patched", 2048, f"SELECT block_id, n, bytes, true AS ok FROM ({ORACLE_SQL['patched_for_plan']})")
_codec_query("codec_run_delta", _users, "run_delta", 2048, f"SELECT block_id, n, bytes, true AS ok FROM ({ORACLE_SQL['run_delta_size']})")
_codec_query("codec_rle", _kinds, "rle", 2048, f"SELECT block_id, least(2048, (SELECT count(*) FROM events) - 2048 * block_id)::BIGINT AS n, bytes, true AS ok FROM ({ORACLE_SQL['rle_size']})")
_codec_query("codec_alp", _values, "alp", 2048, f"WITH {ALP} SELECT block_id, n, bytes, true AS ok FROM alp")


def _trip_query(name, lane, codec, table):
    """Sizes of these layouts have no closed form; every block must come back."""
    from blockwright.sources import blocks

    sql = f"WITH {table} SELECT block_id, count(*) AS n, true AS ok FROM l GROUP BY block_id"
    _query(name, sql)(lambda s, d: blocks.lane_payloads(lane(s, d), codec, 2048).select("block_id", "n", "ok"))


_trip_query("codec_gorilla", _values, "gorilla", VALUES)
_trip_query("codec_lz", _kinds, "lz_balanced+huffman", KINDS)
_trip_query("codec_delta_rans", _kinds, "delta+raw+rans", KINDS)
_trip_query("codec_rans4x", _kinds, "raw+rans4x", KINDS)


def _engine_blocks(rows, width, profile="balanced"):
    """A lane as files of one block each, through the engine: block_id, label, route, original and stored bytes, and whether the block came back."""
    from blockwright.engine import Config, Engine
    from blockwright.sources import records

    files = records.write_lanes(rows, width).select(F.col("block_id").cast("string").alias("file_id"), "data")
    engine = Engine(Config(block_size=1 << 20, profile=profile))
    # A file is one block: what is stored and whether it came back stand in one row, so nothing is encoded twice or joined.
    checked = engine.check(engine.compress_with_stats(files), ("route",))
    ok = (F.col("block_id") == 0) & F.col("error").isNull()
    return checked.select(F.col("file_id").cast("long").alias("block_id"), "label", "route", F.col("original_size").cast("long").alias("raw"), F.col("stored").cast("long").alias("bytes"), ok.alias("ok"))


@_query("engine_fixed_step", f"""WITH {KEYS}, {D}, t AS (SELECT block_id, count(*) AS n, min(d) AS lo, max(d) AS hi FROM d GROUP BY block_id)
SELECT block_id, 'num1' AS label, 'numeric-fast' AS route, n * 8 AS raw, 40::BIGINT AS bytes, true AS ok FROM t WHERE n >= 16 AND lo = hi AND lo > 0""")
def engine_fixed_step(s, d):
    return _engine_blocks(_keys(s, d), 8)


_WAVE = "(10000 + abs(event_id % 2000 - 1000)) / 100"


@_query("engine_float_plan", f"""WITH {ALP.replace(VALUES, _lane_sql("events", "event_id", _WAVE + ".0::DOUBLE", 2048), 1)} SELECT block_id, 'alp8' AS label, 'float-general' AS route, n * 8 AS raw, bytes, true AS ok FROM alp""")
def engine_float_plan(s, d):
    return _engine_blocks(lanes.lane(_table(s, d, "events"), "event_id", _WAVE + "D", 2048), 8)


@_query("engine_numeric_plan", f"""WITH {_lane_sql("events", "event_id", "1780000000000 + 1000 * event_id + event_id % 3", 8192)}, {D},
t AS (SELECT block_id, count(*) AS n, {_bw('max(v) - min(v)')} AS w1, {_bw('max(' + _zz('d') + ')')} AS w2, {_bw('max(' + _zz('dd') + ')')} AS w3 FROM d GROUP BY block_id)
SELECT block_id, 'num1' AS label, 'numeric-general' AS route, n * 8 AS raw, 40 + least(ceil(n * w1 / 8.0), ceil((n - 1) * w2 / 8.0), ceil((n - 2) * w3 / 8.0))::BIGINT AS bytes, true AS ok FROM t""")
def engine_numeric_plan(s, d):
    return _engine_blocks(lanes.lane(_table(s, d, "events"), "event_id", "1780000000000 + 1000 * event_id + event_id % 3", 8192), 8)


@_query("engine_documents", "SELECT doc_id::VARCHAR AS file_id, ceil(octet_length(encode(text)) / 65536.0)::BIGINT AS blocks, 0::BIGINT AS damaged, true AS complete, octet_length(encode(text))::BIGINT AS bytes FROM documents WHERE strlen(text) > 0")
def engine_documents(s, d):
    """Every document planned and encoded by the engine (profile fast), decoded and checked."""
    from blockwright.engine import Config, Engine

    engine = Engine(Config(block_size=65536, profile="fast"))
    return engine.verify(engine.compress(_texts(s, d).select(F.col("block_id").cast("string").alias("file_id"), "data")))


def _stored_pages(s, d):
    from blockwright.sources import blocks

    files = _table(s, d, "pages").select(F.col("page_id").cast("string").alias("file_id"), F.encode("html", "UTF-8").alias("data"))
    return blocks.encode(blocks.chunk(files, 4096).withColumn("label", F.lit("lz_fast+huffman")))


@_query("container_verify", "SELECT page_id::VARCHAR AS file_id, ceil(octet_length(encode(html)) / 4096.0)::BIGINT AS blocks, 0::BIGINT AS damaged, true AS complete, octet_length(encode(html))::BIGINT AS bytes FROM pages WHERE octet_length(encode(html)) > 0")
def container_verify(s, d):
    from blockwright.sources import blocks

    return blocks.verify(_stored_pages(s, d))


@_query("container_range", "SELECT '3' AS file_id, (i - 1)::BIGINT AS block_id, 0::BIGINT AS first FROM range(1, 1) t(i) UNION ALL SELECT page_id::VARCHAR, 0, 100 FROM pages WHERE page_id = 3")
def container_range(s, d):
    from blockwright.sources import blocks

    page = _table(s, d, "pages").where("page_id = 3").select(F.col("page_id").cast("string").alias("file_id"), F.encode("html", "UTF-8").alias("data"))
    stored = blocks.encode(blocks.chunk(page, 4096).withColumn("label", F.lit("lz_fast")))
    return blocks.read_range(stored, "3", 100, 300).select("file_id", "block_id", F.col("offset").alias("first"))


@_query("tier_plan", f"""WITH {COSTS}, tiers(tier, profile, block_size) AS (VALUES ('hot', 'fast', 65536), ('warm', 'balanced', 262144), ('cold', 'dense', 1048576)),
ts AS (SELECT block_id, tier, plan, label, (estimate * 1000000 // greatest(size, 1)) * CASE tier WHEN 'hot' THEN 20 WHEN 'warm' THEN 60 ELSE 86 END + encode * CASE tier WHEN 'hot' THEN 34000 * 55 WHEN 'warm' THEN 3500 * 18 ELSE 550 * 5 END
 + decode * CASE tier WHEN 'hot' THEN 6000 * 20 WHEN 'warm' THEN 1300 * 17 ELSE 300 * 5 END + (memory * 1000 // greatest(size, 1)) * CASE tier WHEN 'cold' THEN 4 ELSE 5 END AS score FROM sc, tiers)
SELECT tier, label, count(*) AS blocks FROM (SELECT * FROM ts QUALIFY row_number() OVER (PARTITION BY block_id, tier ORDER BY score, plan) = 1) GROUP BY ALL""")
def tier_plan(s, d):
    estimates = planner.estimated(profile.block_profile(_texts(s, d)), planner.candidates(s))
    chosen = planner.selected_by_tier(estimates, {"hot": "fast", "warm": "balanced", "cold": "dense"})
    return chosen.groupBy("tier", "label").agg(F.count("*").alias("blocks"))


def _scratch(s) -> str:
    """A new folder below the shared one that the session names; a temporary one where none is named."""
    named = s.conf.get("spark.checkpoint.dir", None) or s.sparkContext.getCheckpointDir()
    return f"{named.rstrip('/')}/{uuid.uuid4().hex}" if named else tempfile.mkdtemp(prefix="blockwright-")


@_query("stream_windows", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windows(s, d):
    from blockwright.streaming import encoder

    base = _scratch(s)
    events = _table(s, d, "events").select("ts", "event_type", "value")
    events.write.parquet(f"{base}/in")  # a stream reads folders only
    arriving = s.readStream.schema(events.schema).parquet(f"{base}/in")
    name = f"windows_{uuid.uuid4().hex}"
    counted = encoder.windowed_counts(arriving).select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))
    counted.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start().awaitTermination()
    return s.table(name)


@_query("stream_blocks", "SELECT doc_id::VARCHAR AS file_id, ceil(octet_length(encode(text)) / 2048.0)::BIGINT AS blocks, 0::BIGINT AS damaged, true AS complete, octet_length(encode(text))::BIGINT AS bytes FROM documents WHERE octet_length(encode(text)) > 0")
def stream_blocks(s, d):
    """Documents encoded as a stream of files, verified as a table."""
    from blockwright.sources import blocks
    from blockwright.streaming import encoder

    base = _scratch(s)
    _table(s, d, "documents").select(F.col("doc_id").cast("string").alias("file_id"), F.encode("text", "UTF-8").alias("data")).write.parquet(f"{base}/in")
    encoder.encode_stream(s, f"{base}/in", "file_id string, data binary", f"{base}/out", f"{base}/log", label="rle", block_size=2048)
    return blocks.verify(s.read.parquet(f"{base}/out").drop("epoch"))


def _profiles(s, d):
    return profile.block_profile(_texts(s, d))


@_query("early_raw_and_fast_path", f"""WITH {PROFILE} SELECT block_id, h0 > 7.985 AND greatest(run_score, delta_score, repetition) < 0.002 AND match_length < 4.5 AS early_raw,
CASE WHEN incompressibility > 0.985 AND h0 > 7.985 AND repetition < 0.003 THEN 'raw' WHEN zero_ratio > 0.985 OR run_score > 0.92 THEN 'rle' WHEN repetition > 0.55 AND match_length >= 12 THEN 'lz_fast+huffman' WHEN delta_score > 0.75 AND h0 > 4.0 THEN 'delta+raw+huffman' END AS fast_path FROM prof""")
def early_raw_and_fast_path(s, d):
    p = _profiles(s, d)
    return p.select("block_id", policies.early_raw(p).alias("early_raw"), policies.fast_path("fast").alias("fast_path"))


@_query("candidate_eligibility", f"""WITH {COSTS}, rt(route) AS (VALUES ('generic'), ('numeric-general'), ('numeric-fast'))
SELECT route, label, count(*) AS blocks FROM sc, rt WHERE CASE route WHEN 'numeric-fast' THEN codec = 'numeric' WHEN 'numeric-general' THEN codec IN ('numeric', 'raw', 'rle', 'series', 'lz') ELSE codec <> 'numeric' END GROUP BY ALL""")
def candidate_eligibility(s, d):
    x = _scores(s, d).withColumn("route", F.explode(F.array(*map(F.lit, ("generic", "numeric-general", "numeric-fast")))))
    return x.where(policies.eligible(F.col("route"))).groupBy("route", "label").agg(F.count("*").alias("blocks"))


@_query("weak_rans_penalty", f"""WITH {COSTS} SELECT a.block_id, a.plan, CASE WHEN a.entropy IN ('rans', 'rans4x') AND b.estimate IS NOT NULL AND b.estimate - a.estimate < 0.02::DOUBLE * b.estimate THEN 1 ELSE 0 END AS penalty
FROM sc a LEFT JOIN sc b ON b.entropy = 'huffman' AND a.block_id = b.block_id AND a.transform = b.transform AND a.codec = b.codec AND coalesce(a.lz, '') = coalesce(b.lz, '')""")
def weak_rans_penalty(s, d):
    return policies.weak_rans(_scores(s, d)).select("block_id", "plan", "penalty")


@_query("dominance_envelope", f"WITH {COSTS}, g AS (SELECT block_id, plan, estimate - min(estimate) OVER (PARTITION BY block_id) AS loss, min(estimate) OVER (PARTITION BY block_id) AS best FROM sc) SELECT block_id, plan, loss FROM g WHERE loss <= 2048 OR loss * 1000000 <= best * 10000")
def dominance_envelope(s, d):
    return policies.dominant(_scores(s, d)).select("block_id", "plan", "loss")


@_query("preferred_plan", f"""WITH {COSTS}, g AS (SELECT *, CASE codec WHEN 'raw' THEN 0 WHEN 'rle' THEN 1 ELSE 2 END AS tier, min(estimate) OVER (PARTITION BY block_id) AS best FROM sc)
SELECT block_id, plan, tier, estimate FROM g WHERE estimate <= best + (best * 15000 + 999999) // 1000000 QUALIFY row_number() OVER (PARTITION BY block_id ORDER BY tier, estimate, plan) = 1""")
def preferred_plan(s, d):
    return policies.preferred(_scores(s, d), F.when(F.col("codec") == "raw", 0).when(F.col("codec") == "rle", 1).otherwise(2))


@_query("plan_regret", f"""WITH {COSTS}, {SELECTED}, bs AS (SELECT block_id, min(estimate) AS best FROM sc GROUP BY block_id), lo AS (SELECT estimate - best AS loss FROM sel JOIN bs USING (block_id))
SELECT count(*) AS blocks, round(avg((loss = 0)::INT), 6) AS recall, round(avg(loss), 6) AS mean, quantile_disc(loss, 0.95)::BIGINT AS p95, quantile_disc(loss, 0.99)::BIGINT AS p99 FROM lo""")
def plan_regret(s, d):
    scores = _scores(s, d)
    return policies.regret(scores, planner.selected(scores))


@_query("second_stage_k", f"""WITH {COSTS}, nx AS (SELECT block_id, plan, estimate, confidence, lead(estimate) OVER w AS next, count(*) OVER (PARTITION BY block_id) AS total, row_number() OVER w AS rank FROM sc WINDOW w AS (PARTITION BY block_id ORDER BY score, plan))
SELECT block_id, plan, estimate, next, least(2 + CASE WHEN next IS NOT NULL AND (greatest(next - estimate, 0) / greatest(estimate, 1) < 0.03::DOUBLE OR confidence < 0.8) THEN 1 ELSE 0 END, total)::INT AS k FROM nx WHERE rank = 1""")
def second_stage_k(s, d):
    return policies.second_stage(_scores(s, d))


@_query("sample_ranges", f"""WITH {PROFILE}, c1 AS (SELECT block_id, size, least(3, greatest(size // 1024, 1)) AS count FROM prof), c2 AS (SELECT *, unnest(range(0, count)) AS sample FROM c1),
c3 AS (SELECT block_id, sample, size, CASE WHEN count = 1 THEN 0 ELSE greatest(size - 1024, 0) * sample // (count - 1) END AS s FROM c2) SELECT block_id, sample, s::BIGINT AS "from", least(s + 1024, size)::BIGINT AS "to" FROM c3""")
def sample_ranges(s, d):
    return policies.sample_ranges(_profiles(s, d).select("block_id", "size"), 3, 1024)


@_query("verification_budget", f"""WITH {_prefilter_sql(TIMES)} SELECT block_id, CASE WHEN confidence >= 0.95 THEN 2 WHEN confidence >= 0.8 THEN 3 ELSE 4 END AS k, CASE WHEN confidence >= 0.9 THEN 20 WHEN confidence >= 0.75 THEN 25 ELSE 30 END + 5 AS lz_weight,
CASE WHEN confidence >= 0.9 THEN 25 WHEN confidence >= 0.75 THEN 40 ELSE 55 END AS raw_weight, CASE WHEN 1 - confidence < 0.05 THEN 'high' WHEN 1 - confidence <= 0.15 THEN 'medium' ELSE 'low' END AS class FROM pf""")
def verification_budget(s, d):
    c = F.col("confidence")
    x = profile.numeric_prefilter(_times(s, d))
    return x.select("block_id", policies.adaptive_k(c).alias("k"), policies.blend_weight(F.lit("lz"), c, 2, "balanced").alias("lz_weight"), policies.blend_weight(F.lit("raw"), c, 1, "balanced").alias("raw_weight"), policies.confidence_class(1 - c).alias("class"))


@_query("numeric_margin", f"""WITH nb AS ({ORACLE_SQL["num1_every_mode"]}), b2 AS (SELECT block_id, min(bytes) AS numeric, max(n) * 8 AS raw FROM nb GROUP BY block_id), pt AS (SELECT block_id, bytes AS patched FROM ({ORACLE_SQL["patched_for_plan"]}))
SELECT block_id, numeric, patched, raw - patched >= greatest(32, raw // 100) AS pays, CASE WHEN numeric / patched <= 0.8 THEN 'none' WHEN numeric / patched <= 0.97 THEN 'one-stage' ELSE 'full' END AS budget,
CASE WHEN patched + 32 >= raw THEN 'raw' ELSE 'patched' END AS label, patched <= 0.9::DOUBLE * numeric AND (numeric - patched) * 32 >= raw AS replaces FROM b2 JOIN pt USING (block_id)""")
def numeric_margin(s, d):
    best = estimate.every_mode(_customers(s, d)).groupBy("block_id").agg(F.min("bytes").alias("numeric"), (F.max("n") * 8).alias("raw"))
    x = best.join(estimate.patched(_customers(s, d)).select("block_id", F.col("bytes").alias("patched")), "block_id")
    numeric, other, raw = F.col("numeric"), F.col("patched"), F.col("raw")
    return x.select("block_id", "numeric", "patched", policies.beats_by_margin(raw, other).alias("pays"), policies.hybrid_budget(numeric, other).alias("budget"), policies.raw_fallback(F.lit("patched"), other, raw).alias("label"), policies.series_beats_generic(other, numeric, raw).alias("replaces"))


@_query("symbol_model", f"WITH {KINDS}, c AS (SELECT block_id, v AS value, count(*) AS n FROM l GROUP BY ALL) SELECT block_id, value, greatest(n * 4096 // sum(n) OVER (PARTITION BY block_id), 1)::BIGINT AS base, (n * 4096 % sum(n) OVER (PARTITION BY block_id))::BIGINT AS rest FROM c")
def symbol_model(s, d):
    return policies.symbol_model(profile.histogram(_kinds(s, d)))


@_query("tier_metrics", f"""WITH {COSTS}, {SELECTED} SELECT CASE WHEN block_id % 3 = 0 THEN 'hot' WHEN block_id % 3 = 1 THEN 'warm' ELSE 'cold' END AS tier, count(*) AS blocks, round(sum(estimate) / sum(size), 6) AS stored, round(1 - sum(estimate) / sum(size), 6) AS savings, round(sum(size) / sum(estimate), 6) AS ratio FROM sel GROUP BY ALL""")
def tier_metrics(s, d):
    tier = F.when(F.col("block_id") % 3 == 0, "hot").when(F.col("block_id") % 3 == 1, "warm").otherwise("cold")
    x = planner.selected(_scores(s, d)).groupBy(tier.alias("tier")).agg(F.count("*").alias("blocks"), F.sum("estimate").alias("e"), F.sum("size").alias("z"))
    return x.select("tier", "blocks", F.round(F.col("e") / F.col("z"), 6).alias("stored"), F.round(1 - F.col("e") / F.col("z"), 6).alias("savings"), F.round(S.ratio(F.col("z"), F.col("e")), 6).alias("ratio"))


@_query("plan_json", f"WITH {COSTS}, {SELECTED} SELECT block_id, '{{\"plan\":' || plan || ',\"label\":\"' || label || '\",\"estimate\":' || estimate || '}}' AS json FROM sel")
def plan_json(s, d):
    return planner.selected(_scores(s, d)).select("block_id", F.to_json(F.struct("plan", "label", "estimate")).alias("json"))


@_query("aligned_block_size", "SELECT s_suppkey, (greatest(262144 // (s_suppkey % 300 + 1), 1) * (s_suppkey % 300 + 1))::BIGINT AS aligned FROM supplier")
def aligned_block_size(s, d):
    return _table(s, d, "supplier").select("s_suppkey", S.aligned_block_size(F.lit(262144), F.col("s_suppkey") % 300 + 1).alias("aligned"))


@_query("records_roundtrip", "SELECT event_id // 1000 AS key, count(*) AS n, count(*) AS same FROM events GROUP BY ALL")
def records_roundtrip(s, d):
    from blockwright.sources import records

    schema = records.RecordSchema("event_id:u32,user_id:i64,value:f64")
    rows = _table(s, d, "events").select(F.floor(F.col("event_id") / 1000).alias("key"), "event_id", "user_id", "value")
    data = records.to_records(rows, schema, "key", ["event_id"])
    back = records.from_records(records.join_columns(records.split_columns(data, schema), schema), schema)
    same = back.select("key", "event_id", F.col("user_id").alias("u"), F.col("value").alias("x")).join(rows, ["key", "event_id"])
    return same.groupBy("key").agg(F.count("*").alias("n"), F.count_if((F.col("u") == F.col("user_id")) & (F.col("x") == F.col("value"))).alias("same"))
