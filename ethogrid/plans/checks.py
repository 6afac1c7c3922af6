"""Queries of the gold checks, annotations, reports and synthetic data, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethogrid.operators import annotation, gold, summaries, synthetic
from ethogrid.plans.behaviour import r6
from ethogrid.plans.subjects import FISH, PRED, duration_mismatches
from ethogrid.sources import adapters
from ethogrid.streaming import sliding

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return keep


@query(FISH + """SELECT * FROM (SELECT 'f_mean_price' AS "column", count(*) FILTER (f_mean_price IS NULL) AS blanks FROM fish
  UNION ALL SELECT 'sex', count(*) FILTER (sex IS NULL) FROM fish UNION ALL SELECT 'code', count(*) FILTER (f_orders < 4) FROM fish) WHERE blanks > 0""")
def blank_keys(spark, sf) -> DataFrame:
    t = adapters.subjects(spark, sf).withColumn("code", F.when(F.col("f_orders") < 4, "  ").otherwise("x"))
    return gold.blank_counts(t, ["f_mean_price", "sex", "code", "video_id"])


@query("SELECT l_orderkey, l_partkey, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def repeated_keys(spark, sf):
    return gold.repeated_keys(adapters.read(spark, sf, "lineitem"), ["l_orderkey", "l_partkey"])


@query("""SELECT s_nationkey, count(*) AS videos, count(*) FILTER (s_acctbal <= 0) AS bad, CAST(min(s_acctbal) FILTER (s_acctbal > 0) AS DOUBLE) AS low, CAST(max(s_acctbal) FILTER (s_acctbal > 0) AS DOUBLE) AS high,
  count(*) FILTER (s_acctbal <= 0) = 0 AND coalesce(max(s_acctbal) - min(s_acctbal) <= 5.0 * min(s_acctbal), false) AS uniform FROM supplier GROUP BY s_nationkey""")
def fps_spread(spark, sf):
    return gold.fps_spread(adapters.read(spark, sf, "supplier").withColumn("video_fps", F.col("s_acctbal")), 5.0, ("s_nationkey",))


@query("""SELECT c_custkey AS video_id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING NOT bool_or(o_orderstatus = 'P'))""")
def evidence_conflicts(spark, sf):
    videos = adapters.read(spark, sf, "customer").select(F.col("c_custkey").alias("video_id"))
    found = adapters.read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("video_id")).agg(F.bool_or(F.col("o_orderstatus") == "P").alias("has_detections"))
    return gold.evidence_conflicts(videos, found, True)


@query("""WITH t AS (SELECT p_partkey, ['veh', ' MDMA', 'Methyl One', 'caffeine', 'DOB'][p_partkey % 5 + 1] AS c, ['0.03', '0.1 ', '1% DMSO', '5'][p_partkey % 4 + 1] AS d FROM part)
SELECT p_partkey, replace(lower(trim(c)), ' ', '') AS compound, CASE lower(trim(d)) WHEN '0.03' THEN 30 WHEN '0.1' THEN 100 ELSE 0 END AS micromolar FROM t
WHERE (c = 'veh' AND d = '1% DMSO') OR (c NOT IN ('veh', 'caffeine') AND d IN ('0.03', '0.1 '))""")
def reference_groups(spark, sf):
    k = F.col("p_partkey")
    c = F.get(F.array(*map(F.lit, ("veh", " MDMA", "Methyl One", "caffeine", "DOB"))), (k % 5).cast("int"))
    d = F.get(F.array(*map(F.lit, ("0.03", "0.1 ", "1% DMSO", "5"))), (k % 4).cast("int"))
    got = adapters.read(spark, sf, "part").select("p_partkey", gold.reference_group(c, d).alias("g")).where("g is not null")
    return got.select("p_partkey", "g.compound", "g.micromolar")


@query("""WITH v AS (SELECT vec_id, list_transform(embedding[1:5], lambda q: CAST(q AS DOUBLE)) AS e FROM embeddings),
b AS (SELECT vec_id, 320 + 2000 * e[1] AS x0, 240 + 2000 * e[2] AS y0, 320 + 2000 * e[1] + 300 * e[3] AS x1, 240 + 2000 * e[2] + 300 * e[4] AS y1, 320 + 2000 * e[5] AS nose FROM v)
SELECT vec_id, CASE WHEN vec_id % 17 = 0 THEN 'annotator' WHEN vec_id % 5 = 0 THEN CASE WHEN vec_id % 10 <> 0 THEN 'marks on an empty frame' END
  WHEN x0 < 0 OR y0 < 0 OR x1 > 640 OR y1 > 480 THEN 'box outside' WHEN x1 - x0 < 2 OR y1 - y0 < 2 THEN 'box too small' WHEN vec_id % 4 = 3 THEN 'listing'
  WHEN vec_id % 7 = 0 THEN 'unknown keypoint' WHEN vec_id % 11 = 0 THEN 'keypoint visibility' WHEN vec_id % 3 <> 0 AND (nose < 0 OR nose > 640) THEN 'keypoint outside' END AS error FROM b""")
def annotation_errors(spark, sf):
    k = F.col("vec_id")
    e = [F.element_at("embedding", i).cast("double") for i in range(1, 6)]
    x, y = 320 + 2000 * e[0], 240 + 2000 * e[1]
    nose = F.array(320 + 2000 * e[4], F.lit(240.0), (k % 3).cast("double"))
    tail = F.array(F.lit(10.0), F.lit(20.0), F.when(k % 11 == 0, 3.0).otherwise(2.0))
    kept = k % 10 != 0
    rows = adapters.read(spark, sf, "embeddings").select(
        "vec_id", F.when(k % 17 == 0, " ").otherwise("ann").alias("annotator"), (k % 5 != 0).alias("fish_visible"),
        F.when(kept, F.array(x, y, x + 300 * e[2], y + 300 * e[3])).alias("box"),
        F.when(kept, F.create_map(F.lit("nose"), nose, F.when(k % 7 == 0, "beak").otherwise("tail"), tail)).alias("keypoints"),
        F.when(kept, F.get(F.array(*map(F.lit, ("none", "left", "right", "up"))), (k % 4).cast("int"))).alias("listing"),
    )
    return annotation.annotation_errors(rows, 640, 480, ("none", "left", "right"), ("nose", "tail"), 2.0).select("vec_id", "error")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' ELSE 'no_fish' END AS status FROM orders WHERE o_orderstatus IN ('F', 'P')")
def filtered_list(spark, sf):
    s = F.col("o_orderstatus")
    rows = adapters.read(spark, sf, "orders").select(
        "o_orderkey", F.when(s == "F", "done").when(s == "P", "no_fish").otherwise("todo").alias("status"), F.lit("first").alias("batch")
    )
    return annotation.listing(rows, status="done", batch="first", reason=None).select("o_orderkey", "status")


@query("""WITH n AS (SELECT user_id, event_type <> 'error' AS seen, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS nth FROM events),
t AS (SELECT 'F_' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS video_id, CAST(nth + nth // 10 AS INTEGER) AS i, seen FROM n), a AS (SELECT video_id, max(i) AS now_idx FROM t GROUP BY video_id),
s AS (SELECT t.video_id, now_idx, i, CASE WHEN i - lag(i) OVER (PARTITION BY t.video_id ORDER BY i) = 1 THEN 0 ELSE 1 END AS b FROM t JOIN a ON a.video_id = t.video_id WHERE seen AND i >= now_idx - 60),
r AS (SELECT *, sum(b) OVER (PARTITION BY video_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM s)
SELECT video_id, now_idx, CAST(run AS BIGINT) AS run, min(i) AS first_idx, max(i) AS last_idx, count(*) AS n FROM r GROUP BY video_id, now_idx, run""")
def trail_runs(spark, sf):
    t = adapters.tracks(spark, sf)
    return annotation.trail_runs(t, t.groupBy("video_id").agg(F.max("frame_idx").alias("now_idx")), 30.0).drop("points")


@query(FISH + "SELECT video_id, compound, f_orders, f_orders < 3 AS low, coalesce(f_mean_price > 150000, false) AS odd FROM fish WHERE f_orders < 3 OR f_mean_price > 150000")
def flagged_subjects(spark, sf):
    t = adapters.subjects(spark, sf).withColumn("low", F.col("f_orders") < 3).withColumn("odd", F.col("f_mean_price") > 150000)
    return summaries.flagged(t, ["low", "odd"], ["video_id", "compound", "f_orders"])


@query(FISH + "SELECT 'orders' AS state, count(*) FILTER (f_orders > 0) AS animals FROM fish UNION ALL SELECT 'credit', count(*) FILTER (f_acctbal > 0) FROM fish")
def states_shown(spark, sf):
    return summaries.states_shown(adapters.subjects(spark, sf), {"orders": "f_orders", "credit": "f_acctbal"})


@query("""WITH m AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE 1200.0 END AS e, CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE 1160.0 + c_custkey % 80 END AS d FROM customer)
SELECT CASE WHEN d IS NULL THEN 'corrupt' ELSE 'mismatch' END AS kind, count(*) AS n FROM m WHERE d IS NULL OR e IS NULL OR abs(d - e) > 30 GROUP BY ALL""")
def exception_counts(spark, sf):
    return summaries.exception_counts(duration_mismatches(spark, sf))


@query("""SELECT event_type AS model, count(*) AS questions, count(*) FILTER (value > 20) AS tool_ok, count(*) FILTER (user_id % 3 = 0) AS args_ok, round(median(value), 6) + 0 AS median_s, round(max(value), 6) + 0 AS slowest_s
FROM events GROUP BY event_type""")
def answer_scores(spark, sf):
    e = adapters.read(spark, sf, "events").select(
        F.col("event_type").alias("model"), F.col("value").alias("seconds"), (F.col("value") > 20).alias("tool_ok"), (F.col("user_id") % 3 == 0).alias("args_ok")
    )
    return summaries.answer_scores(e, ["tool_ok", "args_ok"]).select("model", "questions", "tool_ok", "args_ok", *r6("median_s", "slowest_s"))


@query(PRED + """, v AS (SELECT lp.vec_id % 2 AS model, lp.vec_id % 5 AS repeat, lp.label = 3 AS veh, lp.p, pr.predicted = 3 AS said FROM lp JOIN pr ON pr.vec_id = lp.vec_id WHERE lp.cls = 3),
k AS (SELECT *, rank() OVER (PARTITION BY model, repeat ORDER BY p) + (count(*) OVER (PARTITION BY model, repeat, p) - 1) / 2.0 AS rk FROM v),
s AS (SELECT model, repeat, (sum(rk) FILTER (veh) - count(*) FILTER (veh) * (count(*) FILTER (veh) + 1) / 2.0) / (count(*) FILTER (veh) * count(*) FILTER (NOT veh)) AS auroc,
  (avg(CASE WHEN said THEN 1.0 ELSE 0.0 END) FILTER (veh) + avg(CASE WHEN said THEN 0.0 ELSE 1.0 END) FILTER (NOT veh)) / 2 AS ba FROM k GROUP BY ALL HAVING count(*) FILTER (veh) > 0 AND count(*) FILTER (NOT veh) > 0)
SELECT model, round(avg(auroc), 6) + 0 AS auroc_mean, round(coalesce(stddev_samp(auroc), 0), 6) + 0 AS auroc_sd, round(avg(ba), 6) + 0 AS balanced_accuracy_mean, round(coalesce(stddev_samp(ba), 0), 6) + 0 AS balanced_accuracy_sd FROM s GROUP BY model""")
def vehicle_scores(spark, sf):
    long = adapters.predictions(spark, sf).withColumn("model", F.col("vec_id") % 2).withColumn("repeat", F.col("vec_id") % 5)
    return summaries.vehicle_scores(long, 3).select("model", *r6("auroc_mean", "auroc_sd", "balanced_accuracy_mean", "balanced_accuracy_sd"))


@query("""WITH a AS (SELECT DISTINCT p_size AS k FROM part), b AS (SELECT DISTINCT CAST(s_nationkey * 3 AS INTEGER) AS k FROM supplier)
SELECT k, 'left' AS side FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'right' FROM b WHERE k NOT IN (SELECT k FROM a)""")
def symmetric_difference(spark, sf):
    left = adapters.read(spark, sf, "part").select(F.col("p_size").cast("int").alias("k"))
    return summaries.symmetric_difference(left, adapters.read(spark, sf, "supplier").select((F.col("s_nationkey") * 3).cast("int").alias("k")), "k")


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def first_seen(spark, sf):
    return summaries.first_seen(adapters.read(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query(FISH + "SELECT video_id, concentration_mM AS label FROM fish WHERE compound = 'MACHINERY' UNION ALL SELECT video_id, '0' FROM fish WHERE compound = 'BUILDING'")
def dose_rows(spark, sf):
    return summaries.dose_rows(adapters.subjects(spark, sf), "MACHINERY", "BUILDING").select("video_id", "label")


@query("""WITH d AS (SELECT CAST(user_id AS VARCHAR) AS video_id, epoch_us(ts) // 86400000000 - unnest([0, 1, 2]) AS day, value FROM events)
SELECT video_id, day, count(*) AS n, round(avg(value), 6) + 0 AS mean_score FROM d GROUP BY video_id, day""")
def sliding_windows(spark, sf):
    e = adapters.read(spark, sf, "events").select(F.col("user_id").cast("string").alias("video_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("score"))
    got = sliding.stream_sliding(e, "3 days", "1 day")
    return got.select("video_id", F.floor(F.unix_micros("start") / 86_400_000_000).alias("day"), "n", *r6("mean_score"))


def _mix(a: str, b: str, salt: int) -> str:
    first = f"((CAST({a} AS BIGINT) * 7919 + {b} * 104729 + {salt * 611_953}) % 1000003)"
    return f"((({first} * 48271 + ({first} % 1009) * ({first} % 1013) + {salt}) % 1000003) / 1000003.0::DOUBLE)"


@query(f"""WITH s AS (SELECT s_suppkey AS id, CAST(floor({_mix('s_suppkey', '0', 101)} * 3) AS INTEGER) AS c, CAST(floor({_mix('s_suppkey', '0', 103)} * 8) AS INTEGER) AS d FROM supplier),
f AS (SELECT *, CAST(unnest(range(0, 50)) AS INTEGER) AS k FROM s),
w AS (SELECT id, c, d, k, {_mix('id', 'k', 108)} < 0.95 AS seen, CASE WHEN {_mix('id', 'k', 105)} < 0.4 THEN 0.0::DOUBLE ELSE 6.0::DOUBLE * (1 + 0.5::DOUBLE * c) END AS size, {_mix('id', 'k', 106)} AS u, {_mix('id', 'k', 107)} AS v FROM f),
p AS (SELECT id, k, seen, 320 + 3.0::DOUBLE * d + sum(size * (2 * u - 1)) OVER (PARTITION BY id ORDER BY k ROWS UNBOUNDED PRECEDING) AS x, 240 + sum(size * (2 * v - 1)) OVER (PARTITION BY id ORDER BY k ROWS UNBOUNDED PRECEDING) AS y FROM w)
SELECT 'S_' || lpad(CAST(id AS VARCHAR), 7, '0') AS video_id, k AS frame_idx, seen AS detected, round(CASE WHEN seen THEN least(greatest(x, 0), 640) ELSE 0 END, 6) + 0 AS x, round(CASE WHEN seen THEN least(greatest(y, 0), 480) ELSE 0 END, 6) + 0 AS y FROM p""")
def synthetic_tracks(spark, sf):
    knobs = synthetic.Knobs()
    made = synthetic.subjects(adapters.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id")), knobs)
    return synthetic.tracks(made, knobs).select("video_id", "frame_idx", "detected", *r6("x", "y"))


@query(f"""WITH s AS (SELECT c_custkey AS id, {_mix('c_custkey', '0', 101)} AS a, {_mix('c_custkey', '0', 102)} AS b, {_mix('c_custkey', '0', 103)} AS c, {_mix('c_custkey', '0', 104)} AS e FROM customer)
SELECT 'S_' || lpad(CAST(id AS VARCHAR), 7, '0') AS video_id, ['veh', 'alpha', 'beta'][CAST(floor(a * 3) AS INTEGER) + 1] AS compound, CASE WHEN a * 3 < 1 THEN '0' ELSE ['0.03', '0.1'][CAST(floor(b * 2) AS INTEGER) + 1] END AS concentration_mM,
  CAST(DATE '2024-01-01' + CAST(floor(c * 8) AS INTEGER) AS DATE) AS date, CASE WHEN e < 0.5 THEN 'F' ELSE 'M' END AS sex FROM s""")
def synthetic_subjects(spark, sf):
    made = synthetic.subjects(adapters.read(spark, sf, "customer").select(F.col("c_custkey").alias("id")), synthetic.Knobs())
    return made.select("video_id", "compound", "concentration_mM", "date", "sex")
