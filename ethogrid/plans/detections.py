"""Queries of the detection operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethogrid.operators import detection, evaluation
from ethogrid.plans.behaviour import _states, consolidated_states, r6
from ethogrid.plans.behaviour_sql import BINS, STATES, TRACKS
from ethogrid.sources import adapters

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


_BOX = """WITH v AS (SELECT vec_id, label, list_transform(embedding[1:8], lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
b AS (SELECT vec_id, CASE WHEN vec_id % 6 > 0 THEN 1 END AS has, CASE WHEN vec_id % 7 > 0 THEN 1 END AS pred, least(e[1], e[3]) AS a0, least(e[2], e[4]) AS a1, greatest(e[1], e[3]) AS a2, greatest(e[2], e[4]) AS a3,
  least(e[1], e[3]) + 0.01 AS b0, least(e[2], e[4]) - 0.02 AS b1, greatest(e[1], e[3]) + 0.01 AS b2, greatest(e[2], e[4]) AS b3 FROM v),
i AS (SELECT *, CASE WHEN pred IS NULL THEN 0 ELSE greatest(least(a2, b2) - greatest(a0, b0), 0) * greatest(least(a3, b3) - greatest(a1, b1), 0) END AS x, (a2 - a0) * (a3 - a1) + (b2 - b0) * (b3 - b1) AS s FROM b),
j AS (SELECT *, CASE WHEN has = 1 THEN CASE WHEN pred = 1 AND s - x > 0 THEN x / (s - x) ELSE 0 END END AS iou FROM i)
"""


@query(_BOX + """SELECT count(has) AS n_positive, count(*) - count(has) AS n_negative, round(avg(CASE WHEN pred = 1 THEN 1.0 ELSE 0.0 END) FILTER (has = 1), 6) + 0 AS detection_rate,
  round(avg(CASE WHEN iou >= 0.5 THEN 1.0 ELSE 0.0 END) FILTER (has = 1), 6) + 0 AS recall, round(avg(iou), 6) + 0 AS mean_iou, count(*) FILTER (has IS NULL AND pred = 1) AS false_positives FROM j""")
def tracker_scores(spark, sf) -> DataFrame:
    e = [F.element_at("embedding", k).cast("double") for k in range(1, 5)]
    lo, hi = [F.least(e[0], e[2]), F.least(e[1], e[3])], [F.greatest(e[0], e[2]), F.greatest(e[1], e[3])]
    box, pred = F.array(*lo, *hi), F.array(lo[0] + 0.01, lo[1] - 0.02, hi[0] + 0.01, hi[1])
    rows = adapters.read(spark, sf, "embeddings").select("vec_id", F.when(F.col("vec_id") % 6 > 0, box).alias("box"), F.when(F.col("vec_id") % 7 > 0, pred).alias("pred_box"))
    got = detection.tracker_scores(rows)
    return got.select("n_positive", "n_negative", *r6("detection_rate", "recall", "mean_iou"), "false_positives")


@query("""WITH s AS (SELECT CAST(value AS DOUBLE) / 50 AS score, event_type = 'click' AS yes FROM events), t AS (SELECT * FROM (VALUES (0.1::DOUBLE), (0.3::DOUBLE), (0.7::DOUBLE)) v(threshold))
SELECT threshold, round_even(count(*) FILTER (yes AND score >= threshold) / count(*) FILTER (yes), 3) AS recall,
  round_even(count(*) FILTER (yes AND score >= threshold) / greatest(1, count(*) FILTER (score >= threshold)), 3) AS "precision", count(*) FILTER (NOT yes AND score >= threshold) AS false_positives FROM t, s GROUP BY threshold""")
def threshold_table(spark, sf):
    s = adapters.read(spark, sf, "events").select((F.col("value") / 50).alias("score"), (F.col("event_type") == "click").alias("yes"))
    return detection.threshold_table(s, [0.1, 0.3, 0.7])


@query(TRACKS + STATES.strip() + BINS.rstrip().rstrip(",") + """, n AS (SELECT st.video_id, st.frame_idx, st.state AS a, wn.winner AS b FROM st JOIN wn ON st.video_id = wn.video_id AND CAST(floor(st.t_sec / 24.0 + 1e-9) AS INTEGER) = wn.bin)
SELECT video_id, count(*) AS rows, round(avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) FILTER (a <> 'Undetermined' AND b <> 'Undetermined'), 6) + 0 AS agreement FROM n GROUP BY video_id""")
def compare_runs(spark, sf):
    """Raw states against consolidated ones."""
    return detection.compare_runs(_states(spark, sf), consolidated_states(spark, sf)).select("video_id", "rows", *r6("agreement"))


@query("""WITH s AS (SELECT CASE WHEN event_id % 4 = 0 THEN 'test' ELSE 'train' END AS split, 'b' || CAST(user_id % 3 AS VARCHAR) AS batch, event_type FROM events),
u AS (SELECT 'split' AS kind, split AS name, event_type FROM s UNION ALL SELECT 'batch', batch, event_type FROM s)
SELECT kind, name, count(*) AS total, count(*) FILTER (event_type IN ('click', 'view')) AS done FROM u GROUP BY ALL""")
def progress(spark, sf):
    kind = F.col("event_type")
    status = F.when(kind == "click", "done").when(kind == "view", "no_fish").otherwise("open")
    split = F.when(F.col("event_id") % 4 == 0, "test").otherwise("train")
    s = adapters.read(spark, sf, "events").select(split.alias("split"), F.concat(F.lit("b"), (F.col("user_id") % 3).cast("string")).alias("batch"), status.alias("status"))
    return detection.progress(s)


_PIXELS = """WITH p AS (SELECT CAST(l_partkey % 40 AS INTEGER) AS y, CAST(l_suppkey % 8 AS INTEGER) AS x, CAST(l_quantity AS INTEGER) + CASE WHEN l_partkey % 40 >= 17 THEN 60 ELSE 0 END AS value FROM lineitem),
m AS (SELECT y, x, CAST(round_even(median(value), 0) AS INTEGER) AS value FROM p GROUP BY y, x)
"""


def _pixels(spark, sf):
    y = F.col("l_partkey") % 40
    value = F.col("l_quantity").cast("int") + F.when(y >= 17, 60).otherwise(0)
    return adapters.read(spark, sf, "lineitem").select(y.cast("int").alias("y"), (F.col("l_suppkey") % 8).cast("int").alias("x"), value.alias("value"))


@query(_PIXELS + "SELECT * FROM m")
def median_background(spark, sf):
    return detection.median_background(_pixels(spark, sf))


@query(_PIXELS + """, r AS (SELECT y, avg(value) AS v FROM m GROUP BY y), g AS (SELECT y, abs(v - lag(v) OVER (ORDER BY y)) AS g FROM r)
SELECT y FROM g WHERE y - 1 >= 5 AND y - 1 < (SELECT max(y) FROM g) - 5 ORDER BY g DESC, y LIMIT 1""")
def waterline(spark, sf):
    return detection.waterline(detection.median_background(_pixels(spark, sf)))


@query("""WITH d AS (SELECT CAST(user_id AS VARCHAR) AS video_id, event_id AS frame_idx, value AS score, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
SELECT video_id, frame_idx, CASE WHEN score >= 5 THEN k + 2 ELSE 0 END AS x, CASE WHEN score >= 5 THEN k / 2 + 1 ELSE 0 END AS y,
  round(CASE WHEN score >= 5 AND sqrt((k - 50) * (k - 50) + (score - 10) * (score - 10)) > 1 THEN ((degrees(atan2(score - 10, k - 50)) % 180.0) + 180.0) % 180.0 END, 6) + 0 AS orientation_deg,
  CASE WHEN score >= 5 THEN k / 2 + 1 END AS y_from_frame_top, score >= 5 AS detected FROM d""")
def detection_tracks(spark, sf):
    k = F.get_json_object("props", "$.k").cast("double")
    d = adapters.read(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("video_id"), F.col("event_id").alias("frame_idx"), F.col("value").alias("score"), k.alias("x0"), (k + 4).alias("x1"), (k / 2).alias("y0"), (k / 2 + 2).alias("y1"),
        k.alias("head_x"), F.lit(50.0).alias("tail_x"), F.col("value").alias("head_y"), F.lit(10.0).alias("tail_y"),
    )
    return detection.detection_tracks(d, 5.0).select("video_id", "frame_idx", "x", "y", *r6("orientation_deg"), "y_from_frame_top", "detected")


@query("""WITH s AS (SELECT CASE user_id % 3 WHEN 0 THEN 'base' WHEN 1 THEN 'm1' ELSE 'm2' END AS model, CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS scheme, value AS v FROM events),
g AS (SELECT model, scheme, avg(v) AS m FROM s GROUP BY ALL) SELECT g.model, g.scheme, round(g.m - b.m, 6) + 0 AS delta FROM g JOIN g b ON b.model = 'base' AND b.scheme = g.scheme""")
def score_deltas(spark, sf):
    model = F.when(F.col("user_id") % 3 == 0, "base").when(F.col("user_id") % 3 == 1, "m1").otherwise("m2")
    s = adapters.read(spark, sf, "events").select(model.alias("model"), F.when(F.col("event_id") % 2 == 0, "A").otherwise("B").alias("scheme"), F.col("value").alias("balanced_accuracy"))
    return detection.score_cells(evaluation.summary(s, ["model", "scheme"], ["balanced_accuracy"]), "base").select("model", "scheme", *r6("delta"))


@query()
def annotation_queue(spark, sf):
    """The rows of all tracks to annotate next: tilted ones, then unsure ones, in turns between compounds, away from rows annotated already."""
    from ethogrid.operators import design

    t = adapters.tracks(spark, sf)
    number = F.substring("video_id", 3, 10).cast("int")
    compound = F.element_at(F.array(*[F.lit(c) for c in "ABCDE"]), (number % 5 + 1).cast("int"))
    scanned = t.where("detected").select(
        "video_id", "frame_idx", F.lit(2.0).alias("fps"), compound.alias("compound"), F.when(number % 4 == 0, "test").otherwise("train").alias("split"),
        (F.col("event_id") % 10 / 10.0).alias("box_score"), F.col("orientation_deg").alias("tilt"),
    )
    annotated = t.where("event_id % 50 = 0").select("video_id", "frame_idx")
    return design.select_candidates(scanned, annotated, {"train": (300, 150), "test": (60, 30)}, 5, gap_s=5.0)


@query("""WITH p AS (SELECT unnest([1, 2, 3, 4]) AS i), e AS (SELECT i, vec_id % 3 AS v, embedding[2 * i - 1]::DOUBLE AS x, embedding[2 * i]::DOUBLE AS y, CASE WHEN vec_id % 5 > 0 THEN embedding[2 * i + 7]::DOUBLE END AS px, embedding[2 * i + 8]::DOUBLE AS py FROM embeddings, p)
SELECT 'k' || i AS name, count(d) AS n, round(avg(d), 6) + 0 AS mean, round(median(d), 6) + 0 AS median FROM (SELECT i, CASE WHEN v > 0 AND px IS NOT NULL THEN sqrt((px - x) * (px - x) + (py - y) * (py - y)) END AS d FROM e) GROUP BY i""")
def keypoint_errors(spark, sf):
    """Pixel errors of four keypoints of every vector: components 1 to 8 are true places, 9 to 16 predicted ones."""
    e, at = adapters.read(spark, sf, "embeddings"), lambda k: F.get("embedding", F.lit(k)).cast("double")
    points = [F.struct(F.lit(f"k{i}").alias("name"), at(2 * i - 2).alias("x"), at(2 * i - 1).alias("y"), (F.col("vec_id") % 3).alias("v"), F.when(F.col("vec_id") % 5 > 0, at(2 * i + 6)).alias("px"), at(2 * i + 7).alias("py")) for i in range(1, 5)]
    return detection.keypoint_errors(e.select(F.inline(F.array(*points)))).select("name", "n", *r6("mean", "median"))
