"""Gold checks, annotation rules, reports and synthetic data on small tables with nulls, ties and empty sides."""

import math

import pytest
from pyspark.sql import functions as F

from ethogrid.operators import annotation, gold, summaries, synthetic
from ethogrid.streaming import sliding


def test_blank_and_plain_keys(spark):
    t = spark.createDataFrame([("a", 1.0), (" ", math.nan), (None, None), ("..", 2.0), ("x/y", 3.0)], "video_id string, w double")
    assert {tuple(r) for r in gold.blank_counts(t, ["video_id", "w"]).collect()} == {("video_id", 2), ("w", 2)}
    assert {r[0] for r in gold.unplain_ids(t).collect()} == {None, "..", "x/y"}
    assert gold.repeated_keys(t, ["video_id"]).count() == 0
    assert gold.undated(spark.createDataFrame([("a", None), ("b", "2024-01-01"), ("c", " ")], "video_id string, date string")).count() == 2


def test_fps_spread_edges(spark):
    schema = "g string, video_fps double"
    t = spark.createDataFrame([("even", 30.0), ("even", 30.2), ("wide", 30.0), ("wide", 60.0), ("bad", 30.0), ("bad", math.inf), ("none", None)], schema)
    got = {r["g"]: (r["bad"], r["uniform"]) for r in gold.fps_spread(t, 0.01, ("g",)).collect()}
    assert got == {"even": (0, True), "wide": (0, False), "bad": (1, False), "none": (1, False)}
    empty = gold.fps_spread(t.where("false"), 0.01).collect()[0]
    assert (empty["videos"], empty["uniform"]) == (0, False)


def test_evidence_and_forbidden_columns(spark):
    v = spark.createDataFrame([("a",), ("b",), ("c",)], "video_id string")
    e = spark.createDataFrame([("a", True), ("b", False)], "video_id string, has_detections boolean")
    assert [r[0] for r in gold.evidence_conflicts(v, e, True).collect()] == ["b"]
    assert [r[0] for r in gold.evidence_conflicts(v, e, False).collect()] == ["a"]
    columns = ["speed_mean", "video_path", "h2o_ml", "sex", "Date"]
    assert gold.forbidden_columns(columns) == ["video_path", "h2o_ml", "sex"]
    assert gold.forbidden_columns(columns, demographics=True) == ["video_path", "h2o_ml"]


def test_annotation_rules(spark):
    schema = "i int, annotator string, fish_visible boolean, box array<double>, keypoints map<string,array<double>>, listing string"
    box = [0.0, 0.0, 10.0, 10.0]
    rows = [
        (0, "a", True, box, None, "none"), (1, None, True, box, None, "none"), (2, "a\n", True, box, None, "none"), (3, "a", None, box, None, "none"),
        (4, "a", False, None, None, None), (5, "a", False, None, {"nose": [1.0, 1.0, 1.0]}, None), (6, "a", True, box[:3], None, "none"),
        (7, "a", True, [0.0, 0.0, math.nan, 9.0], None, "none"), (8, "a", True, [0.0, 0.0, 101.0, 9.0], None, "none"), (9, "a", True, [0.0, 0.0, 1.0, 9.0], None, "none"),
        (10, "a", True, box, None, None), (11, "a", True, box, {"leg": [1.0, 1.0, 1.0]}, "none"), (12, "a", True, box, {"nose": [1.0, 1.0]}, "none"),
        (13, "a", True, box, {"nose": [1.0, 1.0, 5.0]}, "none"), (14, "a", True, box, {"nose": [-1.0, 1.0, 1.0]}, "none"), (15, "a", True, box, {"nose": [-1.0, 1.0, 0.0]}, "none"),
    ]
    got = {r["i"]: r["error"] for r in annotation.annotation_errors(spark.createDataFrame(rows, schema), 100, 100, ("none",), ("nose",), 4.0).collect()}
    assert [got[i] for i in range(16)] == [
        None, "annotator", "annotator", "fish_visible", None, "marks on an empty frame", "box", "box", "box outside", "box too small", "listing", "unknown keypoint", "keypoint",
        "keypoint visibility", "keypoint outside", None,
    ]


def test_lists_overlay_and_rounding(spark):
    rows = spark.createDataFrame([("done", 0.25, 0.0), ("no_fish", 0.75, 5.0), ("todo", None, 9.0)], "status string, x double, t_sec double")
    assert annotation.listing(rows, status="done").count() == 2
    assert annotation.listing(rows, status=None).count() == 3
    assert [r[0] for r in annotation.rounded(rows).select("x").collect()] == [0.2, 0.8, None]
    assert annotation.overlay(rows, 0.0, 5.0).count() == 1
    for end in (0.0, 30.5):
        with pytest.raises(ValueError):
            annotation.overlay(rows, 0.0, end)


def test_trail_runs_against_a_loop(spark):
    tracks = [("a", i, float(i), 1.0 if i != 7 else None, i not in (3, 9)) for i in range(12) if i != 5]
    t = spark.createDataFrame(tracks, "video_id string, frame_idx int, x double, y double, detected boolean")
    asked = spark.createDataFrame([("a", 11), ("a", 4), ("b", 2)], "video_id string, now_idx int")
    got = {(r["now_idx"], r["run"]): [p["frame_idx"] for p in r["points"]] for r in annotation.trail_runs(t, asked, 4.0).collect()}
    assert got == {(11, 1): [4], (11, 2): [6], (11, 3): [8], (11, 4): [10, 11], (4, 1): [0, 1, 2], (4, 2): [4]}


def test_reports(spark):
    t = spark.createDataFrame([("a", True, None, 1), ("b", None, False, 0), ("c", False, True, None)], "id string, low boolean, odd boolean, bouts int")
    assert {tuple(r) for r in summaries.flagged(t, ["low", "odd"], ["id"]).collect()} == {("a", True, False), ("c", False, True)}
    assert [tuple(r) for r in summaries.states_shown(t, {"s": "bouts"}).collect()] == [("s", 1)]
    a, b = (spark.createDataFrame([(k,) for k in ks], "k int") for ks in ([1, 1, 2, None], [2, 3]))
    assert {tuple(r) for r in summaries.symmetric_difference(a, b, "k").collect()} == {(1, "left"), (3, "right")}


def test_vehicle_scores_skip_one_sided_repeats(spark):
    rows = []
    for repeat, labels in ((0, [0, 0, 1, 1]), (1, [1, 1, 1, 1])):
        for i, (label, p) in enumerate(zip(labels, (0.9, 0.4, 0.6, 0.1), strict=True)):
            rows += [("m", repeat, i, label, 0, p), ("m", repeat, i, label, 1, 1 - p)]
    long = spark.createDataFrame(rows, "model string, repeat int, vec_id int, label int, cls int, p double")
    got = summaries.vehicle_scores(long, 0).collect()
    assert [tuple(r) for r in got] == [("m", 0.75, 0.0, 0.5, 0.0)]


def test_synthetic_rows_do_not_depend_on_partitions(spark):
    knobs = synthetic.Knobs(frames=20, detected=0.5)
    made = [sorted(map(tuple, synthetic.tracks(synthetic.subjects(spark.range(0, 30, 1, n), knobs), knobs).collect())) for n in (1, 5)]
    assert made[0] == made[1] and len(made[0]) == 600
    share = sum(r[-1] for r in made[0]) / 600
    assert 0.4 < share < 0.6
    other = synthetic.Knobs(seed=2, frames=20, detected=0.5)
    assert sorted(map(tuple, synthetic.tracks(synthetic.subjects(spark.range(30), other), other).collect())) != made[0]
    big = synthetic.subjects(spark.range(3000), synthetic.Knobs()).groupBy("compound").count().collect()
    assert len(big) == 3 and all(850 < r["count"] < 1150 for r in big)


def test_sliding_windows_as_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", h, 1.0 * h) for h in range(6)], "video_id string, h int, score double")
    rows = rows.select("video_id", F.timestamp_seconds(F.col("h") * 3600).alias("ts"), "score")
    rows.write.parquet(str(tmp_path / "in"))
    batch = {(r["start"], r["n"], r["mean_score"]) for r in sliding.stream_sliding(rows, "3 hours", "1 hour").collect()}
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = sliding.stream_sliding(stream, "3 hours", "1 hour").writeStream.outputMode("complete").format("memory").queryName("slid").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["start"], r["n"], r["mean_score"]) for r in spark.table("slid").collect()} == batch and len(batch) == 8
