"""Detections and annotations: tracker scores, threshold tables, run comparison, progress, pixels by row, predictions lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ethogrid.functions.scalars import axis_orientation, box_iou, hypot
from ethogrid.schemas import UNDETERMINED

IOU_FOUND, EDGE_MARGIN = 0.5, 5


def tracker_scores(examples: DataFrame) -> DataFrame:
    """One row of ``examples`` (image, box, pred_box; null where there is none): detection rate, recall at IoU 0.5, mean IoU, false positives."""
    truth, found = F.col("box").isNotNull(), F.col("pred_box").isNotNull()
    iou = F.when(truth, F.when(found, box_iou(F.col("pred_box"), F.col("box"))).otherwise(0.0))
    return examples.withColumn("iou", iou).agg(
        F.count_if(truth).alias("n_positive"), F.count_if(~truth).alias("n_negative"), F.avg(F.when(truth, found.cast("double"))).alias("detection_rate"),
        F.avg(F.when(truth, (F.col("iou") >= IOU_FOUND).cast("double"))).alias("recall"), F.avg("iou").alias("mean_iou"),
        F.count_if(~truth & found).alias("false_positives"),
    )


def keypoint_errors(points: DataFrame) -> DataFrame:
    """(name, n, mean, median) of pixel errors of ``points`` (name, x, y, v, px, py): visible ones that were predicted."""
    err = F.when((F.col("v") > 0) & F.col("px").isNotNull(), hypot(F.col("px") - F.col("x"), F.col("py") - F.col("y")))
    return points.withColumn("e", err).groupBy("name").agg(F.count("e").alias("n"), F.avg("e").alias("mean"), F.median("e").alias("median"))


def threshold_table(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, recall, precision, false_positives) of ``scored`` (score, yes), in one pass for all thresholds."""
    aggs = [F.count_if("yes").alias("n_yes")]
    for i, t in enumerate(thresholds):
        aggs += [F.count_if(F.col("yes") & (F.col("score") >= t)).alias(f"tp{i}"), F.count_if(~F.col("yes") & (F.col("score") >= t)).alias(f"fp{i}")]
    one = scored.agg(*aggs)
    rows = [F.struct(F.lit(t).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp")) for i, t in enumerate(thresholds)]
    got = one.select("n_yes", F.inline(F.array(*rows)))
    recall, precision = F.try_divide("tp", "n_yes"), F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fp"))
    return got.select("threshold", F.bround(recall, 3).alias("recall"), F.bround(precision, 3).alias("precision"), F.col("fp").alias("false_positives"))


def compare_runs(old: DataFrame, new: DataFrame) -> DataFrame:
    """(video_id, rows, agreement): rows meet by position up to the shorter run; agreement is over rows that both determine."""
    w = Window.partitionBy("video_id").orderBy("frame_idx")
    a = old.select("video_id", F.row_number().over(w).alias("pos"), F.col("state").alias("a"))
    b = new.select("video_id", F.row_number().over(w).alias("pos"), F.col("state").alias("b"))
    both = (F.col("a") != UNDETERMINED) & (F.col("b") != UNDETERMINED)
    return a.join(b, ["video_id", "pos"]).groupBy("video_id").agg(F.count("*").alias("rows"), F.avg(F.when(both, (F.col("a") == F.col("b")).cast("double"))).alias("agreement"))


def progress(samples: DataFrame) -> DataFrame:
    """(kind, name, total, done) by split and by batch of ``samples`` (split, batch, status); a frame without a subject is done too."""
    rows = F.array(F.struct(F.lit("split").alias("kind"), F.col("split").alias("name")), F.struct(F.lit("batch").alias("kind"), F.col("batch").alias("name")))
    return samples.select("status", F.inline(rows)).groupBy("kind", "name").agg(F.count("*").alias("total"), F.count_if(F.col("status").isin("done", "no_fish")).alias("done"))


def median_background(pixels: DataFrame) -> DataFrame:
    """(y, x, value): median of each pixel over sampled frames, halves to even."""
    return pixels.groupBy("y", "x").agg(F.bround(F.median("value")).cast("int").alias("value"))


def waterline(background: DataFrame) -> DataFrame:
    """(y): the row below the strongest change of the row mean, a margin from top and bottom left out; the first of equals.

    A frame has some hundred rows, so the window over rows is small whatever the number of frames.
    """
    means = background.groupBy("y").agg(F.avg("value").alias("m"))
    w = Window.orderBy("y")
    steps = means.withColumn("g", F.abs(F.col("m") - F.lag("m").over(w))).withColumn("n", F.max("y").over(Window.partitionBy(F.lit(1))))
    inside = steps.where((F.col("y") - 1 >= EDGE_MARGIN) & (F.col("y") - 1 < F.col("n") - EDGE_MARGIN))
    return inside.agg(F.max_by("y", F.struct("g", -F.col("y"))).alias("y"))


def detections_in_window(detections: DataFrame, frames: DataFrame, start_s: float, end_s: float, least: float) -> DataFrame:
    """Detections of ``least`` score or more with the time of their frame (0 where the frame is not stored), inside a window."""
    t = frames.select("video_id", "frame_idx", F.col("t_sec"))
    got = detections.where(F.col("score") >= least).join(t, ["video_id", "frame_idx"], "left").withColumn("t_sec", F.coalesce("t_sec", F.lit(0.0)))
    return got.where((F.col("t_sec") >= start_s) & (F.col("t_sec") < end_s))


def detection_tracks(detections: DataFrame, least: float) -> DataFrame:
    """Track rows of detections (box x0..y1, head and tail points): centre, axis orientation, detected at ``least`` score."""
    seen = F.col("score") >= least
    axis = axis_orientation(F.col("head_x") - F.col("tail_x"), F.col("head_y") - F.col("tail_y"))
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    return detections.select(
        "video_id", "frame_idx", F.when(seen, x).otherwise(0.0).alias("x"), F.when(seen, y).otherwise(0.0).alias("y"), F.when(seen, axis).alias("orientation_deg"),
        F.when(seen, y).alias("y_from_frame_top"), seen.alias("detected"),
    )


def lookup_predictions(predictions: DataFrame, ids: DataFrame) -> DataFrame:
    """(video_id, problem) of ids without exactly one row, or with a probability outside [0, 1]; ``predictions``: video_id, probabilities map."""
    p = predictions.groupBy("video_id").agg(
        F.count("*").alias("n"), F.max(F.exists(F.map_values("probabilities"), lambda v: (v < 0) | (v > 1) | v.isNull()).cast("int")).alias("bad")
    )
    got = ids.select("video_id").distinct().join(p, "video_id", "left")
    problem = F.when(F.coalesce("n", F.lit(0)) != 1, "not one row").when(F.col("bad") == 1, "probability outside 0 to 1")
    return got.withColumn("problem", problem).where("problem is not null").select("video_id", "problem")


def score_cells(summary: DataFrame, base: str, rows: str = "model", score: str = "balanced_accuracy") -> DataFrame:
    """(row, scheme, cell, delta): ``mean ± sd`` of each row and scheme, and the difference from the row ``base``."""
    b = summary.where(F.col(rows) == base).select("scheme", F.col(f"{score}_mean").alias("base"))
    cell = F.format_string("%.3f ± %.3f", f"{score}_mean", f"{score}_sd")
    return summary.join(F.broadcast(b), "scheme", "left").select(rows, "scheme", cell.alias("cell"), (F.col(f"{score}_mean") - F.col("base")).alias("delta"))
