"""Frame annotations: validation, list filters, the overlay's window, trails and rounding for transport."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LONGEST_NAME = 100
#: What a keypoint's third number may be (0 means not labelled).
VISIBILITY = (0.0, 1.0, 2.0)
MAX_OVERLAY_S = 30.0
#: Statuses that a filter on one status also takes.
ALSO = {"done": ("done", "no_fish")}
#: Decimal places of what is sent to a viewer.
PLACES = {"x": 1, "y": 1, "t_sec": 4, "score": 3}


def _finite(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def annotation_errors(rows: DataFrame, width: int, height: int, tags: tuple, names: tuple, least_side: float) -> DataFrame:
    """``rows`` with ``error``: the first rule an annotation breaks, null if none.

    ``rows``: annotator, fish_visible, box (array of x0, y0, x1, y1), keypoints (map of name to x, y, visibility), listing. An empty frame has
    no marks; a visible fish has a box inside the image with sides of ``least_side`` at least and a listing tag. Places of keypoints with
    visibility 0 are not looked at. Rules on keypoints are tried one after the other over all keypoints.
    """
    who = F.trim(F.coalesce("annotator", F.lit("")))
    bad_name = (who == "") | (F.length(who) > LONGEST_NAME) | who.rlike(r"[\x00-\x1f\x7f]")
    points = F.coalesce(F.map_entries("keypoints"), F.array().cast("array<struct<key:string,value:array<double>>>"))
    marked = F.coalesce(F.size("box") > 0, F.lit(False)) | (F.size(points) > 0) | (F.coalesce("listing", F.lit("")) != "")
    x0, y0, x1, y1 = (F.get("box", F.lit(i)).cast("double") for i in range(4))
    shaped = F.coalesce(F.size("box") == 4, F.lit(False)) & _finite(x0) & _finite(y0) & _finite(x1) & _finite(y1)

    def at(e: Column, i: int) -> Column:
        return F.get(e["value"], F.lit(i))

    def far(e: Column) -> Column:
        return (at(e, 2) != 0) & ~(at(e, 0).between(0, width) & at(e, 1).between(0, height))

    def malformed(e: Column) -> Column:
        return ~(F.coalesce(F.size(e["value"]) == 3, F.lit(False)) & _finite(at(e, 0)) & _finite(at(e, 1)))

    error = (
        F.when(bad_name, "annotator").when(F.col("fish_visible").isNull(), "fish_visible")
        .when(~F.col("fish_visible"), F.when(marked, "marks on an empty frame"))
        .when(~shaped, "box").when((x0 < 0) | (y0 < 0) | (x1 > width) | (y1 > height), "box outside")
        .when((x1 - x0 < least_side) | (y1 - y0 < least_side), "box too small")
        .when(~F.coalesce(F.col("listing").isin(*tags), F.lit(False)), "listing")
        .when(F.exists(points, lambda e: ~e["key"].isin(*names)), "unknown keypoint")
        .when(F.exists(points, malformed), "keypoint")
        .when(F.exists(points, lambda e: ~F.coalesce(at(e, 2).isin(*VISIBILITY), F.lit(False))), "keypoint visibility")
        .when(F.exists(points, far), "keypoint outside")
    )
    return rows.withColumn("error", error)


def listing(rows: DataFrame, **wanted: str | None) -> DataFrame:
    """Rows that match every filter given (None: no filter); status ``done`` takes frames without a fish too."""
    for name, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(name).isin(*(ALSO.get(value, (value,)) if name == "status" else (value,))))
    return rows


def overlay(rows: DataFrame, start_s: float, end_s: float) -> DataFrame:
    """Rows from ``start_s`` up to ``end_s``; the window must be of more than 0 and at most 30 seconds."""
    if not 0 < end_s - start_s <= MAX_OVERLAY_S:
        raise ValueError(f"an overlay shows more than 0 and at most {MAX_OVERLAY_S:g} seconds, not {end_s - start_s:g}")
    return rows.where((F.col("t_sec") >= start_s) & (F.col("t_sec") < end_s))


def trail_runs(tracks: DataFrame, asked: DataFrame, fps: float, seconds: float = 2.0) -> DataFrame:
    """Unbroken pieces of the last ``seconds`` before each asked frame: (video_id, now_idx, run, first_idx, last_idx, n, points).

    ``asked``: video_id, now_idx. A piece ends where a frame is missing or nothing is detected.
    """
    near = tracks.join(asked, "video_id").where(F.col("frame_idx").between(F.col("now_idx") - int(fps * seconds), F.col("now_idx")))
    seen = near.where(F.col("detected") & F.col("x").isNotNull() & F.col("y").isNotNull())
    w = Window.partitionBy("video_id", "now_idx").orderBy("frame_idx")
    starts = F.coalesce((F.col("frame_idx") - F.lag("frame_idx").over(w) > 1).cast("long"), F.lit(1))
    runs = seen.withColumn("run", F.sum(starts).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    points = F.array_sort(F.collect_list(F.struct("frame_idx", "x", "y")))  # at most fps * seconds + 1
    return runs.groupBy("video_id", "now_idx", "run").agg(
        F.min("frame_idx").alias("first_idx"), F.max("frame_idx").alias("last_idx"), F.count("*").alias("n"), points.alias("points")
    )


def rounded(rows: DataFrame) -> DataFrame:
    """``rows`` with positions, times and scores rounded, half to even, as a viewer gets them."""
    return rows.withColumns({c: F.bround(c, n) for c, n in PLACES.items() if c in rows.columns})
