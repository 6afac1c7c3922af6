"""Workbook rows and videos: duplicates, matching, exceptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ethogrid.functions.scalars import compound_key


def dedupe_rows(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """Rows with ``copy`` (1 for the first of exact duplicates over ``columns``) and ``copies``."""
    w = Window.partitionBy(*columns)
    return rows.withColumn("copy", F.row_number().over(w.orderBy(order))).withColumn("copies", F.count("*").over(w))


def duplicate_groups(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """One row for each group of exact duplicates with the positions of its rows."""
    got = rows.groupBy(*columns).agg(F.array_sort(F.collect_list(order)).alias("rows"))
    return got.where(F.size("rows") > 1)


def parse_videos(paths: DataFrame) -> DataFrame:
    """(path, letter, subject, folder_key) of video files named like ``M_0007.mp4`` in a folder named after the compound."""
    name = F.regexp_extract("path", r"(?i)/([A-Z])_0*(\d+)\.mp4$", 2)
    folder = F.regexp_replace(F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1), r"\s*\([^)]*\)\s*$", "")
    got = paths.select("path", F.upper(F.regexp_extract("path", r"(?i)/([A-Z])_0*(\d+)\.mp4$", 1)).alias("letter"), name.alias("n"), compound_key(folder).alias("folder_key"))
    return got.where("n <> ''").select("path", "letter", F.col("n").cast("int").alias("subject"), "folder_key")


def match_first(trials: DataFrame, videos: DataFrame, key: list[str], trial_order: str, video_order: str) -> DataFrame:
    """Every trial and video with ``status``: the first trial of a key takes its first video.

    matched; duplicate_video (a later video of a key); ambiguous (a later trial of a key that has a video); unmatched_trial; unmatched_video.
    """
    t = trials.withColumn("t_nth", F.row_number().over(Window.partitionBy(*key).orderBy(trial_order)))
    v = videos.withColumn("v_nth", F.row_number().over(Window.partitionBy(*key).orderBy(video_order)))
    first = v.where("v_nth = 1").select(*key, F.col(video_order).alias("video"))
    got = t.join(first, key, "left")
    status = F.when(F.col("video").isNull(), "unmatched_trial").when(F.col("t_nth") == 1, "matched").otherwise("ambiguous")
    left = got.select(*key, F.col(trial_order).alias("trial"), F.when(F.col("t_nth") == 1, F.col("video")).alias("video"), status.alias("status"))
    keys = trials.select(*key).distinct().withColumn("known", F.lit(True))
    rest = v.join(keys, key, "left")
    late = F.when(F.col("v_nth") > 1, "duplicate_video").when(F.col("known").isNull(), "unmatched_video")
    right = rest.where(late.isNotNull()).select(*key, F.lit(None).cast(dict(trials.dtypes)[trial_order]).alias("trial"), F.col(video_order).alias("video"), late.alias("status"))
    return left.unionByName(right)


def unmatched(trials: DataFrame, videos: DataFrame, key: list[str]) -> DataFrame:
    """Keys on one side only, as ``side``."""
    a, b = trials.select(*key).distinct(), videos.select(*key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("trial")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("video")))


def duration_mismatches(matched: DataFrame, tolerance_s: float = 30.0) -> DataFrame:
    """``matched``: video_id, minutes, duration_s (null: unreadable). A missing expectation is itself a mismatch."""
    expected = F.when(~F.isnan("minutes"), F.col("minutes") * 60)
    kind = (
        F.when(F.col("duration_s").isNull(), "corrupt").when(expected.isNull(), "mismatch")
        .when(F.abs(F.col("duration_s") - expected) > tolerance_s, "mismatch")
    )
    return matched.withColumn("kind", kind).where("kind is not null").select("video_id", "kind", expected.alias("expected_s"), "duration_s")


def exceptions(*lists: tuple[str, DataFrame]) -> DataFrame:
    """One long table of the lists of exceptions, each row as JSON with its kind."""
    out = None
    for kind, df in lists:
        rows = df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*df.columns)).alias("row"))
        out = rows if out is None else out.unionByName(rows)
    return out


def inventory(catalog: DataFrame, processed: DataFrame, raw: DataFrame) -> DataFrame:
    """Full outer union of three sources by path, with where each is known."""
    out = catalog.select("path", F.lit(True).alias("in_catalog"))
    for df, name in ((processed, "in_processed"), (raw, "in_raw")):
        out = out.join(df.select("path", F.lit(True).alias(name)), "path", "fullouter")
    return out.select("path", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("in_catalog", "in_processed", "in_raw")])


def workbook_conflicts(gold: DataFrame, workbook: DataFrame) -> DataFrame:
    """Subjects whose label or date differ between both sources."""
    w = workbook.select(F.col("video_id").alias("w_id"), F.col("compound").alias("w_compound"), F.col("date").alias("w_date"))
    got = gold.join(w, F.col("video_id") == F.col("w_id"))
    bad = (compound_key(F.col("compound")) != compound_key(F.col("w_compound"))) | ~F.col("date").eqNullSafe(F.col("w_date"))
    return got.where(bad).select("video_id", "compound", "w_compound", "date", "w_date")
