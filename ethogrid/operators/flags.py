"""Flags and samples over time: sessions of hits, terminal rest, undetected gaps, down-sampling, strided samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ethogrid.functions.scalars import mmss
from ethogrid.operators.islands import by_time


def session_flags(samples: DataFrame, threshold: float, step: float, least: int = 1, key: str = "video_id") -> DataFrame:
    """Ranges of hits (t, score) at or above ``threshold`` that are at most 1.5 steps apart, padded by half a step.

    A plain session window splits at a gap equal to its timeout; here only a larger gap splits, so runs are numbered instead.
    """
    w = Window.partitionBy(key).orderBy("t", "score")
    hits = samples.where(F.col("score") >= threshold)
    split = F.coalesce(F.col("t") - F.lag("t").over(w) > 1.5 * step, F.lit(True))
    runs = hits.withColumn("session", F.sum(split.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy(key, "session").agg(
        F.greatest(F.min("t") - step / 2, F.lit(0.0)).alias("start_s"), (F.max("t") + step / 2).alias("end_s"), F.max("score").alias("max_score"), F.count("*").alias("n_samples")
    )
    return out.where(F.col("n_samples") >= least)


def terminal_no_action(with_speed: DataFrame, freeze_floor: float, least_s: float) -> DataFrame:
    """Subjects that show no movement from some time to the end, for ``least_s`` or more; without any movement from 0."""
    moving = F.col("speed_valid") & (F.col("speed") > freeze_floor)
    got = with_speed.groupBy("video_id").agg(
        F.coalesce(F.max_by("t_sec", F.when(moving, F.col("frame_idx"))), F.lit(0.0)).alias("start_s"), F.max_by("t_sec", "frame_idx").alias("end_s")
    )
    return got.where(F.col("end_s") - F.col("start_s") >= least_s).withColumn("from_mmss", mmss(F.col("start_s")))


def undetected_gaps(tracks: DataFrame) -> DataFrame:
    """(video_id, start_pos, length, mid_pos) of stretches of undetected rows, by row position."""
    w = by_time()
    rows = tracks.withColumn("pos", F.row_number().over(w) - 1).where(~F.col("detected"))
    run = F.col("pos") - F.row_number().over(Window.partitionBy("video_id").orderBy("pos"))
    got = rows.withColumn("run", run).groupBy("video_id", "run").agg(F.min("pos").alias("start_pos"), F.count("*").alias("length"))
    return got.select("video_id", "start_pos", "length", (F.col("start_pos") + F.floor(F.col("length") / 2)).alias("mid_pos"))


def first_of_each(tracks: DataFrame, width: float) -> DataFrame:
    """The first row of each stretch of rows with one ``floor(t / width)``."""
    w = by_time()
    marked = tracks.withColumn("__b", F.floor(F.col("t_sec") / width))
    return marked.withColumn("__new", F.coalesce(F.col("__b") != F.lag("__b").over(w), F.lit(True))).where("__new").drop("__b", "__new")


def strided_expand(samples: DataFrame, stride: int) -> DataFrame:
    """Rows for all indices between samples taken every ``stride``: linear between two detected samples, else the earlier one.

    ``samples``: video_id, frame_idx (a multiple of stride), x, y, detected. Each index is looked up by the two keys of its samples, so no range join is needed.
    """
    size = samples.groupBy("video_id").agg(F.max("frame_idx").alias("last_idx"))
    every = size.select("video_id", F.explode(F.sequence(F.lit(0), F.col("last_idx"))).alias("frame_idx"))
    base = (F.floor(F.col("frame_idx") / stride) * stride).cast("int")
    s = samples.select("video_id", F.col("frame_idx").alias("k"), F.struct("x", "y", "detected").alias("v"))
    out = every.withColumn("k0", base).withColumn("k1", base + stride)
    out = out.join(s.select("video_id", F.col("k").alias("k0"), F.col("v").alias("a")), ["video_id", "k0"], "left")
    out = out.join(s.select("video_id", F.col("k").alias("k1"), F.col("v").alias("b")), ["video_id", "k1"], "left")
    share = (F.col("frame_idx") - F.col("k0")) / float(stride)
    both = F.col("a.detected") & F.coalesce(F.col("b.detected"), F.lit(False))
    seen = F.coalesce(F.col("a.detected"), F.lit(False))

    def at(c: str):
        a, b = F.col(f"a.{c}"), F.col(f"b.{c}")
        return F.when(both, a + share * (b - a)).when(seen, a).otherwise(0.0).alias(c)

    return out.select("video_id", "frame_idx", at("x"), at("y"), seen.alias("detected"))
