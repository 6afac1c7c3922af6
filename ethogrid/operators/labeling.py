"""Rule-based behaviour states, their consolidation into time bins, and run-length segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ethogrid.functions.scalars import time_bin
from ethogrid.operators.islands import Key, adjacent, by_time, names, sustained, terminal_run, with_island
from ethogrid.schemas import CONTROLLED, DEAD, ERRATIC, FREEZING, LISTING, STATES, SURFACE, TIE_PRIORITY, UNDETERMINED


def classify(
    with_speed: DataFrame, freeze_floor: float | Column, min_freeze_s: float | Column, erratic: float | Column, surface_depth: float | Column, min_dead_s: float | Column,
    listing_deviation: float | Column | None = None, min_listing_s: float | Column = 0.0, key: Key = "video_id",
) -> DataFrame:
    """Adds ``state`` from smoothed speed, depth and orientation. Earlier rules win:

    not detected: Undetermined; in the terminal still run: Dead; near the surface: Surface Breach; in a sustained tilted run:
    Listing/LORR; in a sustained still run: Freezing/Drift; no speed: Undetermined; fast: Erratic Movement; else Controlled Swim.
    Thresholds are numbers, or columns that are the same in all rows of ``key``.
    """
    if not isinstance(erratic, Column) and not isinstance(freeze_floor, Column) and erratic <= freeze_floor:
        raise ValueError(f"the erratic threshold ({erratic}) must be above the freeze floor ({freeze_floor})")
    out = with_speed.withColumn("__still", F.col("speed_valid") & (F.col("speed") <= freeze_floor))
    out = terminal_run(sustained(out, "__still", min_freeze_s, "__freezing", key), "__still", min_dead_s, "__dead", key)
    if listing_deviation is None:
        out = out.withColumn("__listing", F.lit(False))
    else:
        tilted = F.col("detected") & F.coalesce(F.abs(F.col("orientation_deg") - 90) >= listing_deviation, F.lit(False))
        out = sustained(out.withColumn("__tilted", tilted), "__tilted", min_listing_s, "__listing", key).drop("__tilted")
    state = (
        F.when(~F.col("detected"), UNDETERMINED).when(F.col("__dead"), DEAD).when(F.col("y_from_frame_top") <= surface_depth, SURFACE)
        .when(F.col("__listing"), LISTING).when(F.col("__freezing"), FREEZING).when(~F.col("speed_valid"), UNDETERMINED)
        .when(F.col("speed") >= erratic, ERRATIC).otherwise(CONTROLLED)
    )
    return out.withColumn("state", state).drop("__still", "__freezing", "__dead", "__listing")


def bin_votes(states: DataFrame, width: float) -> DataFrame:
    """Rows, and rows of each state, by (video_id, bin)."""
    counts = [F.count_if(F.col("state") == s).alias(f"n_{i}") for i, s in enumerate(STATES)]
    return states.groupBy("video_id", time_bin(F.col("t_sec"), width).alias("bin")).agg(F.count("*").alias("n"), *counts)


def bin_winner(min_determined: float):
    """State of a bin from its votes: majority with ties by priority, Undetermined abstaining; Surface Breach wins wherever it is
    unless Dead has half of the determined rows; last, too few determined rows make the bin Undetermined."""
    n = {s: F.col(f"n_{i}") for i, s in enumerate(STATES)}
    determined = F.col("n") - n[UNDETERMINED]
    voters = [s for s in STATES if s not in (UNDETERMINED, SURFACE)]
    scores = [F.struct((n[s] * 10 + TIE_PRIORITY[s]).alias("score"), F.lit(s).alias("state")) for s in voters]
    votes = sum((n[s] for s in voters[1:]), n[voters[0]])
    winner = F.when(votes > 0, F.greatest(*scores)["state"]).otherwise(UNDETERMINED)
    winner = F.when((n[SURFACE] > 0) & (n[DEAD] * 2 < determined), SURFACE).otherwise(winner)
    return F.when((determined == 0) | (determined / F.col("n") < min_determined), UNDETERMINED).otherwise(winner)


def consolidate_bins(states: DataFrame, width: float, min_determined: float) -> DataFrame:
    """(video_id, bin, n, state): one state for each bin that has rows."""
    return bin_votes(states, width).select("video_id", "bin", "n", bin_winner(min_determined).alias("state"))


def consolidate(states: DataFrame, width: float, min_determined: float, key: Key = "video_id") -> DataFrame:
    """The rows of ``states`` with the state of their bin. Windows by (video_id, bin) keep the rows where they are."""
    w = Window.partitionBy(*names(key), "bin")
    out = states.withColumn("bin", time_bin(F.col("t_sec"), width)).withColumn("n", F.count("*").over(w))
    for i, s in enumerate(STATES):
        out = out.withColumn(f"n_{i}", F.sum((F.col("state") == s).cast("long")).over(w))
    return out.withColumn("state", bin_winner(min_determined)).drop("n", *[f"n_{i}" for i in range(len(STATES))])


def segments(states: DataFrame, break_on_gaps: bool = True) -> DataFrame:
    """(video_id, start_s, end_s, duration_s, state, source): run-length encoding of states.

    A segment ends where state or source change or, with ``break_on_gaps``, where an index is missing. It ends when the next starts;
    the last one ends a median row spacing after its last row. Times are those of the stored single-precision column.
    """
    w = by_time()
    out = states.withColumn("t", F.col("t_sec").cast("float").cast("double"))
    change = (F.col("state") != F.lag("state").over(w)) | (F.col("source") != F.lag("source").over(w))
    breaks = F.lag("state").over(w).isNull() | change
    if break_on_gaps:
        breaks = breaks | ~adjacent()
    out = with_island(out.withColumn("__gap", F.col("t") - F.lag("t").over(w)), breaks)
    out = out.withColumn("spacing", F.coalesce(F.median("__gap").over(Window.partitionBy("video_id")), F.lit(0.0)))
    runs = out.groupBy("video_id", "island").agg(
        F.min("t").alias("start_s"), F.min_by("state", "frame_idx").alias("state"), F.min_by("source", "frame_idx").alias("source"), F.max("t").alias("last_t"), F.first("spacing").alias("spacing")
    )
    runs = runs.withColumn("next", F.lead("start_s").over(Window.partitionBy("video_id").orderBy("island")))
    runs = runs.withColumn("end_s", F.coalesce("next", F.col("last_t") + F.col("spacing")))
    return runs.select("video_id", F.col("island").alias("segment"), "start_s", "end_s", (F.col("end_s") - F.col("start_s")).alias("duration_s"), "state", "source")


def dead_violations(states: DataFrame) -> DataFrame:
    """Rows that are not Dead after a Dead one; there must be none."""
    before = by_time().rowsBetween(Window.unboundedPreceding, -1)
    dead = F.max((F.col("state") == DEAD).cast("int")).over(before)
    return states.withColumn("__before", F.coalesce(dead, F.lit(0))).where((F.col("__before") == 1) & (F.col("state") != DEAD)).drop("__before")


def bouts(segs: DataFrame) -> DataFrame:
    """(video_id, bout, state, start_s, duration_s): segments of one state in a row, whatever their source."""
    w = Window.partitionBy("video_id").orderBy("start_s", "segment")
    changed = F.coalesce(F.col("state") != F.lag("state").over(w), F.lit(True))
    out = segs.withColumn("bout", F.sum(changed.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.groupBy("video_id", "bout").agg(F.first("state").alias("state"), F.min("start_s").alias("start_s"), F.sum("duration_s").alias("duration_s"))


def transitions(bout_rows: DataFrame) -> DataFrame:
    """(video_id, state, next_state, n): bouts that follow each other, pairs with Undetermined left out."""
    w = Window.partitionBy("video_id").orderBy("bout")
    pairs = bout_rows.withColumn("next_state", F.lead("state").over(w))
    known = pairs.where(F.col("next_state").isNotNull() & (F.col("state") != UNDETERMINED) & (F.col("next_state") != UNDETERMINED))
    return known.groupBy("video_id", "state", "next_state").agg(F.count("*").alias("n"))


def segments_to_frames(segs: DataFrame, frames: DataFrame) -> DataFrame:
    """State and source of each row of ``frames`` (video_id, frame_idx, t_sec) from the segment it falls in.

    Rows before the first segment take the first, rows after the last the last, and a row at a boundary the later one. One
    union and one running window, no range join: a segment counts from the end of the one before it.
    """
    w = Window.partitionBy("video_id").orderBy("start_s", "segment")
    marks = segs.select(
        "video_id", F.coalesce(F.lag("end_s").over(w), F.lit(float("-inf"))).alias("t"), F.lit(0).alias("kind"), F.col("segment").alias("nth"),
        F.struct("state", "source").alias("label"), F.lit(None).cast("int").alias("frame_idx"), F.lit(None).cast("double").alias("t_sec"),
    )
    rows = frames.select(
        "video_id", F.col("t_sec").alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("nth"),
        F.lit(None).cast("struct<state:string,source:string>").alias("label"), "frame_idx", "t_sec",
    )
    running = Window.partitionBy("video_id").orderBy("t", "kind", "nth", "frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    out = marks.unionByName(rows).withColumn("now", F.last("label", ignorenulls=True).over(running)).where("kind = 1")
    return out.select("video_id", "frame_idx", "t_sec", F.col("now.state").alias("state"), F.col("now.source").alias("source"))
