"""One row of features for each subject."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ethogrid.operators.islands import by_time
from ethogrid.operators.labeling import bouts
from ethogrid.schemas import BEHAVIOUR_STATES, UNDETERMINED

DEPTH_PERCENTILES = (5, 25, 50, 75, 95)  # fixed values


def _slug(state: str) -> str:
    return "".join(c if c.isalnum() else "_" for c in state.lower())


def segment_features(segs: DataFrame) -> DataFrame:
    """Share of known time, bouts, mean bout and latency of each state, the 30 transition counts and the recording length.

    A state never shown has no bouts, mean 0 and the recording length as latency. Subjects without known time drop out.
    """
    rows = bouts(segs)
    rows = rows.withColumn("next_state", F.lead("state").over(Window.partitionBy("video_id").orderBy("bout")))
    aggs = [F.sum(F.when(F.col("state") != UNDETERMINED, F.col("duration_s"))).alias("known_s"), F.min("start_s").alias("first_s"), F.sum("duration_s").alias("recording_s")]
    for s in BEHAVIOUR_STATES:
        own = F.col("state") == s
        aggs += [
            F.sum(F.when(own, F.col("duration_s")).otherwise(0.0)).alias(f"{_slug(s)}_s"), F.count_if(own).alias(f"{_slug(s)}_n"),
            F.min(F.when(own, F.col("start_s"))).alias(f"{_slug(s)}_first"),
        ]
    pairs = list(permutations(BEHAVIOUR_STATES, 2))
    aggs += [F.count_if((F.col("state") == a) & (F.col("next_state") == b)).cast("double").alias(f"trans_{_slug(a)}_to_{_slug(b)}") for a, b in pairs]
    got = rows.groupBy("video_id").agg(*aggs).where("known_s > 0")
    out = [F.col("video_id")]
    for s in BEHAVIOUR_STATES:
        k = _slug(s)
        n = F.col(f"{k}_n")
        out += [
            (F.col(f"{k}_s") / F.col("known_s")).alias(f"state_{k}_share"), n.cast("double").alias(f"state_{k}_bouts"),
            F.when(n > 0, F.col(f"{k}_s") / F.nullif(n, F.lit(0))).otherwise(0.0).alias(f"state_{k}_mean_bout_s"),
            F.coalesce(F.col(f"{k}_first") - F.col("first_s"), F.col("recording_s")).alias(f"state_{k}_latency_s"),
        ]
    return got.select(*out, *[f"trans_{_slug(a)}_to_{_slug(b)}" for a, b in pairs], "recording_s")


def kinematic_features(frames: DataFrame) -> DataFrame:
    """Speed, turning, meander, immobility and depth over detected rows; rows whose run is too short for a measure are masked.

    Subjects without a detected row drop out; a measure without any row is null.
    """
    w = by_time()
    before = F.coalesce(F.lag("detected").over(w), F.lit(False))
    out = frames.withColumn("__first", F.col("detected") & ~before)
    out = out.withColumn("__one", F.col("detected") & ~F.col("__first"))
    out = out.withColumn("__two", F.col("__one") & ~F.coalesce(F.lag("__first").over(w), F.lit(False)))
    v = F.when(F.col("__one"), F.col("velocity"))
    depth = F.when(F.col("detected"), F.col("y_from_frame_top"))
    mean = F.avg(v)
    return out.groupBy("video_id").agg(
        mean.alias("velocity_mean"), F.median(v).alias("velocity_median"),
        F.when(mean > 0, F.stddev_pop(v) / F.nullif(mean, F.lit(0.0))).when(F.count(v) > 0, 0.0).alias("velocity_cv"),
        F.avg(F.when(F.col("__two"), F.abs("acceleration"))).alias("abs_acceleration_mean"),
        F.avg(F.when(F.col("__one"), F.abs("angular_velocity"))).alias("abs_angular_velocity_mean"),
        F.avg(F.when(F.col("__two"), F.col("meander"))).alias("meander_mean"),
        F.avg(F.when(F.col("detected"), F.col("is_immobile").cast("double"))).alias("immobile_share"),
        F.avg(F.col("detected").cast("double")).alias("detected_share"), F.avg(depth).alias("depth_mean"), F.min(depth).alias("depth_min"),
        *[F.percentile(depth, F.lit(p / 100)).alias(f"depth_p{p:02d}") for p in DEPTH_PERCENTILES], F.count_if("detected").alias("__seen"),
    ).where("__seen > 0").drop("__seen")


def undetermined_share(segs: DataFrame) -> DataFrame:
    """Share of a subject's time that is Undetermined."""
    time = F.sum("duration_s")
    unknown = F.sum(F.when(F.col("state") == UNDETERMINED, F.col("duration_s")).otherwise(0.0))
    return segs.groupBy("video_id").agg(F.when(time > 0, unknown / F.nullif(time, F.lit(0.0))).otherwise(0.0).alias("undetermined_share"))


def state_seconds(segs: DataFrame) -> DataFrame:
    """Seconds and segments of each state, and whether a subject has any Undetermined or Dead time."""
    return segs.groupBy("video_id", "state").agg(F.sum("duration_s").alias("seconds"), F.count("*").alias("segments"))


def timeline(frames: DataFrame, width: float) -> DataFrame:
    """(video_id, bin, start_s, end_s, known_s, speed, shares): every bin up to the recording's end, empty ones too.

    Shares are over the bin's rows of known state; known_s is their number times the median row spacing; speed is over rows whose
    predecessor was detected too.
    """
    w = by_time()
    real = F.col("detected") & F.coalesce(F.lag("detected").over(w), F.lit(False))
    rows = frames.withColumn("gap", F.col("t_sec") - F.lag("t_sec").over(w)).withColumn("speed", F.when(real, F.col("velocity")))
    every = Window.partitionBy("video_id")
    rows = rows.withColumn("spacing", F.coalesce(F.median("gap").over(every), F.lit(0.0))).withColumn("duration_s", F.max("t_sec").over(every) + F.col("spacing"))
    known = F.col("state") != UNDETERMINED
    n = F.count_if(known)
    shares = [(F.count_if(F.col("state") == s) / F.nullif(n, F.lit(0))).alias(f"share_{_slug(s)}") for s in BEHAVIOUR_STATES]
    got = rows.groupBy("video_id", F.floor(F.col("t_sec") / width).cast("int").alias("own")).agg(
        n.alias("known"), F.avg("speed").alias("speed"), *shares, F.first("spacing").alias("spacing"), F.first("duration_s").alias("duration_s")
    )
    # each bin with rows also gives the empty ones up to the next such bin, the first one those before it
    order = Window.partitionBy("video_id").orderBy("own")
    ends = F.ceil(F.col("duration_s") / width).cast("int") - 1
    until = F.coalesce(F.lead("own").over(order) - 1, F.greatest(ends, F.col("own")))
    since = F.when(F.lag("own").over(order).isNull(), F.least(F.lit(0), F.col("own"))).otherwise(F.col("own"))
    out = got.withColumn("until", until).withColumn("since", since).withColumn("bin", F.explode(F.sequence("since", "until"))).where((F.col("bin") >= 0) & (F.col("bin") <= ends))
    real = F.col("bin") == F.col("own")
    return out.select(
        "video_id", "bin", (F.col("bin") * float(width)).alias("start_s"), F.least((F.col("bin") + 1) * float(width), F.col("duration_s")).alias("end_s"),
        (F.when(real, F.col("known")).otherwise(0) * F.col("spacing")).alias("known_s"), F.when(real, F.col("speed")).alias("speed"),
        *[F.when(real, F.col(f"share_{_slug(s)}")).alias(f"share_{_slug(s)}") for s in BEHAVIOUR_STATES],
    )


def explain_bins(states: DataFrame, width: float) -> DataFrame:
    """Evidence for the state of each bin: rows, detected rows, median valid speed, least depth, votes, winner."""
    from ethogrid.functions.scalars import time_bin
    from ethogrid.operators.labeling import bin_winner
    from ethogrid.schemas import STATES

    valid = F.col("speed_valid") & F.col("detected")
    counts = [F.count_if(F.col("state") == s).alias(f"n_{i}") for i, s in enumerate(STATES)]
    got = states.groupBy("video_id", time_bin(F.col("t_sec"), width).alias("bin")).agg(
        F.count("*").alias("n"), F.count_if("detected").alias("n_detected"), F.median(F.when(valid, F.col("speed"))).alias("speed_median"),
        F.min("y_from_frame_top").alias("y_min"), *counts,
    )
    return got.withColumn("winner", bin_winner(0.5))
