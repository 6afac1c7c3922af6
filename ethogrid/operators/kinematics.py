"""Kinematic features of a track: speed, acceleration, turning, meander, immobility, smoothed speed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ethogrid.functions.scalars import circular_diff, heading, hypot
from ethogrid.operators.islands import adjacent, by_time, run_length


def velocity(tracks: DataFrame) -> DataFrame:
    """Adds run, run_length, dt, velocity and velocity_valid: two detected rows in a run and time that moves on."""
    w = by_time()
    out = run_length(tracks)
    out = out.withColumn("dt", F.col("t_sec") - F.lag("t_sec").over(w))
    valid = (F.col("run_length") >= 2) & (F.col("dt") > 0)
    step = hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    out = out.withColumn("step", step).withColumn("velocity_valid", F.coalesce(valid, F.lit(False)))
    return out.withColumn("velocity", F.when(F.col("velocity_valid"), F.col("step") / F.col("dt")).otherwise(0.0))


def acceleration(with_velocity: DataFrame) -> DataFrame:
    """Change of two valid velocities in a row; 0 and invalid otherwise."""
    w = by_time()
    valid = F.col("velocity_valid") & F.coalesce(F.lag("velocity_valid").over(w), F.lit(False))
    out = with_velocity.withColumn("acceleration_valid", valid)
    change = (F.col("velocity") - F.lag("velocity").over(w)) / F.col("dt")
    return out.withColumn("acceleration", F.when(F.col("acceleration_valid"), change).otherwise(0.0))


def angular_velocity(with_velocity: DataFrame) -> DataFrame:
    """Turn of the body axis (period 180, signed) between adjacent detected rows that have one."""
    w = by_time()
    valid = (
        F.col("detected") & F.coalesce(F.lag("detected").over(w), F.lit(False)) & adjacent()
        & F.col("orientation_deg").isNotNull() & F.lag("orientation_deg").over(w).isNotNull() & (F.col("dt") > 0)
    )
    out = with_velocity.withColumn("angular_valid", F.coalesce(valid, F.lit(False)))
    turn = circular_diff(F.col("orientation_deg"), F.lag("orientation_deg").over(w), 180.0) / F.col("dt")
    return out.withColumn("angular_velocity", F.when(F.col("angular_valid"), turn).otherwise(0.0))


def meander(with_velocity: DataFrame, window: int) -> DataFrame:
    """Turning per distance over the last ``window`` rows of the current run; 0 where there is no distance.

    The run is the window's partition, so the frame never reaches past a gap.
    """
    w = by_time()
    inside = Window.partitionBy("video_id", "run").orderBy("frame_idx")
    dx, dy = F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)
    out = with_velocity.withColumn("__heading", F.when(F.col("run_length") >= 2, heading(dx, dy)))
    turn = F.abs(circular_diff(F.col("__heading"), F.lag("__heading").over(inside), 360.0))
    out = out.withColumn("__turn", F.when(F.col("run_length") >= 3, turn)).withColumn("__dist", F.when(F.col("run_length") >= 2, F.col("step")))
    frame = inside.rowsBetween(-(window - 1), 0)
    dist = F.coalesce(F.sum("__dist").over(frame), F.lit(0.0))
    total = F.coalesce(F.sum("__turn").over(frame), F.lit(0.0))
    out = out.withColumn("meander", F.when(dist > 1e-9, total / F.nullif(dist, F.lit(0.0))).otherwise(0.0))
    return out.drop("__heading", "__turn", "__dist")


def immobility(with_velocity: DataFrame, floor: float, window: int) -> DataFrame:
    """The last ``window`` rows all have a valid velocity of at most ``floor``; false before there are so many."""
    frame = by_time().rowsBetween(-(window - 1), 0)
    slow = (F.col("velocity_valid") & (F.col("velocity") <= floor)).cast("int")
    return with_velocity.withColumn("is_immobile", (F.sum(slow).over(frame) == window))


_UNIT = 1 << 20  # one lag in units of the order key


def smoothed_speed(tracks: DataFrame, lag_s: float) -> DataFrame:
    """Adds pos, lag_rows, speed and speed_valid: displacement to the detected row ``lag_rows`` earlier, or else later.

    lag_rows is ``lag_s`` over the upper median of the spacings of adjacent rows, rounded half to even, 1 at least. It differs between subjects, and a window's frame
    can't; so rows are ordered by index x 2^20 / lag_rows, rounded down, in which a partner lies exactly 2^20 away. All windows share one exchange by video_id.
    """
    w = by_time()
    base = tracks.withColumn("pos", F.row_number().over(w))
    gap = F.col("t_sec") - F.lag("t_sec").over(w)
    spaced = base.withColumn("__gap", F.when(adjacent() & (gap > 0), gap))
    every = Window.partitionBy("video_id")
    ranked = spaced.withColumn("__n", F.count("__gap").over(every)).withColumn(
        "__r", F.row_number().over(Window.partitionBy("video_id").orderBy(F.col("__gap").asc_nulls_last()))
    )
    middle = F.max(F.when(F.col("__r") == F.floor(F.col("__n") / 2) + 1, F.col("__gap"))).over(every)
    ranked = ranked.withColumn("lag_rows", F.greatest(F.lit(1), F.bround(F.lit(float(lag_s)) / middle).cast("int")))
    lagged = ranked.withColumn("lag_rows", F.when(middle.isNotNull(), F.col("lag_rows"))).drop("__gap", "__n", "__r")
    own = F.struct("pos", "frame_idx", "t_sec", "x", "y")
    lagged = lagged.withColumn("__key", F.expr(f"(CAST(frame_idx AS BIGINT) * {_UNIT}) div CAST(lag_rows AS BIGINT)"))
    place = Window.partitionBy("video_id").orderBy("__key")
    at = lambda d: F.collect_list(F.when(F.col("detected"), own)).over(place.rangeBetween(d, d))  # noqa: E731  one row, unless indices repeat
    lagged = lagged.withColumn("__before", at(-_UNIT)).withColumn("__after", at(_UNIT))

    def speed(name: str, sign: int):
        def partner(o):
            return (o["pos"] == F.col("pos") + sign * F.col("lag_rows")) & ((o["frame_idx"] - F.col("frame_idx")) * sign == F.col("lag_rows")) & ((o["t_sec"] - F.col("t_sec")) * sign > 0)

        o = F.get(F.filter(name, partner), F.lit(0))
        d = hypot(o["x"] - F.col("x"), o["y"] - F.col("y"))
        return F.when(F.col("detected") & F.col("lag_rows").isNotNull(), d / F.nullif(F.abs(o["t_sec"] - F.col("t_sec")), F.lit(0.0)))

    found = F.coalesce(speed("__before", -1), speed("__after", 1))
    keep = [*tracks.columns, "pos", "lag_rows"]
    return lagged.withColumn("__speed", found).select(*keep, F.coalesce("__speed", F.lit(0.0)).alias("speed"), F.col("__speed").isNotNull().alias("speed_valid"))


def features(tracks: DataFrame, meander_window: int, immobile_floor: float, immobile_window: int) -> DataFrame:
    """All per-row features; one exchange by video_id serves every window."""
    out = angular_velocity(acceleration(velocity(tracks)))
    return immobility(meander(out, meander_window), immobile_floor, immobile_window)
