"""Synthetic subjects and tracks for trying an analysis out: every value follows from an id, a frame and the seed, so any executor makes the same rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRIME = 1_000_003


@dataclass(frozen=True)
class Knobs:
    seed: int = 1
    compounds: tuple[str, ...] = ("veh", "alpha", "beta")
    doses: tuple[str, ...] = ("0.03", "0.1")
    dates: int = 8
    first_date: str = "2024-01-01"
    females: float = 0.5
    frames: int = 50
    fps: float = 10.0
    width: float = 640.0
    height: float = 480.0
    detected: float = 0.95
    still: float = 0.4
    step_px: float = 6.0
    #: Relative gain of the step for each compound after the first.
    effect: float = 0.5
    #: Pixels by which a recording date moves its tracks to the right.
    date_shift: float = 3.0


def noise(a: Column, b: Column, salt: int) -> Column:
    """A number from 0 up to 1 by two rounds of modular mixing; ``a`` and ``b`` are whole and not negative."""
    first = (a * 7919 + b * 104_729 + salt * 611_953) % PRIME
    return ((first * 48_271 + (first % 1009) * (first % 1013) + salt) % PRIME) / F.lit(float(PRIME))


def subjects(ids: DataFrame, knobs: Knobs) -> DataFrame:
    """One subject for each ``id``: compound, dose (the first compound has dose 0), date and sex drawn independently."""
    i, zero = F.col("id").cast("long"), F.lit(0)

    def draw(n: int, salt: int) -> Column:
        return F.floor(noise(i, zero, knobs.seed * 100 + salt) * n).cast("int")

    named = ids.select(i.alias("id"), draw(len(knobs.compounds), 1).alias("compound_no"), draw(len(knobs.doses), 2).alias("dose_no"), draw(knobs.dates, 3).alias("date_no"))
    dose = F.when(F.col("compound_no") == 0, "0").otherwise(F.get(F.array(*map(F.lit, knobs.doses)), F.col("dose_no")))
    return named.select(
        "id", F.concat(F.lit("S_"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("video_id"), F.get(F.array(*map(F.lit, knobs.compounds)), F.col("compound_no")).alias("compound"),
        dose.alias("concentration_mM"), F.date_add(F.lit(knobs.first_date).cast("date"), F.col("date_no")).alias("date"),
        F.when(noise(F.col("id"), zero, knobs.seed * 100 + 4) < knobs.females, "F").otherwise("M").alias("sex"), "compound_no", "date_no",
    )


def tracks(table: DataFrame, knobs: Knobs) -> DataFrame:
    """Random walks of ``subjects``: (video_id, frame_idx, t_sec, x, y, detected); steps grow with the compound, places shift with the date."""
    rows = table.select("id", "video_id", "compound_no", "date_no", F.explode(F.sequence(F.lit(0), F.lit(knobs.frames - 1))).alias("frame_idx"))
    i, k = F.col("id"), F.col("frame_idx")

    def u(salt: int) -> Column:
        return noise(i, k, knobs.seed * 100 + salt)

    size = F.when(u(5) < knobs.still, 0.0).otherwise(knobs.step_px * (1 + knobs.effect * F.col("compound_no")))
    w = Window.partitionBy("id").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    seen = u(8) < knobs.detected
    walk = rows.select(
        "id", "video_id", "frame_idx", (k / F.lit(knobs.fps)).alias("t_sec"), seen.alias("detected"), F.col("date_no"),
        (size * (2 * u(6) - 1)).alias("dx"), (size * (2 * u(7) - 1)).alias("dy"),
    )
    x = F.sum("dx").over(w) + knobs.width / 2 + knobs.date_shift * F.col("date_no")
    y = F.sum("dy").over(w) + knobs.height / 2
    placed = walk.withColumn("x", F.least(F.greatest(x, F.lit(0.0)), F.lit(knobs.width))).withColumn("y", F.least(F.greatest(y, F.lit(0.0)), F.lit(knobs.height)))
    return placed.select("video_id", "frame_idx", "t_sec", F.when(F.col("detected"), F.col("x")).otherwise(0.0).alias("x"), F.when(F.col("detected"), F.col("y")).otherwise(0.0).alias("y"), "detected")
