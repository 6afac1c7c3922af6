"""Checks of a gold folder: keys, dates, frame rates, tracker evidence, reference groups, and columns that may not be features."""

from __future__ import annotations

from fnmatch import fnmatchcase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that are never features, as patterns, and those allowed only on request.
FORBIDDEN = (
    "compound", "concentration_mM", "subject_id", "date", "video_id", "*_path",
    "reviewer", "reviewed_at", "reviewed", "review_status", "review_flags", "review_flag_count",
    "edited", "edit_count", "manual_share", "provenance", "processed_at",
    "calibration_profile_version", "pipeline_version",
    "agent_exposure_min", "ntt_min", "uv_min", "h2o_*", "brain_tissue", "body_tissue",
    "video_duration_s", "video_fps", "resolution", "recording_s",
)
DEMOGRAPHICS = ("age", "sex", "strain")
#: Compounds with published panels, their doses in micromolar, and the vehicle's concentration.
PANELS = ("mdma", "methylone", "dob", "fentanyl")
MICROMOLAR = {"0.03": 30, "0.1": 100}
VEHICLE, VEHICLE_CONCENTRATION = "veh", "1% dmso"


def _blank(table: DataFrame, name: str) -> Column:
    kind = dict(table.dtypes)[name]
    c = F.col(name)
    if kind in ("double", "float"):
        return c.isNull() | F.isnan(c)
    return c.isNull() | (F.trim(c) == "") if kind == "string" else c.isNull()


def blank_counts(table: DataFrame, columns: list[str]) -> DataFrame:
    """(column, blanks) of key columns with null, NaN or blank values, in one pass."""
    one = table.agg(*[F.count_if(_blank(table, c)).alias(c) for c in columns])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("blanks")) for c in columns]))).where("blanks > 0")


def repeated_keys(table: DataFrame, key: list[str]) -> DataFrame:
    """(key, rows) of keys that more than one row has."""
    return table.groupBy(*key).agg(F.count("*").alias("rows")).where("rows > 1")


def unplain_ids(table: DataFrame, column: str = "video_id") -> DataFrame:
    """Rows whose id can't name a folder: null, empty, a dot name, or with a slash."""
    c = F.col(column)
    return table.where(c.isNull() | c.isin("", ".", "..") | c.contains("/"))


def undated(videos: DataFrame) -> DataFrame:
    """Rows without an experiment date, which no validation group can take."""
    return videos.where(_blank(videos, "date"))


def fps_spread(videos: DataFrame, tolerance: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, videos, bad, low, high, uniform): frame rates that are no positive number are bad; rates are uniform if none is bad and high - low <= tolerance * low."""
    fps = F.col("video_fps").cast("double")
    ok = fps.isNotNull() & ~F.isnan(fps) & (fps > 0) & (fps < float("inf"))
    good = F.when(ok, fps)
    got = videos.groupBy(*by).agg(F.count("*").alias("videos"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("bad"), F.min(good).alias("low"), F.max(good).alias("high"))
    level = F.coalesce(F.col("high") - F.col("low") <= tolerance * F.col("low"), F.lit(False))
    return got.withColumn("uniform", (F.col("bad") == 0) & level)


def evidence_conflicts(videos: DataFrame, evidence: DataFrame, is_model: bool) -> DataFrame:
    """``videos`` whose output folder (``evidence``: video_id, has_detections) has a detections file though the profile is not a model's, or lacks it though it is.

    Videos without an output folder are not checked.
    """
    wrong = evidence.where(F.col("has_detections") != F.lit(is_model)).select("video_id").distinct()
    return videos.join(wrong, "video_id", "left_semi")


def forbidden_columns(columns: list[str], demographics: bool = False) -> list[str]:
    """The columns that must not be features, in order; age, sex and strain only count if ``demographics`` is false."""
    patterns = FORBIDDEN if demographics else FORBIDDEN + DEMOGRAPHICS
    return [c for c in columns if any(fnmatchcase(c, p) for p in patterns)]


def reference_group(compound: Column, concentration: Column) -> Column:
    """(compound, micromolar) of the published panel a trial belongs to, null if there is none."""
    name = F.replace(F.lower(F.trim(compound)), F.lit(" "), F.lit(""))
    dose = F.lower(F.trim(concentration))
    um = F.when((name == VEHICLE) & (dose == VEHICLE_CONCENTRATION), F.lit(0))
    for text, value in MICROMOLAR.items():
        um = um.when(name.isin(*PANELS) & (dose == text), F.lit(value))
    return F.when(um.isNotNull(), F.struct(name.alias("compound"), um.alias("micromolar")))
