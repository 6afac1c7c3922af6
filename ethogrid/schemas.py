"""Row schemas, behaviour states and their orders."""

from __future__ import annotations

from pyspark.sql import types as T

# State names in declaration order, tie priorities and sources.
CONTROLLED, ERRATIC, FREEZING, SURFACE = "Controlled Swim", "Erratic Movement", "Freezing/Drift", "Surface Breach"
LISTING, DEAD, UNDETERMINED = "Listing/LORR", "Dead", "Undetermined"
STATES = (CONTROLLED, ERRATIC, FREEZING, SURFACE, LISTING, DEAD, UNDETERMINED)
BEHAVIOUR_STATES = STATES[:-1]
TIE_PRIORITY = {DEAD: 5, LISTING: 4, FREEZING: 3, ERRATIC: 2, CONTROLLED: 1}
SOURCES = ("auto", "manual")

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def struct(text: str, **more: T.DataType) -> T.StructType:
    """Row type from ``name type, name type`` without a session."""
    pairs = [x.split() for x in text.split(",")]
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in pairs] + [T.StructField(n, t) for n, t in more.items()])


TRACKS = struct(
    "video_id string, frame_idx int, t_sec double, x double, y double, orientation_deg double, y_from_frame_top double, detected boolean"
)
FRAMES = struct(
    "frame_idx int, t_sec float, x float, y float, orientation_deg float, depth_from_surface float, velocity float, acceleration float, "
    "angular_velocity float, meander float, is_immobile boolean, detected boolean, state string, source string, confidence float"
)
SEGMENTS = struct("start_s double, end_s double, duration_s double, state string, source string")
FLAG = struct("kind string, start_s double, end_s double, message string")
MANIFEST = struct(
    "subject_id string, sex string, compound string, concentration_mM string, video_path string, video_duration_s double, video_fps double, "
    "pipeline_version string, calibration_profile_version string, processed_at string, review_status string, reviewer string, reviewed_at string, "
    "edited boolean, edit_count long",
    review_flags=T.ArrayType(FLAG),
)
INDEX_COLUMNS = (
    "video_id subject_id sex compound concentration_mM strain age date agent_exposure_min video_path video_duration_s video_fps pipeline_version "
    "calibration_profile_version reviewer reviewed_at provenance edit_count frames_path segments_path strip_path manifest_path"
).split()
CATALOG_COLUMNS = "subject_id sex strain age compound concentration_mM date agent_exposure_min video_path match_status".split()


def check_columns(df, wanted: T.StructType, name: str) -> None:
    """Missing or retyped columns are an error; extra ones pass. Only the schema is looked at, no row."""
    have = {f.name: f.dataType for f in df.schema.fields}
    bad = [f"{f.name} {f.dataType.simpleString()}" for f in wanted.fields if have.get(f.name) != f.dataType]
    if bad:
        raise ValueError(f"{name}: missing or of another type: {', '.join(bad)}")
