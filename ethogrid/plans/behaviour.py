"""Queries of the time-series operators over the ``events`` tracks, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ethogrid.operators import features as feat
from ethogrid.operators import flags, islands, kinematics, labeling, review
from ethogrid.schemas import STATES
from ethogrid.sources import adapters

LAG, FREEZE, ERRATIC, MIN_FREEZE, SURFACE_DEPTH, MIN_DEAD = 24.0, 3.0, 6.0, 8.0, 20.0, 8.0
BIN, MIN_DETERMINED, MEANDER_WINDOW, IMMOBILE_WINDOW, IMMOBILE_FLOOR = 24.0, 0.5, 5, 3, 12.0


def r6(*names: str):
    """Doubles rounded to six places, without negative zero."""
    return [(F.round(n, 6) + F.lit(0.0)).alias(n) for n in names]


def run_length(spark: SparkSession, sf: str) -> DataFrame:
    return islands.run_length(adapters.tracks(spark, sf)).select("video_id", "frame_idx", "run_length")


def velocity(spark, sf):
    return kinematics.velocity(adapters.tracks(spark, sf)).select("video_id", "frame_idx", *r6("velocity"), "velocity_valid")


def acceleration(spark, sf):
    return kinematics.acceleration(kinematics.velocity(adapters.tracks(spark, sf))).select("video_id", "frame_idx", *r6("acceleration"), "acceleration_valid")


def angular_velocity(spark, sf):
    return kinematics.angular_velocity(kinematics.velocity(adapters.tracks(spark, sf))).select("video_id", "frame_idx", *r6("angular_velocity"), "angular_valid")


def meander(spark, sf):
    return kinematics.meander(kinematics.velocity(adapters.tracks(spark, sf)), MEANDER_WINDOW).select("video_id", "frame_idx", *r6("meander"))


def immobility(spark, sf):
    return kinematics.immobility(kinematics.velocity(adapters.tracks(spark, sf)), IMMOBILE_FLOOR, IMMOBILE_WINDOW).select("video_id", "frame_idx", "is_immobile")


def smoothed_speed(spark, sf):
    return kinematics.smoothed_speed(adapters.tracks(spark, sf), LAG).select("video_id", "frame_idx", "lag_rows", *r6("speed"), "speed_valid")


def _states(spark, sf) -> DataFrame:
    speed = kinematics.smoothed_speed(adapters.tracks(spark, sf), LAG)
    return labeling.classify(speed, FREEZE, MIN_FREEZE, ERRATIC, SURFACE_DEPTH, MIN_DEAD).withColumn("source", F.lit("auto"))


def classify_states(spark, sf):
    return _states(spark, sf).select("video_id", "frame_idx", "state")


def listing_states(spark, sf):
    """The rules with the optional tilt rule on."""
    speed = kinematics.smoothed_speed(adapters.tracks(spark, sf), LAG)
    return labeling.classify(speed, FREEZE, MIN_FREEZE, ERRATIC, SURFACE_DEPTH, MIN_DEAD, 40.0, 5.0).select("video_id", "frame_idx", "state")


def dead_suffix(spark, sf):
    speed = kinematics.smoothed_speed(adapters.tracks(spark, sf), LAG).withColumn("still", F.col("speed_valid") & (F.col("speed") <= FREEZE))
    return islands.terminal_run(speed, "still", MIN_DEAD, "is_dead").where("is_dead").select("video_id", "frame_idx")


def consolidate_bins(spark, sf):
    return labeling.consolidate_bins(_states(spark, sf), BIN, MIN_DETERMINED)


def consolidated_states(spark, sf):
    return labeling.consolidate(_states(spark, sf), BIN, MIN_DETERMINED).select("video_id", "frame_idx", "bin", "state")


def dead_violations(spark, sf):
    return labeling.dead_violations(_states(spark, sf)).select("video_id", "frame_idx", "state")


def segments(spark, sf):
    return labeling.segments(adapters.labelled(spark, sf)).select("video_id", *r6("start_s", "end_s", "duration_s"), "state", "source")


def segments_ignoring_gaps(spark, sf):
    return labeling.segments(adapters.labelled(spark, sf), break_on_gaps=False).select("video_id", *r6("start_s", "end_s", "duration_s"), "state", "source")


def bouts(spark, sf):
    return labeling.bouts(labeling.segments(adapters.labelled(spark, sf))).select("video_id", "bout", "state", *r6("start_s", "duration_s"))


def transitions(spark, sf):
    return labeling.transitions(labeling.bouts(labeling.segments(adapters.labelled(spark, sf))))


def segments_to_frames(spark, sf):
    lab = adapters.labelled(spark, sf)
    return labeling.segments_to_frames(labeling.segments(lab), lab).select("video_id", "frame_idx", "state", "source")


EDITS = [(1, 100.0, 200.0, "Dead"), (2, 150.0, 260.0, "Surface Breach"), (3, 120.0, 160.0, "Freezing/Drift")]


def _every_edit(spark, sf) -> DataFrame:
    ids = adapters.tracks(spark, sf).select("video_id").distinct()
    rows = F.array(*[F.struct(F.lit(n).alias("edit_no"), F.lit(a).alias("start_s"), F.lit(b).alias("end_s"), F.lit(s).alias("new_state")) for n, a, b, s in EDITS])
    return ids.select("video_id", F.inline(rows))


def apply_edits(spark, sf):
    return review.apply_edits(adapters.labelled(spark, sf), _every_edit(spark, sf)).select("video_id", "frame_idx", "state", "source")


def merge_edit_intervals(spark, sf):
    segs = labeling.segments(adapters.labelled(spark, sf))
    return review.overlay_edits(segs, _every_edit(spark, sf)).select("video_id", *r6("start_s", "end_s"), "state", "source")


def edit_totals(spark, sf):
    """Seconds of each state after the edits."""
    segs = labeling.segments(adapters.labelled(spark, sf))
    got = review.overlay_edits(segs, _every_edit(spark, sf)).groupBy("video_id", "state").agg(F.sum(F.col("end_s") - F.col("start_s")).alias("seconds"))
    return got.select("video_id", "state", *r6("seconds"))


def session_flags(spark, sf):
    samples = adapters.tracks(spark, sf).select("video_id", F.col("t_sec").alias("t"), F.col("x").alias("score"))
    return flags.session_flags(samples, 10.0, 8.0, 2).select("video_id", *r6("start_s", "end_s", "max_score"), "n_samples")


def undetected_gaps(spark, sf):
    return flags.undetected_gaps(adapters.tracks(spark, sf))


def terminal_no_action(spark, sf):
    speed = kinematics.smoothed_speed(adapters.tracks(spark, sf), LAG)
    return flags.terminal_no_action(speed, FREEZE, 12.0).select("video_id", *r6("start_s", "end_s"), "from_mmss")


def segment_features(spark, sf):
    got = feat.segment_features(labeling.segments(adapters.labelled(spark, sf)))
    return got.select("video_id", *r6(*[c for c in got.columns if c != "video_id"]))


def kinematic_features(spark, sf):
    got = feat.kinematic_features(kinematics.features(adapters.tracks(spark, sf), MEANDER_WINDOW, IMMOBILE_FLOOR, IMMOBILE_WINDOW))
    return got.select("video_id", *r6(*[c for c in got.columns if c != "video_id"]))


def undetermined_share(spark, sf):
    return feat.undetermined_share(labeling.segments(adapters.labelled(spark, sf))).select("video_id", *r6("undetermined_share"))


def state_seconds(spark, sf):
    return feat.state_seconds(labeling.segments(adapters.labelled(spark, sf))).select("video_id", "state", *r6("seconds"), "segments")


def timeline(spark, sf):
    got = feat.timeline(kinematics.velocity(adapters.labelled(spark, sf)), 60.0)
    return got.select("video_id", "bin", *r6(*[c for c in got.columns if c not in ("video_id", "bin")]))


def explain_bins(spark, sf):
    got = feat.explain_bins(_states(spark, sf), BIN)
    return got.select("video_id", "bin", "n", "n_detected", *r6("speed_median", "y_min"), *[f"n_{i}" for i in range(len(STATES))], "winner")


def downsample_first(spark, sf):
    return flags.first_of_each(adapters.tracks(spark, sf), 10.0).select("video_id", "frame_idx", *r6("t_sec"))


def strided_expand(spark, sf):
    t = adapters.tracks(spark, sf).where("frame_idx % 5 = 0")
    return flags.strided_expand(t, 5).select("video_id", "frame_idx", *r6("x", "y"), "detected")


def flagship(spark, sf):
    """Tracks to smoothed speed, states, bins, segments and state shares: one row for each subject."""
    states = labeling.consolidate(_states(spark, sf), BIN, MIN_DETERMINED)
    got = feat.segment_features(labeling.segments(states))
    names = [c for c in got.columns if c.endswith("_share")]
    return got.select("video_id", *r6(*names, "recording_s"))


QUERIES = {
    f.__name__: f
    for f in (
        run_length, velocity, acceleration, angular_velocity, meander, immobility, smoothed_speed, classify_states, listing_states, dead_suffix,
        consolidate_bins, consolidated_states, dead_violations, segments, segments_ignoring_gaps, bouts, transitions, segments_to_frames, apply_edits, merge_edit_intervals,
        edit_totals, session_flags, undetected_gaps, terminal_no_action, segment_features, kinematic_features, undetermined_share, state_seconds, timeline,
        explain_bins, downsample_first, strided_expand, flagship,
    )
}
