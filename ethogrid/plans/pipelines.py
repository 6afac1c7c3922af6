"""Queries that run a stream, a model or a tool over the test tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethogrid.operators import folds, labeling, revision, training
from ethogrid.plans import tools
from ethogrid.plans.behaviour import IMMOBILE_FLOOR, IMMOBILE_WINDOW, MEANDER_WINDOW, r6
from ethogrid.plans.behaviour import _every_edit as every_edit
from ethogrid.plans.behaviour_sql import ORACLE as BEHAVIOUR_ORACLE
from ethogrid.plans.behaviour_sql import RUNS, TRACKS
from ethogrid.plans.subjects import FEATURES, VEHICLE
from ethogrid.schemas import CONTROLLED, ERRATIC, FREEZING, SURFACE, UNDETERMINED
from ethogrid.sources import adapters, track_files
from ethogrid.sources.store import Store
from ethogrid.sources.tables import new_folder
from ethogrid.streaming import live, rolling

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def _event_states(e: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    state = F.when(kind == "click", CONTROLLED).when(kind == "purchase", ERRATIC).when(kind == "view", FREEZING).when(kind == "signup", SURFACE).otherwise(UNDETERMINED)
    return e.select(F.col("user_id").cast("string").alias("video_id"), F.col("ts").cast("timestamp").alias("ts"), state.alias("state"), F.col("value").alias("score"))


_BINS = """
WITH s AS (SELECT CAST(user_id AS VARCHAR) AS video_id, epoch_us(ts) // 86400000000 AS day, event_type AS t FROM events),
v AS (SELECT video_id, day, count(*) AS n, count(*) FILTER (t = 'click') AS c, count(*) FILTER (t = 'purchase') AS e, count(*) FILTER (t = 'view') AS f, count(*) FILTER (t = 'signup') AS s,
  count(*) FILTER (t = 'error') AS u FROM s GROUP BY ALL)
SELECT video_id, day, n, CASE WHEN u = n OR (n - u) / n < 0.5 THEN 'Undetermined' WHEN s > 0 THEN 'Surface Breach' WHEN f >= greatest(c, e) THEN 'Freezing/Drift' WHEN e >= c THEN 'Erratic Movement' ELSE 'Controlled Swim' END AS state FROM v
"""


def _days(df: DataFrame) -> DataFrame:
    return df.select("video_id", F.floor(F.unix_micros("start") / 86_400_000_000).alias("day"), "n", "state")


@query(_BINS)
def batch_bins(spark, sf) -> DataFrame:
    return _days(live.stream_bins(_event_states(adapters.read(spark, sf, "events")), "1 day"))


@query(_BINS)
def stream_bins(spark, sf):
    """The same bins from a stream over the files of ``events``, run until all input is used."""
    source = adapters.read(spark, sf, "events")
    base = os.path.basename(source.inputFiles()[0])
    folder = source.inputFiles()[0].rpartition("/")[0]
    rows = spark.readStream.schema(source.schema).option("pathGlobFilter", base if base == "events.parquet" else "*.parquet").parquet(folder)
    out = new_folder(spark, "bins")
    bins = live.stream_bins(_event_states(rows), "1 day")

    def keep(batch: DataFrame, n: int) -> None:  # complete mode: each micro-batch holds all bins so far
        batch.write.mode("overwrite").parquet(f"{out}/rows")

    q = bins.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return _days(spark.read.schema(bins.schema).parquet(f"{out}/rows"))


@query(TRACKS + RUNS + "q AS (SELECT video_id, frame_idx, round(velocity, 6) + 0 AS velocity, velocity_valid, round(CASE WHEN dists > 1e-9 THEN turns / dists ELSE 0 END, 6) + 0 AS meander, is_immobile FROM mea) SELECT * FROM q")
def rolling_stream(spark, sf):
    """Velocity, meander and immobility of all tracks from a stateful stream over their rows; a last row far ahead of all moves the watermark past them."""
    rolling.use_state_store(spark)
    folder = new_folder(spark, "rolling")
    t = adapters.tracks(spark, sf).select("video_id", "frame_idx", "t_sec", "x", "y", "detected")
    t.withColumn("ts", F.timestamp_seconds(F.lit(1.7e9) + F.col("t_sec"))).write.parquet(f"{folder}/in/rows")
    last = spark.range(1).select(F.lit("").alias("video_id"), F.lit(0).alias("frame_idx"), *[F.lit(0.0).alias(c) for c in ("t_sec", "x", "y")], F.lit(False).alias("detected"), F.timestamp_seconds(F.lit(4e9)).alias("ts"))
    last.write.parquet(f"{folder}/in/last")
    rows = spark.readStream.schema(spark.read.parquet(f"{folder}/in/rows").schema).option("recursiveFileLookup", True).parquet(f"{folder}/in")
    made = rolling.stream_rolling(rows, MEANDER_WINDOW, IMMOBILE_FLOOR, IMMOBILE_WINDOW, "1 day")
    made.writeStream.option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(rolling.OUTPUT).parquet(f"{folder}/out").where("video_id <> ''")
    return got.select("video_id", "frame_idx", *r6("velocity"), "velocity_valid", *r6("meander"), "is_immobile")


_LIVING = "edit_no > 1"  # the edits but Dead, which no row may follow


@query(BEHAVIOUR_ORACLE["apply_edits"].replace("JOIN ed\n", f"JOIN (SELECT * FROM ed WHERE {_LIVING}) ed\n"))
def reviewed_store(spark, sf):
    """All labelled tracks exported and committed, edited under revisions, rerun and read back."""
    folder = new_folder(spark, "store")
    store, log = Store(spark, f"{folder}/subjects"), revision.EditLog(spark, f"{folder}/log")
    frames = adapters.labelled(spark, sf).select("video_id", "frame_idx", "t_sec", "state", "source")
    store.export(frames, labeling.segments(frames).drop("segment"), frames.select("video_id").distinct().withColumn("review_status", F.lit("AUTO")))
    now = store.part("frames")
    log.submit(revision.baselines(now).withColumn("revision", F.lit(0)), every_edit(spark, sf).where(_LIVING), now)
    revision.rerun(store, log)
    return store.part("frames").select("video_id", "frame_idx", "state", "source")


@query("""WITH h AS (SELECT CAST(user_id AS VARCHAR) AS video_id, epoch_us(ts) AS us, value FROM events WHERE value >= 20),
b AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY video_id ORDER BY us) < 43200000000 THEN 0 ELSE 1 END AS brk FROM h),
g AS (SELECT *, sum(brk) OVER (PARTITION BY video_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS s FROM b)
SELECT video_id, min(us) AS start_us, max(us) + 43200000000 AS end_us, count(*) AS n, max(value) AS max_score FROM g GROUP BY video_id, s HAVING count(*) >= 2""")
def session_windows(spark, sf):
    rows = _event_states(adapters.read(spark, sf, "events")).where("score >= 20")
    got = live.stream_sessions(rows, "12 hours", least=2)
    return got.select("video_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n", "max_score")


@query()
def reject_jumps(spark, sf):
    """Sequential jump rejection of every track."""
    t = adapters.tracks(spark, sf)
    seen = t.select("video_id", "frame_idx", F.when(F.col("detected"), F.col("x")).alias("x"), F.when(F.col("detected"), F.col("y")).alias("y"))
    return live.reject_jumps(seen, 120.0, 3)


def _labelled(spark, sf) -> DataFrame:
    return adapters.subjects(spark, sf).withColumn("label", F.col("sex"))


@query()
def cross_validation(spark, sf):
    """Balanced accuracy of two baselines and logistic regression over three folds of scheme B."""
    t = _labelled(spark, sf)
    placed = folds.folds(t, 3, 1, 1).where("scheme = 'B'")
    long = training.cross_fit(training.as_rows(t, FEATURES), placed, models=("majority", "date_only", "logistic"), log=[FEATURES.index("f_orders")], seed=1)
    return training.scores(long, ["model", "scheme", "repeat"]).select("model", "scheme", "repeat", *r6("balanced_accuracy", "macro_f1", "log_loss"), "n")


def research_data(spark, sf) -> tools.ResearchData:
    meanings = {"f_orders": "finished orders", "f_mean_price": "mean price", "f_max_price": "largest price", "f_acctbal": "balance"}
    return tools.ResearchData(adapters.subjects(spark, sf), meanings, VEHICLE)


@query()
def tool_answers(spark, sf):
    """Every research tool that needs the subject table only, called by name; answers as JSON."""
    data = research_data(spark, sf)
    import json

    asked = [
        ("list_compounds", {}), ("find_features", {"search": "price"}), ("compare_to_vehicle", {"feature": "f_mean_price", "compound": "machinery"}), ("top_differences", {"compound": "FURNITURE"}),
        ("feature_by_compound", {"feature": "f_orders"}), ("subject_profile", {"video_id": "F_000007"}), ("audit_facts", {}), ("no_such_tool", {}),
    ]
    return spark.createDataFrame([(n, json.dumps(tools.call(data, n, a), sort_keys=True)) for n, a in asked], "tool string, answer string")


@query(TRACKS + "q AS (SELECT video_id, frame_idx, round(t_sec, 6) + 0 AS t_sec, round(x, 6) + 0 AS x, orientation_deg, detected FROM tracks WHERE t_sec >= 10 AND t_sec < 400 AND frame_idx % 2 = 0) SELECT * FROM q")
def track_file_window(spark, sf):
    """All tracks written as a file a subject and read back by the data source: every second row between two times, which the readers cut."""
    folder = new_folder(spark, "tracks")
    track_files.write(adapters.tracks(spark, sf), folder).write.format("noop").mode("overwrite").save()
    got = track_files.read(spark, folder, stride=2).where((F.col("t_sec") >= 10) & (F.col("t_sec") < 400))
    return got.select("video_id", "frame_idx", *r6("t_sec", "x"), "orientation_deg", "detected")
