"""Readers: workbook rows, video listings, frames, segments, manifests, the gold folder, run folders, detections, annotations."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ethogrid.functions.scalars import subject_key
from ethogrid.schemas import CATALOG_COLUMNS, FRAMES, INDEX_COLUMNS, MANIFEST, SEGMENTS, STATES, UNDETERMINED, check_columns
from ethogrid.sources import files


class GoldDataError(ValueError):
    """The folder contradicts itself; nothing is read from it."""


def workbook(spark: SparkSession, path: str, compound: str = "compound") -> DataFrame:
    """Rows of a workbook exported as CSV, or of an .xlsx if pandas can read one; header white space is collapsed and rows without a compound drop out.

    A workbook is one sheet of some hundred rows; every cell stays text.
    """
    if path.endswith((".xlsx", ".xls")):
        import pandas as pd

        sheet = pd.read_excel(path, dtype=str)
        rows = spark.createDataFrame(sheet.where(sheet.notna(), None))
    else:
        rows = spark.read.option("header", True).option("multiLine", True).csv(path)
    rows = rows.toDF(*[" ".join(c.split()) for c in rows.columns])
    missing = compound not in rows.columns
    if missing:
        raise GoldDataError(f"{path}: no column {compound!r}")
    return rows.where(F.col(compound).isNotNull() & (F.trim(compound) != ""))


def workbook_trials(rows: DataFrame, sex: str = "sex", subject: str = "subject") -> DataFrame:
    """Distinct rows with ``video_id``; a key that occurs twice with other values is an error."""
    got = rows.dropDuplicates().withColumn("video_id", subject_key(F.upper(F.trim(sex)), F.trim(subject)))
    twice = [r[0] for r in got.groupBy("video_id").count().where("count > 1").select("video_id").limit(10).collect()]
    if twice:
        raise GoldDataError(f"more than one row for {', '.join(sorted(twice))}")
    return got


def videos(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of video files under ``folder``; their contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[mM][pP]4").option("recursiveFileLookup", True).load(folder)
    return files.select("path")


def probe(paths: DataFrame, decoder) -> DataFrame:
    """(path, fps, frame_count, width, height, duration_s, error) by ``decoder(path) -> (fps, n, w, h)``; values of 0 or less are an error.

    Decoding video is outside of the engine, so the decoder is the caller's.
    """

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for path in b["path"]:
                try:
                    fps, n, w, h = decoder(path)
                    bad = min(fps, n, w, h) <= 0
                    rows.append((path, fps, n, w, h, None if bad else n / fps, "not a positive number" if bad else None))
                except Exception as e:  # noqa: BLE001 (any decoder)
                    rows.append((path, None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "fps", "frame_count", "width", "height", "duration_s", "error"])

    return paths.select("path").mapInPandas(run, "path string, fps double, frame_count long, width int, height int, duration_s double, error string")


def every_nth(frames: DataFrame, stride: int) -> DataFrame:
    """Frames whose true index is a multiple of ``stride``."""
    return frames.where(F.col("frame_idx") % stride == 0)


def frames(spark: SparkSession, folder: str, columns: list[str] | None = None) -> DataFrame:
    """Stored frames of all subjects (folders ``video_id=...``); with ``columns`` only those are read."""
    df = spark.read.parquet(folder)
    check_columns(df, FRAMES, folder)
    return df.select("video_id", *columns) if columns else df


def frames_between(spark: SparkSession, folder: str, video_id: str, start_s: float, end_s: float) -> DataFrame:
    """One subject's frames in a time window: the folder is pruned and the window is pushed to the scan."""
    return frames(spark, folder).where((F.col("video_id") == video_id) & (F.col("t_sec") >= start_s) & (F.col("t_sec") < end_s))


def segments(spark: SparkSession, folder: str) -> DataFrame:
    """Segments of all subjects: a folder ``video_id=...`` each, as ``writers.write_segments`` makes them, or one named like the subject."""
    rows = spark.read.schema(SEGMENTS).option("header", True).option("recursiveFileLookup", True).csv(folder)
    named = F.regexp_extract(F.input_file_name(), r"/(?:video_id=)?([^/]+)/[^/]+$", 1)
    return rows.withColumn("video_id", F.url_decode(F.replace(named, F.lit("+"), F.lit("%2B"))))  # a plus sign stands for itself in a path


def manifests(spark: SparkSession, pattern: str) -> DataFrame:
    """(video_id, manifest columns, problem): one row a file; text that is no JSON object has a problem instead of values."""
    text = spark.read.text(pattern, wholetext=True).withColumn("video_id", F.regexp_extract(F.input_file_name(), r"/([^/]+)/[^/]+$", 1))
    got = text.withColumn("m", F.from_json("value", MANIFEST, {"mode": "PERMISSIVE"}))
    is_object = F.regexp_like("value", F.lit(r"(?s)^\s*\{.*\}\s*$"))
    problem = F.when(~is_object, "not a JSON object").when(F.col("m.review_status").isNull() & F.col("m.subject_id").isNull(), "unreadable")
    fields = [F.coalesce("m.review_flags", F.array().cast(MANIFEST["review_flags"].dataType)).alias(f) if f == "review_flags" else F.col(f"m.{f}").alias(f) for f in MANIFEST.names]
    return got.select("video_id", *fields, problem.alias("problem"))


def index_table(spark: SparkSession, path: str, columns: list[str] = INDEX_COLUMNS) -> DataFrame:
    df = spark.read.parquet(path)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise GoldDataError(f"{path}: no column {', '.join(missing)}")
    return df


def catalog_table(spark: SparkSession, path: str) -> DataFrame:
    return index_table(spark, path, CATALOG_COLUMNS)


def check_unique(df: DataFrame, keys: list[str], name: str) -> None:
    bad = [str(tuple(r)[:-1]) for r in df.groupBy(*keys).count().where("count > 1").limit(10).collect()]
    if bad:
        raise GoldDataError(f"{name}: not unique: {', '.join(sorted(bad))}")


def check_plain_ids(df: DataFrame, name: str, column: str = "video_id") -> None:
    """Ids name folders, so they hold letters, digits, dots, dashes and underscores only."""
    bad = [r[0] for r in df.where(F.col(column).isNull() | ~F.col(column).rlike(r"^[A-Za-z0-9_][A-Za-z0-9._-]*$")).select(column).limit(10).collect()]
    if bad:
        raise GoldDataError(f"{name}: not a plain id: {bad}")


def state_problems(states: DataFrame, allow_undetermined: bool) -> DataFrame:
    """(video_id, problem) of subjects with null or unknown states, or with Undetermined where that is not allowed."""
    known = F.col("state").isin(*STATES)
    problem = F.when(F.col("state").isNull(), "null state").when(~known, F.concat(F.lit("unknown state "), "state"))
    if not allow_undetermined:
        problem = problem.when(F.col("state") == UNDETERMINED, "Undetermined in an accepted subject")
    return states.withColumn("problem", problem).where("problem is not null").select("video_id", "problem").distinct()


def accepted(index: DataFrame, found: DataFrame, frame_states: DataFrame, profile: str | None = None) -> DataFrame:
    """Index rows with ``reason``: null for the subjects kept, else why they are dropped.

    missing file, unreadable manifest, other profile, or a state that an accepted subject can't have. An index row whose
    manifest is not accepted, or names another compound, is an error of the whole folder.
    """
    check_plain_ids(index, "index")
    check_unique(index, ["video_id"], "index")
    check_unique(index, ["sex", "subject_id"], "index")
    m = found.select(
        F.col("video_id").alias("m_id"), "review_status", "problem", F.col("compound").alias("m_compound"), F.col("calibration_profile_version").alias("m_profile"), "review_flags"
    )
    joined = index.join(m, F.col("video_id") == F.col("m_id"), "left")
    readable = F.col("m_id").isNotNull() & F.col("problem").isNull()
    wrong = joined.where(readable & ((F.col("review_status") != "ACCEPTED") | (F.col("m_compound") != F.col("compound"))))
    bad = [r[0] for r in wrong.select("video_id").limit(10).collect()]
    if bad:
        raise GoldDataError(f"index and manifest disagree: {', '.join(sorted(bad))}")
    states = state_problems(frame_states, allow_undetermined=False).groupBy("video_id").agg(F.min("problem").alias("state_problem"))
    counted = frame_states.groupBy("video_id").agg(F.count("*").alias("n_frames"))
    out = joined.join(states, "video_id", "left").join(counted, "video_id", "left")
    reason = (
        F.when(F.col("m_id").isNull(), "missing manifest").when(F.col("problem").isNotNull(), F.col("problem"))
        .when(F.lit(profile is not None) & ~F.col("m_profile").eqNullSafe(F.lit(profile)), "other profile")
        .when(F.col("n_frames").isNull(), "missing frames").when(F.col("state_problem").isNotNull(), F.col("state_problem"))
    )
    return out.withColumn("reason", reason).select(*index.columns, "review_flags", "reason")


def processed(found: DataFrame, catalog: DataFrame, kept_status: list[str]) -> DataFrame:
    """Folders joined to matched trials, and matched trials without a folder (``reason`` set)."""
    matched = catalog.where("match_status = 'matched'").withColumn("video_id", subject_key(F.col("sex"), F.col("subject_id")))
    unknown = [r[0] for r in found.where(F.col("review_status").isNotNull() & ~F.col("review_status").isin("AUTO", "EDITED", "ACCEPTED", "REJECTED")).select("video_id").limit(10).collect()]
    if unknown:
        raise GoldDataError(f"unknown review status: {', '.join(sorted(unknown))}")
    c = matched.select(F.col("video_id").alias("c_id"), F.col("compound").alias("c_compound"), F.col("concentration_mM").alias("c_dose"), "date")
    left = found.join(c, F.col("video_id") == F.col("c_id"), "left")
    reason = F.when(F.col("problem").isNotNull(), F.col("problem")).when(~F.col("review_status").isin(*kept_status), "status").when(F.col("c_id").isNull(), "no matched trial")
    have = left.select("video_id", F.col("c_compound").alias("compound"), F.col("c_dose").alias("concentration_mM"), "date", reason.alias("reason"))
    lost = matched.join(found.select("video_id"), "video_id", "left_anti").select("video_id", "compound", "concentration_mM", "date", F.lit("missing folder").alias("reason"))
    return have.unionByName(lost)


def whole_tracks(frames_: DataFrame) -> DataFrame:
    """Summaries of subjects whose indices run 0..n-1 without a gap."""
    got = frames_.groupBy("video_id").agg(
        F.count("*").alias("n"), F.min("frame_idx").alias("lo"), F.max("frame_idx").alias("hi"), F.count_distinct("frame_idx").alias("d"), F.count_if("detected").alias("n_detected")
    )
    return got.where((F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1) & (F.col("d") == F.col("n"))).select("video_id", "n", "n_detected")


def track_cache(spark: SparkSession, pattern: str) -> DataFrame:
    """Tracks cached as (gzip) JSON lines."""
    return spark.read.json(pattern)


def reference_targets(spark: SparkSession, path: str) -> DataFrame:
    """(compound, concentration_uM, state, proportion) of a targets file."""
    schema = "groups array<struct<compound:string,concentration_uM:double,proportions:map<string,double>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("groups"))
    return rows.select("compound", "concentration_uM", F.explode("proportions").alias("state", "proportion"))


def samples(spark: SparkSession, pattern: str, split: str | None = None) -> DataFrame:
    """Sample rows (image, video_id, frame_idx, split ...); a repeated image, or a video in two splits, is an error."""
    rows = spark.read.option("mode", "FAILFAST").json(pattern)
    check_unique(rows, ["image"], "samples")
    moved = [r[0] for r in rows.groupBy("video_id").agg(F.count_distinct("split").alias("n")).where("n > 1").limit(10).collect()]
    if moved:
        raise GoldDataError(f"videos in more than one split: {', '.join(sorted(moved))}")
    return rows.where(F.col("split") == split) if split else rows


def training_table(spark: SparkSession, folder: str) -> tuple[DataFrame, dict]:
    """The training table and its column description."""
    path = f"{folder}/schema.json"
    try:
        described = json.loads(files.read(spark, path))
    except (OSError, ValueError) as e:
        raise GoldDataError(f"{path}: {e}") from None
    return spark.read.parquet(f"{folder}/training_table.parquet"), described


def run_table(spark: SparkSession, path: str) -> DataFrame:
    """A run folder's CSV; runs without ablations have the constant ``main``."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return df if "ablation" in df.columns else df.withColumn("ablation", F.lit("main"))


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def config(defaults: dict, override: dict | None = None, environment: dict | None = None, prefix: str = "ETHO_") -> dict:
    """Defaults, deep-merged with ``override``, then environment variables (``ETHO_A__B`` sets a.b); types follow the defaults."""

    def merge(a: dict, b: dict, at: str) -> dict:
        out = dict(a)
        for k, v in b.items():
            if k not in a:
                raise ValueError(f"unknown setting {at}{k}")
            if isinstance(a[k], dict) != isinstance(v, dict):
                raise ValueError(f"{at}{k}: a section on one side only")
            out[k] = merge(a[k], v, f"{at}{k}.") if isinstance(v, dict) else v
        return out

    out = merge(defaults, override or {}, "")
    for name, value in (environment or {}).items():
        if name.startswith(prefix):
            *path, last = name[len(prefix):].lower().split("__")
            at = out
            for p in path:
                at = at[p]
            old = at[last]
            at[last] = value.lower() in ("1", "true", "yes") if isinstance(old, bool) else type(old)(value) if old is not None else value
    return out
