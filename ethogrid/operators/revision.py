"""Review edits with optimistic revisions: a versioned log of edits, and reruns of the subjects that changed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ethogrid.operators import labeling, review
from ethogrid.sources import commits
from ethogrid.sources.store import Store
from ethogrid.sources.tables import written


def baselines(frames: DataFrame) -> DataFrame:
    """(video_id, baseline): a digest of the rows that edits were made on; it follows from the set of rows, not from their order."""
    row = F.xxhash64(F.struct("frame_idx", F.col("t_sec").cast("float"), "state", "source").cast("string"))
    return frames.groupBy("video_id").agg(F.concat_ws("-", F.count("*").cast("string"), F.hex(F.bit_xor(row)), F.hex(F.sum((row % (1 << 40)).cast("decimal(38,0)")).cast("long"))).alias("baseline"))


class EditLog:
    """Edits of subjects in ``folder``: data below edits/commit=<id>, made visible by numbered commits. A subject's revision is the number of submissions accepted for it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _all(self) -> DataFrame | None:
        found = commits.entries(self.spark, self.folder)
        if not found:
            return None
        numbers = F.broadcast(self.spark.createDataFrame([(c["id"], n) for n, c in found], "commit string, number long"))
        rows = self.spark.read.option("basePath", f"{self.folder}/edits").parquet(*[f"{self.folder}/edits/commit={c['id']}" for _, c in found])
        return rows.withColumn("commit", F.col("commit").cast("string")).join(numbers, "commit")

    def revisions(self) -> DataFrame | None:
        """(video_id, revision, baseline) of subjects with edits; None before the first commit."""
        rows = self._all()
        return None if rows is None else rows.groupBy("video_id").agg(F.max("revision").alias("revision"), F.max_by("baseline", "revision").alias("baseline"))

    def edits(self) -> DataFrame | None:
        """(video_id, edit_no, start_s, end_s, new_state) in the order of their revisions; a submission replaces the subject's earlier edits, an empty one takes them all back."""
        rows = self._all()
        if rows is None:
            return None
        last = rows.withColumn("__last", F.max("revision").over(Window.partitionBy("video_id"))).where("revision = __last AND edit_no IS NOT NULL")
        return last.select("video_id", "edit_no", "start_s", "end_s", "new_state")

    def check(self, asked: DataFrame, frames: DataFrame) -> DataFrame:
        """``asked`` (video_id, revision, baseline) with ``refused``: null, stale revision, changed baseline or unknown subject."""
        now = baselines(frames.join(asked.select(F.col("video_id").alias("__id")), F.col("video_id") == F.col("__id"), "left_semi")).withColumnRenamed("baseline", "__base")
        out = asked.join(now, "video_id", "left")
        known = self.revisions()
        out = out.withColumn("__rev", F.lit(0).cast("long")) if known is None else out.join(known.select("video_id", F.col("revision").alias("__rev")), "video_id", "left")
        why = F.when(F.col("__base").isNull(), "unknown subject").when(F.col("revision") != F.coalesce("__rev", F.lit(0)), "stale revision").when(F.col("baseline") != F.col("__base"), "changed baseline")
        return out.withColumn("refused", why).drop("__base", "__rev")

    def submit(self, asked: DataFrame, edits: DataFrame, frames: DataFrame, reviewer: str = "", before_commit=lambda: None) -> DataFrame:
        """Takes the edits (video_id, edit_no, start_s, end_s, new_state) of the subjects of ``asked`` (video_id, revision, baseline) whose revision and baseline are current; returns
        (video_id, revision, refused): the new revision, or the old one and why. A subject of ``asked`` without edits takes its edits back.

        Compare and set: what is checked against commit n counts only as commit n + 1. If another writer was faster, everything is checked again, so of two writers on one subject
        one is refused, while others of their subjects go through.
        """
        asked, edits = written(asked.select("video_id", F.col("revision").cast("long").alias("revision"), "baseline"), "asked"), written(edits, "edits")
        while True:
            number = commits.last_number(self.spark, self.folder)
            checked = written(self.check(asked, frames), "checked")
            good = checked.where("refused IS NULL").select("video_id", (F.col("revision") + 1).alias("revision"), "baseline")
            if good.limit(1).count():
                commit = uuid.uuid4().hex
                rows = good.join(edits, "video_id", "left").withColumn("reviewer", F.lit(reviewer))
                rows.write.parquet(f"{self.folder}/edits/commit={commit}")
                before_commit()
                try:
                    commits.append(self.spark, self.folder, number, {"id": commit})
                except commits.Conflict:
                    continue
            return checked.select("video_id", F.when(F.col("refused").isNull(), F.col("revision") + 1).otherwise(F.col("revision")).alias("revision"), "refused")


def rerun(store: Store, log: EditLog) -> int | None:
    """Applies the log's edits to the subjects whose revision is ahead of their manifest's and exports those alone; the commit's number, None if there is nothing to do.

    Edits are applied to each subject's automatic frames: those of its first run, which the column ``auto_state`` keeps. The manifest's ``revision`` tells which edits are in. An edit that leaves
    a subject alive after Dead is an error of that subject, which stays as it is.
    """
    known = log.revisions()
    m = store.manifests()
    if known is None or m is None:
        return None
    have = F.coalesce(F.col("done"), F.lit(0)) if "revision" in m.columns else F.lit(0)
    done = m.select("video_id", *([F.col("revision").alias("done")] if "revision" in m.columns else []))
    todo = written(known.join(done, "video_id").where(F.col("revision") > have).select("video_id", "revision"), "todo")
    if not todo.limit(1).count():
        return None
    frames = store.part("frames").join(todo.select("video_id"), "video_id", "left_semi")
    auto = frames if "auto_state" not in frames.columns else frames.withColumn("state", F.coalesce("auto_state", "state")).withColumn("source", F.lit("auto"))
    auto = auto.withColumn("auto_state", F.col("state"))
    edited = written(review.apply_edits(auto, log.edits().join(todo.select("video_id"), "video_id", "left_semi")), "edited")
    bad = labeling.dead_violations(edited).select("video_id").distinct()
    good = todo.join(bad, "video_id", "left_anti")
    edited = edited.join(good.select("video_id"), "video_id", "left_semi")
    segs = labeling.segments(edited).drop("segment")
    keep = [c for c in m.columns if c not in ("run", "number", "revision", "review_status")]
    manifests = m.select(*keep).join(good, "video_id").withColumn("review_status", F.lit("EDITED"))
    return store.export(edited, segs, manifests, force=True)
