"""Processed subjects: frames, segments, detections and manifests of one run are written first, and a commit makes them current, all or none."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ethogrid.operators.review import PROTECTED
from ethogrid.sources import commits, files

PARTS = ("frames", "segments", "detections")


class Store:
    """``folder`` holds part/run=<id> for each part and manifests/run=<id>, and the commits that name the runs that count.

    A subject's current run is that of its last committed manifest. A writer that dies between any two writes leaves files that no commit names: readers see what was there before, the next
    run does the subject again, and ``vacuum`` deletes the rest. Rows of a run are sorted by subject, so a read of a few subjects skips row groups; there is no folder a subject.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # reading ---------------------------------------------------------------------------------------

    def runs(self) -> list[tuple[int, dict]]:
        """Commits in order: {run, name, parts}. One a run, however many subjects it has."""
        return commits.entries(self.spark, self.folder)

    def _read(self, part: str, runs: list[str]) -> DataFrame:
        paths = [f"{self.folder}/{part}/run={r}" for r in runs]
        return self.spark.read.option("basePath", f"{self.folder}/{part}").option("mergeSchema", True).parquet(*paths).withColumn("run", F.col("run").cast("string"))

    def manifests(self) -> DataFrame | None:
        """The current manifest of each subject with its ``run`` and commit ``number``; None before the first commit."""
        found = self.runs()
        if not found:
            return None
        numbers = self.spark.createDataFrame([(c["run"], n) for n, c in found], "run string, number long")
        rows = self._read("manifests", [c["run"] for _, c in found]).join(F.broadcast(numbers), "run")  # a row a run
        last = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("number")))
        return rows.withColumn("__nth", last).where("__nth = 1").drop("__nth")

    def part(self, name: str) -> DataFrame | None:
        """Rows of ``frames``, ``segments`` or ``detections`` of each subject's current run; None if no current run wrote that part. A run without it leaves none behind from earlier runs."""
        m, live = self.manifests(), self._live()
        having = [c["run"] for _, c in self.runs() if name in c["parts"] and c["run"] in live]
        if not having:
            return None
        return self._read(name, having).join(m.select("video_id", "run"), ["video_id", "run"], "left_semi").drop("run")

    def _live(self) -> set[str]:
        """Runs that are some subject's current one: a row a run comes to the driver."""
        m = self.manifests()
        return set() if m is None else {r["run"] for r in m.select("run").distinct().collect()}

    def pending(self, catalog: DataFrame, force: bool = False) -> DataFrame:
        """Rows of ``catalog`` (video_id, ...) still to do: without a manifest, or all that no review protects with ``force``. So a run that was killed goes on where it was."""
        m = self.manifests()
        if m is None:
            return catalog
        done = m.where(F.col("review_status").isin(*PROTECTED)) if force else m
        return catalog.join(done.select("video_id"), "video_id", "left_anti")

    # writing ---------------------------------------------------------------------------------------

    def export(self, frames: DataFrame, segments: DataFrame, manifests: DataFrame, detections: DataFrame | None = None, name: str | None = None, force: bool = False, step: Callable[[str], None] = lambda s: None) -> int | None:
        """Writes the subjects of ``manifests`` (video_id, review_status, ...) and commits them; returns the commit's number, None if ``name`` was committed before.

        Subjects whose current review is protected are left out unless ``force``, in all parts. ``name`` makes a batch exactly-once: a repeat of it does nothing. ``step`` is
        told before each write (tests let it fail there). A conflict with another writer is met by numbering again: runs are independent, the later number wins a subject.
        """
        if name is not None and any(c["name"] == name for _, c in self.runs()):
            return None
        run = uuid.uuid4().hex
        current = None if force else self.manifests()
        if current is not None:
            kept = current.where(F.col("review_status").isin(*PROTECTED)).select("video_id")
            manifests = manifests.join(kept, "video_id", "left_anti")
        ids = manifests.select("video_id")
        parts = {"frames": frames, "segments": segments} | ({} if detections is None else {"detections": detections})
        for part, df in parts.items():
            step(part)
            order = ["video_id", *[c for c in ("frame_idx", "start_s") if c in df.columns][:1]]
            df.join(ids, "video_id", "left_semi").repartition("video_id").sortWithinPartitions(*order).write.parquet(f"{self.folder}/{part}/run={run}")
        step("manifests")
        manifests.write.parquet(f"{self.folder}/manifests/run={run}")
        step("commit")
        while True:
            try:
                return commits.append(self.spark, self.folder, commits.last_number(self.spark, self.folder), {"run": run, "name": name, "parts": sorted(parts)})
            except commits.Conflict:
                if name is not None and any(c["name"] == name for _, c in self.runs()):
                    return None

    def vacuum(self) -> list[str]:
        """Deletes folders of runs that no commit names and of committed ones that are no subject's current run; returns their paths. Not while a writer is at work."""
        live = self._live()
        named = {c["run"] for _, c in self.runs()}
        gone = []
        for part in (*PARTS, "manifests"):
            store, path = files._store(self.spark, f"{self.folder}/{part}")
            for s in store.listStatus(path) if store.exists(path) else []:
                run = s.getPath().getName().rpartition("run=")[2]
                if run not in live and not (part == "manifests" and run in named):  # a named manifest folder must stay readable
                    store.delete(s.getPath(), True)
                    gone.append(f"{part}/run={run}")
        return gone


def stream_export(store: Store, label: Callable[[DataFrame], tuple[DataFrame, DataFrame, DataFrame]]):
    """A function for ``foreachBatch``: labels a micro-batch of tracks (frames, segments, manifests) and exports it under its batch id, once however often the batch is retried."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            store.export(*label(batch), name=f"batch-{batch_id}")
        finally:
            batch.unpersist()

    return run
