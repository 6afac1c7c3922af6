"""A fitted model as a folder: states of its members, description, reference predictions, and checksums of all of it, written last."""

from __future__ import annotations

import json
import platform
from dataclasses import asdict, dataclass
from importlib import metadata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ethogrid.operators import models, training
from ethogrid.operators.networks import Settings
from ethogrid.sources import files

INFO = "info.json"
_STATES = "run int, model string, member int, classes array<string>, rows long, state binary"


def checksums(spark: SparkSession, folder: str) -> dict[str, str]:
    """SHA-256 of each data file below ``folder`` by its path there; a row a file comes to the driver, their bytes stay on executors."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.sha2("content", 256).alias("sha")).collect()
    mark = "/" + folder.rstrip("/").rpartition("/")[2] + "/"
    return {r["path"].rpartition(mark)[2]: r["sha"] for r in found if r["path"].rpartition(mark)[2] != INFO}


@dataclass(frozen=True)
class Loaded:
    """A model folder that was found whole."""

    folder: str
    info: dict
    states: DataFrame
    reference: DataFrame
    warnings: tuple[str, ...]

    def rows(self, table: DataFrame) -> DataFrame:
        """The model's inputs from a subject table; a missing column that it needs is refused by name. Label and date may be missing."""
        d = self.info["inputs"]
        missing = [c for c in ["video_id", *d["features"], *d["categories"]] if c not in table.columns]
        if missing:
            raise KeyError(f"the table lacks {', '.join(missing)}, which the model needs")
        for c, kind in (("label", "string"), ("date", "date")):
            table = table if c in table.columns else table.withColumn(c, F.lit(None).cast(kind))
        return training.as_rows(table, d["features"], d["categories"]).withColumn("run", F.lit(0))

    def predict(self, table: DataFrame) -> DataFrame:
        """(video_id, cls, p) by the saved preprocessing and states alone."""
        return training.scored(self.rows(table), self.states, ["run"]).select("video_id", "cls", "p")

    def gap(self, table: DataFrame) -> DataFrame:
        """(gap, shared): the largest difference from the reference predictions over the ids that ``table`` shares with them, which a sound copy reproduces (0)."""
        return models.compare_with_reference(self.predict(table), self.reference)


def save_model(table: DataFrame, folder: str, model: str, features: list[str], categories: list[str] = (), log: list[str] = (), settings: Settings | None = None, seed: int = 0, notes: dict | None = None) -> dict:
    """Fit ``model`` on all labelled rows of ``table`` (video_id, label, date, inputs) and write ``folder``, which must not exist yet; returns the info.

    States and reference predictions (those of its own training rows) are Parquet written by executors; the info file with the checksums comes last, so a folder
    without it is an unfinished save and can't be loaded. Expected quality is for cross-validation to tell, not for these predictions.
    """
    spark, settings = table.sparkSession, settings or Settings()
    store, path = files._store(spark, folder)
    if store.exists(path):
        raise FileExistsError(folder)
    rows = training.as_rows(table.where("label IS NOT NULL"), list(features), list(categories)).withColumn("run", F.lit(0))
    tasks = training.tasks_of(spark.range(1).select(F.lit(0).alias("run")), (model,), settings.members)
    training.fitted(rows, tasks, ["run"], [list(features).index(f) for f in log], settings, seed).write.parquet(f"{folder}/states")
    states = _states(spark, folder)
    training.scored(rows, states, ["run"]).select("video_id", "cls", "p").write.parquet(f"{folder}/reference")
    first = states.orderBy("member").select("classes", "rows").first()
    if first is None:
        raise ValueError("no labelled row to fit on")
    info = {
        "model": model, "classes": first["classes"], "rows": first["rows"], "seed": seed, "settings": asdict(settings), "notes": notes or {},
        "inputs": {"features": list(features), "categories": list(categories), "log": list(log)},
        "versions": {"python": platform.python_version(), **{p: metadata.version(p) for p in ("numpy", "pyspark")}}, "sha256": checksums(spark, folder),
    }
    text = json.dumps(info, indent=1, sort_keys=True)
    files.write_new(spark, f"{folder}/{INFO}", text)
    return json.loads(text)


def _states(spark: SparkSession, folder: str) -> DataFrame:
    states = spark.read.schema(_STATES).parquet(f"{folder}/states")
    states.written_path = f"{folder}/states"
    return states


def load_model(spark: SparkSession, folder: str) -> Loaded:
    """The model in ``folder``. FileNotFoundError without an info file; ValueError naming each file that changed, is missing or was added since it was saved.

    Checksums guard against damage and mixed-up files, not against someone who rewrites the whole folder. States are arrays: reading them runs no code.
    """
    info = json.loads(files.read(spark, f"{folder}/{INFO}"))
    now, saved = checksums(spark, folder), info["sha256"]
    wrong = sorted(p for p in now.keys() | saved.keys() if now.get(p) != saved.get(p))
    if wrong:
        raise ValueError(f"{folder} is not as it was saved: {', '.join(wrong)}")
    versions = {"python": platform.python_version(), **{p: metadata.version(p) for p in ("numpy", "pyspark")}}
    warnings = tuple(f"saved with {p} {v}, now {versions[p]}: predictions may differ slightly" for p, v in sorted(info["versions"].items()) if p in versions and versions[p] != v)
    return Loaded(folder, info, _states(spark, folder), spark.read.schema("video_id string, cls string, p double").parquet(f"{folder}/reference"), warnings)
