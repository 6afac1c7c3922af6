"""Command line: ``python -m ethogrid.cli process | featurize | train | ablate | predict``. Each command is one Spark application over folders in any store."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ethogrid.operators import artifact, features, folds, kinematics, labeling, studies, training
from ethogrid.operators.networks import Settings
from ethogrid.sources import files, track_files, writers
from ethogrid.sources.store import Store
from ethogrid.sources.tables import written

THRESHOLDS = {"lag_s": 1.0, "freeze_floor": 3.0, "min_freeze_s": 1.0, "erratic": 30.0, "surface_depth": 0.0, "min_dead_s": 60.0, "bin_s": 1.0, "min_determined": 0.5}


def labelled(tracks: DataFrame, t: dict) -> DataFrame:
    """Frames with state and source of a track table under the thresholds ``t``."""
    speed = kinematics.smoothed_speed(tracks, t["lag_s"])
    states = labeling.classify(speed, t["freeze_floor"], t["min_freeze_s"], t["erratic"], t["surface_depth"], t["min_dead_s"])
    return labeling.consolidate(states, t["bin_s"], t["min_determined"]).drop("bin").withColumn("source", F.lit("auto"))


def process(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Labels the subjects of a folder of track files that the store lacks (``--force``: all that no review protects), at most ``--limit`` in the order of their ids, and commits them."""
    given = json.loads(files.read(spark, a.thresholds)) if a.thresholds else {}
    if unknown := given.keys() - THRESHOLDS.keys():
        raise SystemExit(f"unknown thresholds: {', '.join(sorted(unknown))}")
    store, tracks = Store(spark, a.store), track_files.read(spark, a.tracks)
    todo = store.pending(tracks.select("video_id").distinct(), a.force)
    todo = written(todo.orderBy("video_id").limit(a.limit) if a.limit is not None else todo, "todo")
    n = todo.count()
    if n:
        frames = written(labelled(tracks.join(todo, "video_id", "left_semi"), THRESHOLDS | given), "frames")
        manifests = frames.groupBy("video_id").agg(F.count("*").alias("frames"), F.max("t_sec").alias("last_s")).withColumn("review_status", F.lit("AUTO"))
        store.export(frames, labeling.segments(frames).drop("segment"), manifests, force=a.force)
    return {"processed": n}


def featurize(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Training table: a row for each subject of the store that the catalog (video_id, compound, concentration_mM, date, ...) names, with features of its segments."""
    segs, catalog = Store(spark, a.store).part("segments"), spark.read.parquet(a.catalog)
    if segs is None:
        raise SystemExit(f"{a.store} has no committed run")
    order = F.row_number().over(Window.partitionBy("video_id").orderBy("start_s"))
    table = features.segment_features(segs.withColumn("segment", order)).join(catalog, "video_id")
    names = [c for c in table.columns if c not in catalog.columns]
    writers.write_table(table, a.out, {"features": names})
    return {"rows": spark.read.parquet(f"{a.out}/training_table.parquet").count(), "features": len(names)}


def _table(spark: SparkSession, folder: str, label: str) -> tuple[DataFrame, list[str]]:
    described = json.loads(files.read(spark, f"{folder}/schema.json"))
    return spark.read.parquet(f"{folder}/training_table.parquet").withColumn("label", F.col(label)), described["features"]


def _settings(a: argparse.Namespace) -> Settings:
    return Settings(members=a.members, epochs=a.epochs)


def train(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Cross-validates the models (tables ``predictions`` and ``scores`` below the run folder) and saves the first one, fitted on all rows, as ``model``."""
    table, names = _table(spark, a.table, a.label)
    placed = folds.folds(table, a.folds, a.repeats, a.seed)
    long = training.cross_fit(training.as_rows(table, names), placed, models=tuple(dict.fromkeys(["majority", "date_only", *a.models])), settings=_settings(a), seed=a.seed)
    long.write.parquet(f"{a.out}/predictions")
    training.scores(spark.read.parquet(f"{a.out}/predictions"), ["model", "scheme", "repeat"]).write.parquet(f"{a.out}/scores")
    info = artifact.save_model(table, f"{a.out}/model", a.models[0], names, settings=_settings(a), seed=a.seed)
    return {"model": info["model"], "classes": len(info["classes"]), "rows": info["rows"]}


def ablate(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Scores with each named group of features left out (``--groups`` file: {name: [features]}), and without the vehicle, raw and normalised: table ``ablations``."""
    table, names = _table(spark, a.table, a.label)
    groups = json.loads(files.read(spark, a.groups))
    got = studies.run_ablations(table, names, [], groups, dict.fromkeys(groups, True), a.vehicle, models=tuple(a.models), k=a.folds, repeats=a.repeats, settings=_settings(a), seed=a.seed)
    got.write.parquet(f"{a.out}/ablations")
    return {"rows": spark.read.parquet(f"{a.out}/ablations").count()}


def predict(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Applies a saved model to a training table or any table with its columns: (video_id, cls, p)."""
    found = artifact.load_model(spark, f"{a.run}/model")
    for w in found.warnings:
        print(w, file=sys.stderr)
    path = f"{a.table}/training_table.parquet"
    store, p = files._store(spark, path)
    found.predict(spark.read.parquet(path if store.exists(p) else a.table)).write.parquet(a.out)
    return {"rows": spark.read.parquet(a.out).count()}


def _positive(text: str) -> int:
    n = int(text)
    if n < 1:
        raise argparse.ArgumentTypeError(f"{n} is not positive")
    return n


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="ethogrid", description=__doc__)
    sub = top.add_subparsers(required=True)

    def command(f, *names: str) -> argparse.ArgumentParser:
        p = sub.add_parser(f.__name__, help=f.__doc__)
        p.set_defaults(run_command=f)
        for n in names:
            p.add_argument(f"--{n}", required=True)
        return p

    p = command(process, "tracks", "store")
    p.add_argument("--limit", type=_positive)
    p.add_argument("--force", action="store_true")
    p.add_argument("--thresholds")
    command(featurize, "store", "catalog", "out")
    for f, names in ((train, ("table", "out")), (ablate, ("table", "out", "groups", "vehicle"))):
        p = command(f, *names)
        p.add_argument("--label", default="compound")
        p.add_argument("--models", nargs="+", default=["network"], choices=training.MODELS)
        p.add_argument("--folds", type=_positive, default=5)
        p.add_argument("--repeats", type=_positive, default=2)
        p.add_argument("--seed", type=int, default=0)
        p.add_argument("--members", type=_positive, default=5)
        p.add_argument("--epochs", type=_positive, default=300)
    command(predict, "run", "table", "out")
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("ethogrid").getOrCreate()
    said = a.run_command(spark, a)
    print(json.dumps(said))
    return said


if __name__ == "__main__":
    main()
