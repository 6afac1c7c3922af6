"""Writers: frames by subject, segments, catalog, training table, run folder, annotations, reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ethogrid.operators.review import PROTECTED
from ethogrid.schemas import FRAMES
from ethogrid.sources import files


def typed_frames(df: DataFrame) -> DataFrame:
    """Frames in their stored types: 32-bit numbers and text."""
    return df.select("video_id", *[F.col(f.name).cast(f.dataType).alias(f.name) for f in FRAMES.fields])


def export_frames(df: DataFrame, manifests: DataFrame, folder: str) -> DataFrame:
    """Writes the subjects of ``df`` that no review protects, each over its own folder only; returns the ids left alone.

    One exchange by subject, so a subject is one file, and folders of other subjects stay as they are.
    """
    protected = manifests.where(F.col("review_status").isin(*PROTECTED)).select("video_id")
    free = df.join(F.broadcast(protected), "video_id", "left_anti")
    out = typed_frames(free).repartition("video_id").sortWithinPartitions("video_id", "frame_idx")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("video_id").parquet(folder)
    return df.select("video_id").distinct().join(protected, "video_id", "left_semi")


def write_segments(segs: DataFrame, folder: str) -> None:
    segs.write.mode("overwrite").option("header", True).partitionBy("video_id").csv(folder)


def write_table(table: DataFrame, folder: str, described: dict) -> None:
    """The training table, then its column description beside it, in any store that Spark writes to."""
    table.write.mode("overwrite").parquet(f"{folder}/training_table.parquet")
    files.replace(table.sparkSession, f"{folder}/schema.json", json.dumps({"format": 1} | described, indent=1, sort_keys=True))


def tagged(tables: dict[str, DataFrame], tag: str = "stage") -> DataFrame:
    """Union of tables with a first column that tells them apart; columns that one lacks are null."""
    out = None
    for name, df in tables.items():
        one = df.withColumn(tag, F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out.select(tag, *[c for c in out.columns if c != tag])


def write_run(folder: str, tables: dict[str, DataFrame]) -> None:
    """CSV tables of a run, one folder each."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def create_profile(spark: SparkSession, path: str, content: dict) -> None:
    """A calibration profile, which is written once and never changed."""
    files.write_new(spark, path, json.dumps(content, indent=1, sort_keys=True))


def coco(annotations: DataFrame, keypoints: list[str], split: str) -> DataFrame:
    """(images, annotations): JSON arrays' elements as rows of text by ``kind``, ids in order of image name.

    ``annotations``: image, split, width, height, video_id, frame_idx, visible, box array<double>, points map<string,struct<x,y,v>>.
    The ids come from one window over the split's annotated frames, which people made by hand.
    """
    w = Window.orderBy("image")
    rows = annotations.where(F.col("split") == split).withColumn("image_id", F.row_number().over(w))
    images = rows.select(
        F.lit("image").alias("kind"), F.col("image_id").alias("id"),
        F.to_json(F.struct(F.col("image_id").alias("id"), F.col("image").alias("file_name"), "width", "height", "video_id", "frame_idx")).alias("json"),
    )
    seen = rows.where("visible and box is not null").withColumn("id", F.row_number().over(w))
    b = F.col("box")
    flat = F.flatten(F.array(*[F.array(*[F.coalesce(F.col("points")[k][c].cast("double"), F.lit(0.0)) for c in "xyv"]) for k in keypoints]))
    entry = F.struct(
        "id", "image_id", F.lit(1).alias("category_id"), F.lit(0).alias("iscrowd"), F.array(b[0], b[1], b[2] - b[0], b[3] - b[1]).alias("bbox"),
        ((b[2] - b[0]) * (b[3] - b[1])).alias("area"), flat.alias("keypoints"), F.size("points").alias("num_keypoints"),
    )
    return images.unionByName(seen.select(F.lit("annotation").alias("kind"), "id", F.to_json(entry).alias("json")))


def strip_geometry(segs: DataFrame, x0: int, x1: int) -> DataFrame:
    """Pixel range of each segment on a strip from x0 to x1."""
    whole = F.max("end_s").over(Window.partitionBy("video_id"))

    def x(c: str):
        return (x0 + F.bround(F.col(c) / whole * (x1 - x0))).cast("int")

    return segs.select("video_id", "state", x("start_s").alias("x_from"), x("end_s").alias("x_to"))


def markdown(rows: list[dict], columns: list[str]) -> str:
    """A small table as markdown."""
    line = lambda cells: "| " + " | ".join(str(c) for c in cells) + " |"
    return "\n".join([line(columns), line(["---"] * len(columns)), *[line([r.get(c, "") for c in columns]) for r in rows]])


def model_checksum(spark: SparkSession, path: str) -> str:
    """SHA-256 over the files of a saved model, in path order."""
    import hashlib

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.sha2("content", 256).alias("s"))
    rows = sorted((r["path"].rpartition(path.rpartition("/")[2])[2], r["s"]) for r in files.collect())
    return hashlib.sha256("\n".join(f"{p}:{s}" for p, s in rows if not p.endswith(".crc")).encode()).hexdigest()
