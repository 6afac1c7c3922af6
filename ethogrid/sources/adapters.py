"""Views that give the star-schema test tables the shape of tracks, subjects and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ethogrid.schemas import CONTROLLED, ERRATIC, FREEZING, SURFACE, UNDETERMINED


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tracks(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """One track for each user of ``events``; times are in hours. ``parts``: number of tasks over which subjects are dealt."""
    w = Window.partitionBy("video_id").orderBy("ts", "event_id")
    e = read(spark, sf_dir, "events").withColumn("video_id", F.concat(F.lit("F_"), F.lpad(F.col("user_id").cast("string"), 6, "0")))
    e = e if parts is None else e.repartition(parts, "video_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    seen = F.col("event_type") != "error"
    nth = F.row_number().over(w) - 1
    index = nth + F.floor(nth / 10)  # each eleventh index is missing
    b = e.select(
        "video_id", "event_id", "event_type", "value", F.get_json_object("props", "$.k").cast("double").alias("k"),
        index.cast("int").alias("frame_idx"), ((us - F.min(us).over(Window.partitionBy("video_id"))) / F.lit(3.6e9)).alias("t_sec"),
    )
    depth = F.col("k") * 2.4
    return b.select(
        "video_id", "frame_idx", "t_sec",
        F.when(seen, F.col("value")).otherwise(0.0).alias("x"), F.when(seen, depth).otherwise(0.0).alias("y"),
        F.when(~F.col("event_type").isin("error", "signup"), ((F.col("event_id") * 37) % 1800) / 10.0).alias("orientation_deg"),
        F.when(seen, depth).alias("y_from_frame_top"), seen.alias("detected"), "event_type", "event_id",
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks with a state and source taken from the event."""
    kind = F.col("event_type")
    state = (
        F.when(kind == "click", CONTROLLED).when(kind == "purchase", ERRATIC).when(kind == "view", FREEZING).when(kind == "signup", SURFACE).otherwise(UNDETERMINED)
    )
    source = F.when(F.col("event_id") % 5 == 0, "manual").otherwise("auto")
    return tracks(spark, sf_dir).withColumn("state", state).withColumn("source", source)


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each customer: labels and four features."""
    c = read(spark, sf_dir, "customer")
    o = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(
        F.count("*").alias("n"), F.avg("o_totalprice").alias("f_mean_price"), F.max("o_totalprice").alias("f_max_price")
    )
    dose = F.when(F.col("c_nationkey") % 3 == 0, "0.03").when(F.col("c_nationkey") % 3 == 1, "0.1").otherwise("1")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.concat(F.lit("F_"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("video_id"), F.col("c_mktsegment").alias("compound"),
        dose.alias("concentration_mM"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 12).cast("int")).alias("date"),
        F.when(F.col("c_nationkey") % 2 == 0, "F").otherwise("M").alias("sex"), (F.col("c_acctbal") > 0).alias("reviewed"),
        F.coalesce("n", F.lit(0)).cast("double").alias("f_orders"), "f_mean_price", "f_max_price", F.col("c_acctbal").alias("f_acctbal"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long predictions: ten classes for each embedding, softmax of its first ten components."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode(F.slice("embedding", 1, 10)).alias("cls", "logit"))
    w = Window.partitionBy("vec_id")
    power = F.exp(F.lit(20.0) * F.col("logit").cast("double"))
    return e.withColumn("p", power).withColumn("p", F.col("p") / F.sum("p").over(w)).select("vec_id", "label", "cls", "p")
