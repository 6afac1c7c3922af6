"""Small reports: flagged subjects, states shown, exceptions, answers scored, vehicle against the rest, set differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ethogrid.operators import evaluation


def flagged(table: DataFrame, flags: list[str], shown: list[str]) -> DataFrame:
    """Rows with any flag set, with the flags and the columns shown; a null flag is not set."""
    on = [F.coalesce(F.col(f), F.lit(False)).alias(f) for f in flags]
    some = on[0]
    for f in on[1:]:
        some = some | f
    return table.where(some).select(*shown, *on)


def states_shown(table: DataFrame, bouts: dict[str, str]) -> DataFrame:
    """(state, animals): animals with a bout of each state, from ``bouts`` (state: column of its bouts), in one pass."""
    one = table.agg(*[F.count_if(F.col(c) > 0).alias(s) for s, c in bouts.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(s).alias("state"), F.col(s).alias("animals")) for s in bouts])))


def exception_counts(exceptions: DataFrame) -> DataFrame:
    return exceptions.groupBy("kind").agg(F.count("*").alias("n"))


def answer_scores(rows: DataFrame, checks: list[str], by: str = "model") -> DataFrame:
    """Questions, those that pass each check, median and longest seconds of each model; a null check fails."""
    passed = [F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(c) for c in checks]
    return rows.groupBy(by).agg(F.count("*").alias("questions"), *passed, F.median("seconds").alias("median_s"), F.max("seconds").alias("slowest_s"))


def vehicle_scores(long: DataFrame, vehicle, by: str = "model", repeat: str = "repeat", ids: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """AUROC and balanced accuracy of vehicle against all other classes, mean and deviation over repeats.

    ``long``: by, repeat, ids, label, cls, p with one row a class. Repeats with one side only are left out; one repeat has deviation 0.
    """
    own = F.col("cls") == F.lit(vehicle)
    one = long.groupBy(by, repeat, *ids).agg(
        (F.first("label") == F.lit(vehicle)).alias("is_vehicle"), F.max(F.when(own, F.col("p"))).alias("p"), F.max_by("cls", F.struct("p", -F.col("cls"))).alias("predicted")
    )
    right = (F.col("predicted") == F.lit(vehicle)) == F.col("is_vehicle")
    sides = one.groupBy(by, repeat).agg(
        F.avg(F.when(F.col("is_vehicle"), right.cast("double"))).alias("a"), F.avg(F.when(~F.col("is_vehicle"), right.cast("double"))).alias("b")
    )
    balanced = sides.where("a is not null and b is not null").select(by, repeat, ((F.col("a") + F.col("b")) / 2).alias("balanced_accuracy"))
    area = evaluation.auroc(one.select(by, repeat, F.lit(1).alias("cls"), F.col("is_vehicle").cast("int").alias("label"), "p"), (by, repeat))
    scores = balanced.join(area.select(by, repeat, "auroc"), [by, repeat])
    return evaluation.summary(scores, [by], ["auroc", "balanced_accuracy"])


def symmetric_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side) of keys that one side has only, in one exchange for both sides; null keys take no part."""
    both = left.select(key, F.lit(1).alias("side")).union(right.select(key, F.lit(2).alias("side"))).where(F.col(key).isNotNull())
    got = both.groupBy(key).agg(F.min("side").alias("lo"), F.max("side").alias("hi")).where("lo = hi")
    return got.select(key, F.when(F.col("lo") == 1, "left").otherwise("right").alias("side"))


def first_seen(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of every key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")


def dose_rows(table: DataFrame, compound: str, vehicle: str) -> DataFrame:
    """Training rows of one compound's doses: its own rows, and the vehicle's as dose 0."""
    own = table.where(F.col("compound") == compound).withColumn("label", F.col("concentration_mM"))
    return own.unionByName(table.where(F.col("compound") == vehicle).withColumn("label", F.lit("0")))
