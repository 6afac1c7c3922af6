"""Data audit over the subject table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def compounds(table: DataFrame) -> DataFrame:
    return table.groupBy("compound").agg(
        F.count("*").alias("animals"), F.sum(F.col("reviewed").cast("long")).alias("accepted"), F.count_distinct("date").alias("dates"),
        F.array_join(F.array_sort(F.collect_set("concentration_mM")), ", ").alias("doses"),
    )


def dates(table: DataFrame) -> DataFrame:
    return table.groupBy("date").agg(
        F.count("*").alias("animals"), F.count_distinct("compound").alias("compounds"), F.avg((F.col("sex") == "F").cast("double")).alias("female_share"),
        F.array_join(F.array_sort(F.collect_set("compound")), ", ").alias("names"),
    )


def compound_by_date(table: DataFrame, values: list[str]) -> DataFrame:
    """Counts of compounds (columns, given) by date; one aggregate, no pass to find the columns."""
    return table.groupBy("date").pivot("compound", values).count().na.fill(0)


def missing(table: DataFrame, columns: list[str]) -> DataFrame:
    """(column, missing) of columns with null or NaN, in one pass."""
    one = table.agg(*[F.count_if(F.col(c).isNull() | (F.isnan(c) if dict(table.dtypes)[c] in ("double", "float") else F.lit(False))).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in columns])
    return one.select(F.inline(rows)).where("missing > 0")


def stop_rule(table: DataFrame, least: int, least_dates: int = 2, least_groups: int = 3) -> DataFrame:
    """Groups (compound, dose) with enough animals on enough dates, and whether there are enough of them."""
    ok = table.groupBy("compound", "concentration_mM").agg(F.count("*").alias("animals"), F.count_distinct("date").alias("dates"))
    ok = ok.where((F.col("animals") >= least) & (F.col("dates") >= least_dates))
    return ok.agg(F.count("*").alias("groups"), (F.count("*") >= least_groups).alias("go"))


def facts(table: DataFrame) -> DataFrame:
    """Headline numbers in one row."""
    pairs = table.groupBy("compound", "date").agg(F.count_distinct("concentration_mM").alias("doses"))
    single = table.groupBy("compound").agg(F.count_distinct("date").alias("n")).agg(F.count_if(F.col("n") == 1).alias("single_date_compounds"))
    multi = pairs.agg(F.count_if(F.col("doses") >= 2).alias("compound_dates_with_doses"), F.count("*").alias("compound_dates"))
    one = table.agg(
        F.count("*").alias("animals"), F.count_distinct("compound").alias("compounds"), F.count_distinct("date").alias("dates"),
        F.sum(F.col("reviewed").cast("long")).alias("accepted"), (F.count("*") / F.count_distinct("date")).alias("animals_per_date"),
        F.count_if(F.col("f_mean_price").isNull()).alias("without_feature"),
    )
    return one.crossJoin(single).crossJoin(multi)


def framing(table: DataFrame, low: str, high: str) -> DataFrame:
    """Median extent by date, and whether it leaves the median of dates by more than a tenth of the median height."""
    by = table.groupBy("date").agg(F.median(low).alias("lo"), F.median(high).alias("hi"))
    mid = by.agg(F.median("lo").alias("lo0"), F.median("hi").alias("hi0"), (F.median(F.col("hi") - F.col("lo")) * 0.1).alias("tolerance"))
    off = (F.abs(F.col("lo") - F.col("lo0")) > F.col("tolerance")) | (F.abs(F.col("hi") - F.col("hi0")) > F.col("tolerance"))
    return by.join(F.broadcast(mid)).select("date", "lo", "hi", "tolerance", off.alias("moved"))


def setups(framing_rows: DataFrame, tolerance: float) -> list[tuple]:
    """(date, setup) by single linkage of (lo, hi) within ``tolerance`` on both; setups are numbered in date order.

    A row is a recording date, so the few hundred are linked on the driver.
    """
    rows = sorted((r["date"], r["lo"], r["hi"]) for r in framing_rows.select("date", "lo", "hi").collect())
    parent = list(range(len(rows)))

    def find(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a, b) in enumerate(rows):
        for j in range(i):
            if abs(a - rows[j][1]) <= tolerance and abs(b - rows[j][2]) <= tolerance:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    number: dict[int, int] = {}
    return [(d, number.setdefault(find(i), len(number) + 1)) for i, (d, _, _) in enumerate(rows)]


def filter_classes(table: DataFrame, least: int, by_dose: bool = False) -> DataFrame:
    """Rows of classes with ``least`` animals or more; by dose, compounds left with one dose go too."""
    keys = ["compound", "concentration_mM"] if by_dose else ["compound"]
    size = F.count("*").over(Window.partitionBy(*keys))
    out = table.withColumn("__n", size).where(F.col("__n") >= least).drop("__n")
    if not by_dose:
        return out
    w = Window.partitionBy("compound")
    return out.withColumn("__d", F.size(F.collect_set("concentration_mM").over(w))).where("__d > 1").drop("__d")


def useless_features(table: DataFrame, features: list[str]) -> DataFrame:
    """(feature, reason) of features without values or with one value only, in one pass."""
    aggs = []
    for f in features:
        aggs += [F.count(F.when(~F.isnan(f), F.col(f))).alias(f"{f}__n"), F.count_distinct(F.when(~F.isnan(f), F.col(f))).alias(f"{f}__d")]
    one = table.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.when(F.col(f"{f}__n") == 0, "missing").when(F.col(f"{f}__d") == 1, "constant").alias("reason")) for f in features])
    return one.select(F.inline(rows)).where("reason is not null")


def fit_preprocess(table: DataFrame, features: list[str], log: list[str] = ()) -> DataFrame:
    """(feature, fill, mean, sd): median fill, then mean and population deviation (0 as 1) of the filled, log1p'd values."""
    from ethogrid.operators.stats import unpivot

    long = unpivot(table, [], features)
    fill = long.groupBy("feature").agg(F.coalesce(F.median("value"), F.lit(0.0)).alias("fill"))
    v = F.coalesce(F.col("value"), F.col("fill"))
    v = F.when(F.col("feature").isin(*log), F.log1p(v)).otherwise(v) if log else v
    got = long.join(F.broadcast(fill), "feature").withColumn("v", v)
    sd = F.stddev_pop("v")
    return got.groupBy("feature", "fill").agg(F.avg("v").alias("mean"), F.when(sd > 0, sd).otherwise(1.0).alias("sd"))


def preprocess(table: DataFrame, keys: list[str], features: list[str], fitted: DataFrame, log: list[str] = ()) -> DataFrame:
    """(keys, feature, z): filled, log1p'd and standardised values in long form."""
    from ethogrid.operators.stats import unpivot

    v = F.coalesce(F.col("value"), F.col("fill"))
    v = F.when(F.col("feature").isin(*log), F.log1p(v)).otherwise(v) if log else v
    return unpivot(table, keys, features).join(F.broadcast(fitted), "feature").select(*keys, "feature", ((v - F.col("mean")) / F.col("sd")).alias("z"))


def one_hot(table: DataFrame, column: str, values: list[str]) -> DataFrame:
    """0/1 columns for the values seen in fitting; an unseen value has all 0."""
    return table.select("*", *[(F.coalesce(F.col(column) == v, F.lit(False))).cast("int").alias(f"{column}={v}") for v in values])


def vehicle_normalise(table: DataFrame, feature: str, vehicle: str, starts: list[str], least: int = 2) -> DataFrame:
    """``feature`` minus the vehicle median of its date (``least`` values or more), else of its epoch, else of all."""
    from ethogrid.functions.scalars import epoch_of

    rows = table.withColumn("epoch", epoch_of(F.col("date"), starts))
    v = rows.where((F.col("compound") == vehicle) & F.col(feature).isNotNull())
    own = v.groupBy("date").agg(F.median(feature).alias("m1"), F.count("*").alias("n1"))
    epoch = v.groupBy("epoch").agg(F.median(feature).alias("m2"), F.count("*").alias("n2"))
    whole = v.agg(F.median(feature).alias("m3"))
    out = rows.join(F.broadcast(own), "date", "left").join(F.broadcast(epoch), "epoch", "left").join(F.broadcast(whole))
    base = F.coalesce(F.when(F.col("n1") >= least, F.col("m1")), F.when(F.col("n2") >= least, F.col("m2")), F.col("m3"))
    return out.withColumn("baseline", base).withColumn("normalised", F.col(feature) - base).drop("m1", "n1", "m2", "n2", "m3")
