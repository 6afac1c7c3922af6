"""Group comparison: descriptive statistics, Hedges' g, Mann-Whitney U, false discovery rate, percentiles."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


EXACT_SIDE = 8  # values of the smaller side up to which p is exact
EXACT_U = 2_500  # steps of U up to which it is


def unpivot(table: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """(keys, feature, value) with NaN as null; one pass for all features."""
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    out = table.select(*keys, F.inline(rows))
    return out.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def describe(rows: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    v = F.col(value)
    return rows.groupBy(*by).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.median(v).alias("median"),
        F.percentile(v, F.lit(0.25)).alias("q1"), F.percentile(v, F.lit(0.75)).alias("q3"), F.min(v).alias("min"), F.max(v).alias("max"),
    )


def average_ranks(rows: DataFrame, by: list[str], value: str = "value", name: str = "avg_rank") -> DataFrame:
    """Rank of each value with ties sharing their mean rank."""
    place = F.rank().over(Window.partitionBy(*by).orderBy(value))
    ties = F.count("*").over(Window.partitionBy(*by, value))
    return rows.withColumn(name, place + (ties - 1) / 2.0)


def value_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts of each value by side; the ranks of all rows follow from them, so a feature with few values stays small."""
    return rows.groupBy(*by, "value").agg(F.count_if("is_group").alias("a"), F.count_if(~F.col("is_group")).alias("b"))


def effects(rows: DataFrame, by: list[str]) -> DataFrame:
    """Hedges' g (group minus control, small-sample corrected) and the two-sided Mann-Whitney p of ``rows`` (by, is_group, value).

    p is exact where the smaller side has at most ``EXACT_SIDE`` values, no two values are equal and U has at most ``EXACT_U`` steps; else the normal approximation with tie and
    continuity correction (``p_method``). Sides with fewer than two values, or one value only on both, drop out.
    """
    v = F.col("value")
    g, c = F.col("is_group"), ~F.col("is_group")
    moments = rows.where("value is not null").groupBy(*by).agg(
        F.count_if(g).alias("n1"), F.count_if(c).alias("n2"), F.avg(F.when(g, v)).alias("m1"), F.avg(F.when(c, v)).alias("m2"),
        F.var_samp(F.when(g, v)).alias("v1"), F.var_samp(F.when(c, v)).alias("v2"),
    ).where("n1 >= 2 and n2 >= 2")
    counts = value_counts(rows.where("value is not null"), by)
    w = Window.partitionBy(*by).orderBy("value")
    size = F.col("a") + F.col("b")
    below = F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = counts.withColumn("rank", below + (size + 1) / 2.0).groupBy(*by).agg(
        F.sum(F.col("a") * F.col("rank")).alias("r1"), F.sum(size * size * size - size).alias("ties"), F.count("*").alias("values")
    ).where("values > 1")
    out = moments.join(ranked, by) if by else moments.crossJoin(ranked)
    n = F.col("n1") + F.col("n2")
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (n - 2))
    g_ = (F.col("m1") - F.col("m2")) / F.nullif(pooled, F.lit(0.0)) * (1 - 3.0 / (4.0 * n - 9))
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2.0
    mid = F.col("n1") * F.col("n2") / 2.0
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12.0 * ((n + 1) - F.col("ties") / (n * (n - 1.0))))
    z = (F.greatest(u, 2 * mid - u) - mid - 0.5) / F.nullif(sd, F.lit(0.0))
    out = out.select(*by, "n1", "n2", F.col("m1").alias("group_mean"), F.col("m2").alias("control_mean"), F.coalesce(g_, F.lit(0.0)).alias("hedges_g"), u.alias("u"), z.alias("z"), F.col("ties"))
    exact = (F.least("n1", "n2") <= EXACT_SIDE) & (F.col("n1") * F.col("n2") <= EXACT_U) & (F.col("ties") == 0)
    out = out.withColumn("__m", F.when(exact, F.least("n1", "n2"))).withColumn("__n", F.when(exact, F.greatest("n1", "n2")))
    tables = out.where("__m IS NOT NULL").select("__m", "__n").distinct().withColumn("__orders", u_orders(F.col("__m"), F.col("__n")))
    out = out.join(tables, ["__m", "__n"], "left")
    p = F.when(F.col("__m").isNotNull(), exact_tail2(F.col("u"), F.col("__orders"))).otherwise(normal_tail2(F.col("z")))
    return out.select(*by, "n1", "n2", "group_mean", "control_mean", "hedges_g", "u", "z", p.alias("p_value"), F.when(F.col("__m").isNotNull(), "exact").otherwise("normal").alias("p_method"))


def u_orders(m, n):
    """How many orders of m and n values without ties have each U from 0 to m n, as an array.

    The counts are the coefficients of the product over i from 1 to m of (1 - q^(n + i)) / (1 - q^i): each factor shifts and subtracts, then sums up in steps of i. Counts are
    doubles, whole up to 2^53 and as good as that beyond. Meant for a small m; one array for each pair of sizes, not for each comparison.
    """
    first = F.transform(F.sequence(F.lit(0), (m * n).cast("int")), lambda j: F.when(j == 0, 1.0).otherwise(0.0))

    def factor(a, i):
        cut = F.transform(a, lambda x, j: x - F.coalesce(F.get(a, (j - n - i).cast("int")), F.lit(0.0)))
        return F.aggregate(cut, F.array().cast("array<double>"), lambda out, x: F.array_append(out, x + F.coalesce(F.get(out, (F.size(out) - i).cast("int")), F.lit(0.0))))

    return F.aggregate(F.sequence(F.lit(1), m.cast("int")), first, factor)


def exact_tail2(u, orders):
    """Two-sided p of U from its counts: twice the share of orders with a U as high, at most 1."""
    top = F.size(orders) - 1
    high = F.ceil(F.greatest(u, top - u)).cast("int")
    whole = F.aggregate(orders, F.lit(0.0), lambda a, x: a + x)
    tail = F.aggregate(F.slice(orders, high + 1, F.size(orders)), F.lit(0.0), lambda a, x: a + x)
    return F.least(F.lit(1.0), 2.0 * tail / whole)


# Coefficients of the published Chebyshev fit of erfc.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def normal_tail2(z):
    """Two-sided tail of the normal distribution, at most 1: the rational approximation with a relative error below 1.2e-7."""
    x = F.abs(z) / math.sqrt(2)
    t = 1.0 / (1.0 + 0.5 * x)
    poly = F.lit(ERFC[-1])
    for k in reversed(ERFC[:-1]):
        poly = F.lit(k) + t * poly
    e = t * F.exp(-x * x + poly)
    return F.least(F.when(z < 0, 2.0 - e).otherwise(e), F.lit(1.0))


def benjamini_hochberg(rows: DataFrame, by: list[str], p: str = "p_value", tie: str = "feature") -> DataFrame:
    """Adds ``q_value``: the step-up adjusted p over the rows of each group."""
    up = Window.partitionBy(*by).orderBy(p, tie)
    m = F.count("*").over(Window.partitionBy(*by))
    out = rows.withColumn("__raw", F.col(p) * m / F.row_number().over(up))
    down = Window.partitionBy(*by).orderBy(F.desc(p), F.desc(tie)).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("q_value", F.least(F.min("__raw").over(down), F.lit(1.0))).drop("__raw")


def control_rows(table: DataFrame, compound: str, vehicle: str, dose: str | None = None, least: int = 3, same_date: bool = True) -> DataFrame:
    """Rows of the group and of its control with ``is_group``: vehicle rows of the group's dates, or all of them if fewer than ``least`` or not ``same_date``.

    The choice is made in the plan: the number of same-date controls is one row that is joined to both candidates.
    """
    group = table.where(F.col("compound") == compound)
    if dose is not None:
        group = group.where(F.col("concentration_mM") == dose)
    every = table.where(F.col("compound") == vehicle)
    if not same_date:
        return group.withColumn("is_group", F.lit(True)).unionByName(every.select(group.columns).withColumn("is_group", F.lit(False)))
    dated = every.join(group.select("date").distinct().withColumn("same", F.lit(True)), "date", "left")
    count = dated.agg((F.count_if("same") >= least).alias("enough"))
    chosen = dated.join(F.broadcast(count)).where(F.when(F.col("enough"), F.coalesce("same", F.lit(False))).otherwise(True)).drop("same", "enough")
    return group.withColumn("is_group", F.lit(True)).unionByName(chosen.select(group.columns).withColumn("is_group", F.lit(False)))


def percentile_of_score(rows: DataFrame, by: list[str], score: str = "score", value: str = "value") -> DataFrame:
    """Share in percent of values below ``score``, values equal to it counting half."""
    v, s = F.col(value), F.col(score)
    return rows.where(v.isNotNull()).groupBy(*by).agg(((F.count_if(v < s) + F.count_if(v <= s)) / 2.0 / F.count(v) * 100).alias("percentile"))
