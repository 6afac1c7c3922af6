"""Scores of long predictions (vec_id, label, cls, p)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16  # log-loss clips probabilities to [EPS, 1 - EPS]


def predicted(long: DataFrame, keys: tuple = ("vec_id",)) -> DataFrame:
    """One row an example: label, predicted (largest p, lowest class of equals), p of the label, rank of the label."""
    top = F.max(F.struct(F.col("p"), (-F.col("cls")).alias("c")))
    true_p = F.max(F.when(F.col("cls") == F.col("label"), F.col("p")))
    got = long.groupBy(*keys, "label").agg(top.alias("top"), true_p.alias("p_true"), F.sort_array(F.collect_list(F.struct((-F.col("p")).alias("np"), "cls"))).alias("ranked"))
    rank = F.array_position(F.transform("ranked", lambda r: r["cls"].cast("int")), F.col("label").cast("int"))
    return got.select(*keys, "label", (-F.col("top.c")).cast("int").alias("predicted"), "p_true", rank.alias("label_rank"))


def confusion(pred: DataFrame) -> DataFrame:
    return pred.groupBy("label", "predicted").agg(F.count("*").alias("n"))


def top_confusions(pred: DataFrame, n: int = 10) -> DataFrame:
    return confusion(pred).where("label <> predicted").orderBy(F.desc("n"), "label", "predicted").limit(n)


def per_class(pred: DataFrame, by: tuple = ()) -> DataFrame:
    """Precision, recall, F1 and support of each label or predicted class; an empty denominator gives 0."""
    sides = pred.select(*by, F.col("label").alias("cls"), F.lit(1).alias("s"), F.lit(0).alias("q"), (F.col("label") == F.col("predicted")).cast("int").alias("tp"))
    sides = sides.unionByName(pred.select(*by, F.col("predicted").alias("cls"), F.lit(0).alias("s"), F.lit(1).alias("q"), F.lit(0).alias("tp")))
    got = sides.groupBy(*by, "cls").agg(F.sum("s").alias("support"), F.sum("q").alias("q"), F.sum("tp").alias("tp"))
    pr, rc = F.coalesce(F.try_divide("tp", "q"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("q") + F.col("support")), F.lit(0.0))
    return got.select(*by, "cls", pr.alias("precision"), rc.alias("recall"), f1.alias("f1"), "support")


def metrics(pred: DataFrame, by: tuple = ()) -> DataFrame:
    """Balanced accuracy (over labels that occur), macro F1, log-loss and top-3 accuracy."""
    return tally_metrics(tally(pred, by), by)


def tally(pred: DataFrame, by: tuple = ()) -> DataFrame:
    """(by, label, predicted, n, loss, ranked, top): counts and sums of the rows of each pair of classes, from which :func:`tally_metrics` tells the scores. Rows are read once and not shuffled; losses are
    summed as decimals, so that their order does not matter."""
    p = F.least(F.greatest("p_true", F.lit(EPS)), F.lit(1 - EPS))
    sums = [F.count("*").alias("n"), F.sum((-F.ln(p)).cast("decimal(16,12)")).alias("loss"), F.count("label_rank").alias("ranked"), F.count_if(F.col("label_rank") <= 3).alias("top")]
    return pred.groupBy(*by, "label", "predicted").agg(*sums)


def tally_metrics(sums: DataFrame, by: tuple = ()) -> DataFrame:
    """:func:`metrics` of the rows that :func:`tally` counted."""
    right = F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)
    side = lambda cls, s, q, tp: F.struct(F.col(cls).alias("cls"), s.alias("s"), q.alias("q"), tp.alias("tp"))
    sides = sums.select(*by, F.inline(F.array(side("label", F.col("n"), F.lit(0).cast("long"), right.cast("long")), side("predicted", F.lit(0).cast("long"), F.col("n"), F.lit(0).cast("long")))))
    got = sides.groupBy(*by, "cls").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("tp").alias("tp"))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("q") + F.col("s")), F.lit(0.0))
    scores = got.groupBy(*by).agg(F.avg(F.when(F.col("s") > 0, F.col("tp") / F.nullif(F.col("s"), F.lit(0)))).alias("balanced_accuracy"), F.avg(f1).alias("macro_f1"))
    rest = sums.groupBy(*by).agg((F.sum("loss").cast("double") / F.sum("n")).alias("log_loss"), F.try_divide(F.sum("top"), F.sum("ranked")).alias("top3"), F.sum("n").alias("n"))
    return scores.join(rest, list(by)) if by else scores.crossJoin(rest)


def summary(scores: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """Mean and sample deviation over repeats (0 for one repeat)."""
    return scores.groupBy(*by).agg(*[x for n in names for x in (F.avg(n).alias(f"{n}_mean"), F.coalesce(F.stddev_samp(n), F.lit(0.0)).alias(f"{n}_sd"))])


def auroc(long: DataFrame, by: tuple = ()) -> DataFrame:
    """One-vs-rest AUROC of each class by the rank sum with average ranks; classes with one side only drop out."""
    rows = long.groupBy(*by, "cls", "p").agg(F.count_if(F.col("label") == F.col("cls")).alias("a"), F.count("*").alias("n"))
    w = Window.partitionBy(*by, "cls").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumn("rank", F.coalesce(F.sum("n").over(w), F.lit(0)) + (F.col("n") + 1) / 2.0)
    got = ranked.groupBy(*by, "cls").agg(F.sum("a").alias("n1"), F.sum("n").alias("n"), F.sum(F.col("a") * F.col("rank")).alias("r1"))
    got = got.where((F.col("n1") > 0) & (F.col("n1") < F.col("n")))
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2.0
    return got.select(*by, "cls", (u / (F.col("n1") * (F.col("n") - F.col("n1")))).alias("auroc"))


def date_effect(pred: DataFrame) -> DataFrame:
    """Mean over repeats of balanced accuracy in scheme B, on examples that scheme A scored, minus that in scheme A.

    ``pred``: scheme, repeat and the columns of :func:`predicted`.
    """
    a = pred.where("scheme = 'A'")
    b = pred.where("scheme = 'B'").join(a.select("vec_id").distinct(), "vec_id", "left_semi").select(a.columns)
    ba = metrics(a.unionByName(b), ("scheme", "repeat")).select("scheme", "repeat", "balanced_accuracy")
    two = ba.groupBy("repeat").agg(
        F.max(F.when(F.col("scheme") == "A", F.col("balanced_accuracy"))).alias("a"), F.max(F.when(F.col("scheme") == "B", F.col("balanced_accuracy"))).alias("b")
    )
    return two.agg(F.avg(F.col("b") - F.col("a")).alias("date_effect"), F.count("*").alias("repeats"))


def best_model(scores: DataFrame, model: str = "model", score: str = "score", order: str = "nth") -> DataFrame:
    """The model with the best score, the first of equals."""
    return scores.agg(F.max_by(model, F.struct(F.col(score), -F.col(order))).alias("model"), F.max(score).alias("score"))


def nearest_date_prior(train: DataFrame, asked: DataFrame) -> DataFrame:
    """Date-only baseline: the class shares of the asked date, or of the nearest trained date (the earlier of equals).

    ``train``: date, compound; ``asked``: date. Both have one row a date at most after grouping, so the pairs are few.
    """
    shares = train.groupBy("date", "compound").agg(F.count("*").alias("n"))
    shares = shares.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("date")))
    days = train.select(F.col("date").alias("near")).distinct()
    pairs = asked.select("date").distinct().join(F.broadcast(days))
    w = Window.partitionBy("date").orderBy(F.abs(F.datediff("date", "near")), "near")
    chosen = pairs.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    return chosen.join(shares.withColumnRenamed("date", "near"), "near").select("date", "near", "compound", "share")
