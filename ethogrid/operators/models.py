"""Classifiers over the subject table and their cross-validation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethogrid.operators import audit, evaluation

COPIES = 4  # rows that a weight of 1 stands for, where a model takes no weights


def with_weights(train: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights: rows / (classes * rows of the class)."""
    counts = train.groupBy(label).agg(F.count("*").alias("__c"))
    total = counts.agg(F.sum("__c").alias("__t"), F.count("*").alias("__k"))
    weighted = counts.join(F.broadcast(total)).select(label, (F.col("__t") / (F.col("__k") * F.col("__c"))).alias("weight"))
    return train.join(F.broadcast(weighted), label)


def majority(train: DataFrame, test: DataFrame) -> DataFrame:
    """Class shares of the training rows for every test row."""
    shares = train.groupBy("label").agg(F.count("*").alias("n"))
    total = train.agg(F.count("*").alias("t"))
    prior = shares.join(F.broadcast(total)).select(F.col("label").alias("cls"), (F.col("n") / F.col("t")).alias("p"))
    return test.select("video_id", "label", "date").join(F.broadcast(prior)).select("video_id", "label", "cls", "p")


def date_only(train: DataFrame, test: DataFrame) -> DataFrame:
    """Class shares of the test row's date, or the nearest trained one."""
    got = evaluation.nearest_date_prior(train.select("date", F.col("label").alias("compound")), test)
    return test.select("video_id", "label", "date").join(F.broadcast(got), "date").select("video_id", "label", F.col("compound").alias("cls"), F.col("share").alias("p"))


def repeated(rows: DataFrame) -> DataFrame:
    """Each row as often as its weight says, ``COPIES`` times for a weight of 1, once at least."""
    times = F.greatest(F.lit(1), F.round(F.col("weight") * COPIES).cast("int"))
    return rows.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), times))).drop("__copy")


def _ml(make: Callable, weighted: bool = True):
    """A classifier of Spark's library over the columns z_*; its probabilities become one row a class.

    Classes weigh alike: by ``weight``, or by repeated rows where the classifier is not ``weighted``.
    """

    def run(train: DataFrame, test: DataFrame) -> DataFrame:
        from pyspark.ml import Pipeline
        from pyspark.ml.feature import StringIndexer, VectorAssembler
        from pyspark.ml.functions import vector_to_array

        names = [c for c in train.columns if c.startswith("z_")]
        rows = with_weights(train)
        n = rows.count()
        rows = rows if weighted else repeated(rows)
        indexer = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc", handleInvalid="keep")
        model = Pipeline(stages=[indexer, VectorAssembler(inputCols=names, outputCol="x"), make(n, len(names), rows.select("label").distinct().count())]).fit(rows)
        labels = model.stages[0].labels
        scored = model.transform(test)
        column = "probability" if "probability" in scored.columns else None
        p = vector_to_array(column) if column else F.transform(F.sequence(F.lit(0), F.lit(len(labels) - 1)), lambda i: (i == F.col("prediction")).cast("double"))
        classes = F.array(*[F.struct(F.lit(c).alias("cls"), F.get(p, F.lit(i)).alias("p")) for i, c in enumerate(labels)])
        return scored.select("video_id", "label", F.inline(classes))

    return run


def _logistic(n: int, width: int, classes: int):
    from pyspark.ml.classification import LogisticRegression

    return LogisticRegression(featuresCol="x", labelCol="y", weightCol="weight", regParam=1.0 / n, standardization=False, maxIter=200)


def _forest(n: int, width: int, classes: int):
    from pyspark.ml.classification import RandomForestClassifier

    return RandomForestClassifier(featuresCol="x", labelCol="y", weightCol="weight", numTrees=500, maxDepth=30, seed=1)


def _boosting(n: int, width: int, classes: int):
    from pyspark.ml.classification import GBTClassifier, OneVsRest

    return OneVsRest(classifier=GBTClassifier(maxIter=20, seed=1), featuresCol="x", labelCol="y", weightCol="weight", parallelism=2)


def _network(n: int, width: int, classes: int):
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    return MultilayerPerceptronClassifier(featuresCol="x", labelCol="y", layers=[width, 32, classes + 1], maxIter=100, seed=1)


#: name -> function(train, test) giving (video_id, label, cls, p)
MODELS: dict[str, Callable] = {
    "majority": majority, "date_only": date_only, "logistic": _ml(_logistic), "forest": _ml(_forest), "boosting": _ml(_boosting), "network": _ml(_network, weighted=False),
}


def standardised(train: DataFrame, test: DataFrame, features: list[str], log: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Both tables with z_* columns; fill, mean and deviation come from the training rows alone."""
    fitted = audit.fit_preprocess(train, features, log)

    def widen(df: DataFrame) -> DataFrame:
        z = audit.preprocess(df, ["video_id"], features, fitted, log)
        wide = z.groupBy("video_id").pivot("feature", features).agg(F.first("z"))
        return df.join(wide.select("video_id", *[F.col(f).alias(f"z_{f}") for f in features]), "video_id")

    return widen(train), widen(test)


def cross_validate(table: DataFrame, folds: DataFrame, features: list[str], models: list[str], log: list[str] = ()) -> DataFrame:
    """(model, scheme, repeat, fold, video_id, label, cls, p) over all folds; rows of fold -1 are always trained on.

    ``table``: video_id, label, date and features; ``folds``: scheme, repeat, video_id, fold.
    """
    out = None
    for scheme, repeat, fold in sorted(tuple(r) for r in folds.where("fold >= 0").select("scheme", "repeat", "fold").distinct().collect()):
        own = folds.where((F.col("scheme") == scheme) & (F.col("repeat") == repeat)).select("video_id", "fold")
        rows = table.join(F.broadcast(own), "video_id")
        train, test = standardised(rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold), features, log)
        for name in models:
            p = MODELS[name](train, test).select(
                F.lit(name).alias("model"), F.lit(scheme).alias("scheme"), F.lit(repeat).alias("repeat"), F.lit(fold).alias("fold"), "video_id", "label", "cls", "p"
            )
            out = p if out is None else out.unionByName(p)
    return out


def compare_with_reference(scored: DataFrame, reference: DataFrame) -> DataFrame:
    """Largest gap between two sets of probabilities (video_id, cls, p) on the ids they share."""
    r = reference.select("video_id", "cls", F.col("p").alias("p_ref"))
    return scored.join(r, ["video_id", "cls"]).agg(F.max(F.abs(F.col("p") - F.col("p_ref"))).alias("gap"), F.count_distinct("video_id").alias("shared"))
