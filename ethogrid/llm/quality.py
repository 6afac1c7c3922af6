"""Quality classifier on supervised subword embeddings (operator 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ethogrid.llm.common import held_out, keeping_names, table
from ethogrid.llm.subword import Model, Subwords, labelled_sample, train, with_score

SAMPLE = 6000  # labelled documents that the classifier is fitted on at most
THRESHOLD = 0.3
FOLDS, HELD = 5, 0


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Model:
    """Fitted on at most ``rows`` labelled documents outside the held-out fifth. Case and punctuation count."""
    texts, y = labelled_sample(docs, labels, "quality", ~held_out(F.col("doc_id"), FOLDS, HELD), rows)
    return train(texts, y, Subwords(fold=False, letters=False))


def quality_scores(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text).

    Null and empty texts get the score of a text without features. Repeated rows are scored each. A null doc_id is not
    held out. Without labels every score is 0.5. Other columns are ignored.
    """
    scored = with_score(docs.select("doc_id", "text"), fit_quality(docs, labels, rows))
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), FOLDS, HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


@keeping_names
def keep_good(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with their columns."""
    return with_score(docs, fit_quality(docs, labels, rows), "__quality_score").where(F.col("__quality_score") >= THRESHOLD).drop("__quality_score")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
