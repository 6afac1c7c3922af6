"""Toxicity classifier on subword-bag embeddings (operator 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ethogrid.llm.common import held_out, table
from ethogrid.llm.subword import Model, Subwords, labelled_sample, train, with_score

SAMPLE = 10000  # labelled documents that the classifier is fitted on at most
THRESHOLD = 0.7
FOLDS, HELD = 3, 1


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Model:
    """Fitted on at most ``rows`` labelled documents outside the held-out third. Words are lower-cased letters and digits,
    so a misspelling shares most of its character n-grams with the word it stands for."""
    texts, y = labelled_sample(docs, labels, "toxic", ~held_out(F.col("doc_id"), FOLDS, HELD), rows)
    return train(texts, y, Subwords(fold=True, letters=True))


def toxicity_scores(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text).

    Null and empty texts get the score of a text without features. Repeated rows are scored each. A null doc_id is not
    held out. Without labels every score is 0.5. Other columns are ignored.
    """
    scored = with_score(docs.select("doc_id", "text"), fit_toxicity(docs, labels, rows))
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), FOLDS, HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
