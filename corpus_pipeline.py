"""Corpus pipeline over ``documents``: each stage applies one training-data operator and is written before the next.

Every stage works on all rows that its predecessor kept, takes documents with any further columns, and returns the same
columns (the last one the packing). Null texts count as empty, rows without a doc_id are kept by near-dedup, and an empty table
goes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ethogrid.llm.common import table, written
from ethogrid.llm.decontaminate import drop_contaminated
from ethogrid.llm.jaccard import similar_keep_one
from ethogrid.llm.packing import pack_documents, text_lengths
from ethogrid.llm.quality import keep_good
from ethogrid.llm.suffix_dedup import remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it is fitted on a bounded sample of the labelled ones."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles have a Jaccard similarity of 0.8 or more, directly or over others, that with the smallest doc_id stays."""
    return similar_keep_one(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes or more that occur more than once are cut out of the texts; no document goes."""
    return remove_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences: a row for each document, or for each piece of a long one."""
    return pack_documents(text_lengths(docs))


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", repeated_strings),
    ("benchmark_decontamination", decontaminate),
    ("best_fit_packing", pack),
]

#: SQL has no trained models, hashed shingles or suffix arrays; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
