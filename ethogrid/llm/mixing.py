"""Mixing of sources to target weights (operator 13): DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ethogrid.llm.common import table, written

WEIGHTS = (3, 1, 2)  # of the sources in code point order, repeating
SHARE = 1.5  # of all words that the mix takes
MOST = 2  # times its size that a source gives at most
SEED = "mix-1"
SOURCES = 10_000  # sources that are broadcast at most ...
SOURCE_BYTES = 4 << 20  # ... if their names are of so many bytes in all; beyond, documents meet them salted
SALTS = 64


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _draw(seed: str, doc_id: Column, text: Column) -> Column:
    """Number from 0 up to 1 (52 bits) that follows from the seed, the id and the text alone."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) of documents (source, size).

    Sources in code point order, null last, weigh ``weights``, repeating, and share ``share`` of all words; a target stops at ``most`` times its source's
    size and the rest is shared again by weight until none is above. That ends where each target is the lesser of weight x level and its limit, so
    the sources are ordered by limit a weight and the level follows from running sums. One row a source goes through one task, never documents.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))))
    by = by.withColumn("weight", weight).withColumn("limit", most * F.col("source_size").cast("double"))
    by = by.withColumn("ratio", F.col("limit") / F.col("weight")).withColumn("amount", share * F.sum("source_size").over(Window.partitionBy()).cast("double"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    by = by.withColumn("before", before).withColumn("rest", rest)
    level = F.when(F.col("ratio") * F.col("rest") + F.col("before") > F.col("amount"), (F.col("amount") - F.col("before")) / F.col("rest"))
    by = by.withColumn("level", F.first(level, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.coalesce(F.least(F.col("limit"), F.col("level") * F.col("weight")), F.col("limit"))
    return by.select("source", "source_size", target.alias("target"))


def with_targets(sized: DataFrame, targets: DataFrame, sources: int = SOURCES) -> DataFrame:
    """``sized`` with the columns source_size and target of its source.

    ``targets`` is broadcast if it has at most ``sources`` rows of SOURCE_BYTES; else each source is copied ``SALTS`` times and documents meet it by (source, salt),
    so that a source with a third of all documents is spread over tasks.
    """
    right = targets.withColumnRenamed("source", "__mix_source")
    n, size = targets.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("source")), F.lit(0))).first()
    if n <= sources and size <= SOURCE_BYTES:
        return sized.join(F.broadcast(right), F.col("source").eqNullSafe(F.col("__mix_source"))).drop("__mix_source")
    right = right.withColumn("__mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = sized.withColumn("__mix_own", F.floor(F.col("draw") * SALTS).cast("int"))
    met = left.join(right.hint("merge"), F.col("source").eqNullSafe(F.col("__mix_source")) & (F.col("__mix_own") == F.col("__mix_salt")))
    return met.drop("__mix_source", "__mix_salt", "__mix_own")


def _copies() -> Column:
    """floor(rate), and one more where the draw is below its fraction; rate = target / source_size, 0 for a source without words."""
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    return F.floor(rate) + (F.col("draw") < rate - F.floor(rate)).cast("long")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED, sources: int = SOURCES) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken): what a mix of ``docs`` (doc_id, text, source, ...) takes of each row.

    Sizes are words between white space (null text: 0); each row is taken floor(rate) times and once more with the fraction as probability, drawn by a hash of
    seed, doc_id and text, so reruns, partitions and other columns do not matter. Rows alike in id and text are drawn alike. Null sources are one source;
    a source without words has target 0 and copies 0; an empty table gives no rows. Texts are read once: what is used twice is the narrow table of sizes.
    """
    sized = docs.select("doc_id", "source", _size(F.col("text")).alias("size"), _draw(seed, F.col("doc_id"), F.col("text")).alias("draw"))
    sized = written(sized, "sizes")
    targets = written(source_targets(sized, weights, share, most), "targets")
    out = with_targets(sized, targets, sources).withColumn("copies", _copies())
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixture(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED, sources: int = SOURCES) -> DataFrame:
    """The mix itself: the rows of ``docs`` with all their columns, each as often as :func:`mix` takes it, and ``copy`` (from 1; replaces a column of that name)."""
    sized = docs.select("source", _size(F.col("text")).alias("size"))
    targets = written(source_targets(sized, weights, share, most), "targets")
    own = [c for c in docs.columns if c != "copy"]
    held = docs.select("source", F.struct(*[F.col(f"`{c}`") for c in own]).alias("__mix_row"), _draw(seed, F.col("doc_id"), F.col("text")).alias("draw"))
    out = with_targets(held, targets, sources).withColumn("copies", _copies()).where("copies > 0")
    return out.select("__mix_row.*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all ``documents``: weights 3, 1, 2 repeating, 150 % of all words, no source above twice its size."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
             CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS draw FROM documents),
a AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, CAST(CASE place % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * CAST((SELECT sum(source_size) FROM a) AS BIGINT) AS amount FROM a),
r AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
             sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
l AS (SELECT min(CASE WHEN cap / weight * rest + before > amount THEN cap / weight END) AS first_free FROM r),
v AS (SELECT (amount - before) / rest AS level FROM r, l WHERE cap / weight = first_free ORDER BY place LIMIT 1),
t AS (SELECT source, source_size, coalesce(least(cap, (SELECT level FROM v) * weight), cap) AS target FROM r),
j AS (SELECT d.doc_id, d.size, t.source_size, t.target, d.source, d.draw, CASE WHEN t.source_size = 0 THEN 0 ELSE t.target / t.source_size END AS rate FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) * size AS taken, source,
  CAST(floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS copies FROM j
"""
