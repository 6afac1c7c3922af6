"""Hard negatives by a vector-approximation file (operator 11)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ethogrid.llm.common import table, written

POSITIVES = 5
NEGATIVES = 10
WINDOW = (30, 90)  # per cent of the positive's score
CELLS = 64  # of a dimension
SHARD_ROWS = 100_000  # vectors of a shard, about
ANCHOR_BLOCK = 4_000  # anchors that meet a shard in one task, about


def labelled(rows: DataFrame, scale: int = 256, moved: int = 7, classes: int = 10) -> DataFrame:
    """(vec_id, label, v): floor(scale * x) of each component x as a double; labels of ids divisible by ``moved`` go on by one.

    Rows with a null id, label or vector, or with any null or non-finite component, are left out. An empty vector takes part (all its scores are 0).
    """
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale).cast("double"))
    whole = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    label = F.when(F.col("vec_id") % moved == 0, (F.col("label") + 1) % classes).otherwise(F.col("label"))
    there = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    return rows.where(there).where(whole).select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), x.alias("v"))


class Approximation:
    """Vectors with a cell number of each dimension. Cells hold about equally many rows; each keeps the least and largest value in it.

    An inner product is bounded by a sum over the dimensions of what the vector's cell can give at least and at most: two looked up numbers each.
    """

    def __init__(self, vectors: np.ndarray, cells: int = CELLS):
        n, width = vectors.shape
        self.vectors = vectors
        self.codes = np.zeros((width, n), np.uint8)  # a row a dimension, so that a look-up reads on
        self.least, self.most = np.zeros((width, cells)), np.zeros((width, cells))
        for d in range(width if n else 0):
            x = vectors[:, d]
            edges = np.unique(np.quantile(x, np.arange(1, cells) / cells, method="lower"))
            code = np.searchsorted(edges, x, side="right")
            self.codes[d] = code
            low, high = np.full(cells, np.inf), np.full(cells, -np.inf)
            np.minimum.at(low, code, x)
            np.maximum.at(high, code, x)
            self.least[d], self.most[d] = np.where(low <= high, low, 0), np.where(low <= high, high, 0)

    def bounds(self, q: np.ndarray, a: int, z: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of q's scores with the rows a to z. Sums of integers below 2^53 are exact; a slack covers larger ones."""
        x, y = q[:, None] * self.least, q[:, None] * self.most
        under, over = np.minimum(x, y), np.maximum(x, y)
        low, high = np.zeros(z - a), np.zeros(z - a)
        for d, code in enumerate(self.codes):
            at = code[a:z]
            low += under[d].take(at)
            high += over[d].take(at)
        slack = 1e-12 * (np.abs(low) + np.abs(high)) * (len(q) + 1)
        return low - slack, high + slack


def _first(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    return np.lexsort((rows, ids, -scores))[:k]


def near_places(approx: Approximation, q: np.ndarray, a: int, z: int, k: int) -> np.ndarray:
    """Places among a to z that can be one of the k highest scores: the upper bound reaches the kth highest lower bound."""
    low, high = approx.bounds(q, a, z)
    floor = np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -np.inf
    return a + np.flatnonzero(high >= floor)


def window_places(low: np.ndarray, high: np.ndarray, least: float, most: float, k: int) -> np.ndarray:
    """Places that can be one of the k highest scores from ``least`` to ``most``: the bounds meet the window and reach the kth lower bound of those surely in it."""
    may = (high >= least) & (low <= most)
    sure = low[may & (low >= least) & (high <= most)]
    if len(sure) >= k:
        may &= high >= np.partition(sure, len(sure) - k)[len(sure) - k]
    return np.flatnonzero(may)


def _matrix(col) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1).astype(np.float64) if len(flat) else np.zeros((len(col), 0))


def _met(vectors: DataFrame, asked: DataFrame, shards: int, blocks: int) -> DataFrame:
    """Vectors and anchors by (shard, block, dim, label): each vector once a block, each anchor once a shard, so neither side is broadcast whatever its size."""
    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    asked = asked.withColumn("block", block).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    held = vectors.withColumn("shard", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    held = held.withColumn("limits", F.lit(None).cast("array<double>"))
    cols = ["shard", "block", "dim", "label", "row", "vec_id", "v", "limits"]
    return held.select(cols).unionByName(asked.select(cols)).repartition(shards * blocks, "shard", "block").sortWithinPartitions("shard", "block", "dim", "label")


def _groups(batches):
    """Tables of equal (shard, block, dim) from sorted batches; a group is one shard and one block of anchors."""
    group, key = [], None
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(i).to_numpy() for i in range(3)], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for a, z in zip(cuts, cuts[1:], strict=False):
            now = tuple(keys[a].tolist())
            if now != key and group:
                yield pa.Table.from_batches(group)
                group = []
            key = now
            group.append(b.slice(a, z - a))
    if group:
        yield pa.Table.from_batches(group)


class _Tile:
    """The vectors of a shard with their approximation, and the anchors that ask."""

    def __init__(self, t: pa.Table):
        asks = t.column(7).is_valid().to_numpy()
        v = _matrix(t.column(6).combine_chunks())
        label, row, ids = (t.column(i).to_numpy() for i in (3, 4, 5))
        self.label, self.row, self.ids = label[~asks], row[~asks], ids[~asks]
        self.approx = Approximation(v[~asks])
        self.q, self.q_label, self.q_row = v[asks], label[asks], row[asks]
        self.limits = t.column(7).filter(pa.array(asks)).to_pylist()

    def exact(self, i: int, at: np.ndarray) -> np.ndarray:
        return self.approx.vectors[at] @ self.q[i]

    def positives(self, k: int):
        """(anchor row, row, vec_id, score) of the k best rows of the anchor's label in this shard; rows lie by label, so others are not looked at."""
        for i, own in enumerate(self.q_row.tolist()):
            a, z = np.searchsorted(self.label, self.q_label[i], side="left"), np.searchsorted(self.label, self.q_label[i], side="right")
            at = near_places(self.approx, self.q[i], a, z, k + 1)  # the anchor's own row may be among them
            at = at[self.row[at] != own]
            scores = self.exact(i, at)
            for j in _first(scores, self.ids[at], self.row[at], k):
                yield own, self.row[at[j]], self.ids[at[j]], scores[j]

    def negatives(self, k: int, least: int, most: int):
        """(anchor row, positive row, vec_id, score, row) of the k best rows of other labels in each of the anchor's windows."""
        for i, own in enumerate(self.q_row.tolist()):
            low, high = self.approx.bounds(self.q[i], 0, len(self.row))
            other = self.label != self.q_label[i]
            low, high = np.where(other, low, np.inf), np.where(other, high, -np.inf)
            limits = self.limits[i]
            for p, score in zip(limits[::2], limits[1::2], strict=True):
                if score < 0:  # 30 % of it are above 90 %
                    continue
                at = window_places(low, high, least * score / 100 - 1, most * score / 100 + 1, k) if len(low) else np.zeros(0, int)
                scores = self.exact(i, at)
                good = (100 * scores >= least * score) & (100 * scores <= most * score)
                at, scores = at[good], scores[good]
                for j in _first(scores, self.ids[at], self.row[at], k):
                    yield own, int(p), self.ids[at[j]], scores[j], self.row[at[j]]


def _out(rows: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([int(r[i]) for r in rows], pa.int64()) for i in range(len(names))], names)


def hard_negatives(rows: DataFrame, anchors: str = "vec_id % 100 = 0", positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``rows`` (vec_id, label, v), v finite doubles.

    Scores are inner products, exact while sums of their products stay below 2^53; higher first, ties to the smaller vec_id. ``anchors`` picks the anchor rows; an anchor's
    positives are its first other rows of its label, its negatives, for each positive, the first rows of other labels with ``window`` per cent of the positive's score. Rows are told
    apart by a number, not by vec_id: a repeated row is a row of its own, also as anchor and as positive. Vectors of unequal length do not meet. Anchors or positives without
    any partner give no row. Blocks of anchors meet shards of rows twice: for the positives, and with the windows that follow from them for the negatives.
    """
    spark = rows.sparkSession
    vectors = rows.withColumn("dim", F.size("v")).withColumn("row", F.monotonically_increasing_id())
    vectors = written(vectors, "rows")  # also fixes the row numbers
    asked = vectors.where(anchors)
    n, m = vectors.count(), asked.count()
    cores = spark.sparkContext.defaultParallelism
    shards, blocks = max(1, -(-n // SHARD_ROWS), min(cores, -(-n // 2_000))), max(1, -(-m // ANCHOR_BLOCK))

    def find(batches):
        for t in _groups(batches):
            yield _out(list(_Tile(t).positives(positives)), ["anchor", "row", "vec_id", "score"])

    met = _met(vectors, asked.withColumn("limits", F.array().cast("array<double>")), shards, blocks)
    found = met.mapInArrow(find, "anchor long, row long, vec_id long, score long")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id", "row")
    first = written(found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives), "positives")

    pair = F.array(F.col("row").cast("double"), F.col("score").cast("double"))  # row numbers and scores below 2^53
    limits = first.groupBy("anchor").agg(F.flatten(F.collect_list(pair)).alias("limits"))
    asking = asked.join(limits, asked["row"] == limits["anchor"]).select(asked["*"], "limits")
    least, most = window

    def mine(batches):
        for t in _groups(batches):
            yield _out(list(_Tile(t).negatives(negatives, least, most)), ["anchor", "row", "negative_id", "negative_score", "negative"])

    got = _met(vectors, asking, shards, blocks).mapInArrow(mine, "anchor long, row long, negative_id long, negative_score long, negative long")
    order = Window.partitionBy("anchor", "row").orderBy(F.desc("negative_score"), "negative_id", "negative")
    got = got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    names = asked.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    pairs = first.select("anchor", "row", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).join(names, "anchor")
    return got.join(pairs, ["anchor", "row"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of ``embeddings`` for the rows whose vec_id is divisible by 100."""
    return hard_negatives(labelled(table(spark, sf_dir, "embeddings")))


ORACLE = """
WITH e AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid AS anchor, q.vec_id AS anchor_id, c.rid, c.vec_id, c.label = q.label AS same, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id % 100 = 0 AND c.rid <> q.rid AND len(q.v) = len(c.v)),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, rid) AS place FROM s WHERE same) WHERE place <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.rid ORDER BY s.score DESC, s.vec_id, s.rid) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
      FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
