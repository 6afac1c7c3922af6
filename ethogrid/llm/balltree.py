"""Exact top-k inner-product search with a ball tree per shard (operator 8)."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ethogrid.llm.common import table, written

K = 5
LEAF = 128  # vectors of a leaf at most
SHARD_ROWS = 200_000  # vectors of a shard, about
QUERY_BLOCK = 20_000  # queries that meet a shard in one task, about
PIVOTS = 2_000  # vectors scored first to bound every query's kth score from below


def quantized(table_: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v) with v: floor(scale * x) of each component x as a double; rows with a null id, or a null or non-finite part, left out."""
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale).cast("double"))
    whole = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return table_.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(whole).select("vec_id", x.alias("v"))


class BallTree:
    """Nodes as arrays: center, radius, range of rows, children (left, right) or -1. Rows are reordered to be contiguous.

    A node is split at the median of its rows' projections on the line between two far-apart rows.
    """

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(vectors))
        centers, radii, lo, hi, left, right = [], [], [], [], [], []
        stack = [(0, len(vectors), -1, 0)]
        while stack:
            a, b, parent, side = stack.pop()
            me = len(centers)
            if parent >= 0:
                (left if side == 0 else right)[parent] = me
            rows = vectors[order[a:b]]
            c = rows.mean(axis=0)
            away = np.sqrt(((rows - c) ** 2).sum(axis=1))
            centers.append(c)
            radii.append(float(away.max()))
            lo.append(a)
            hi.append(b)
            left.append(-1)
            right.append(-1)
            if b - a <= leaf or radii[me] == 0:
                continue
            p = rows[away.argmax()]
            q = rows[((rows - p) ** 2).sum(axis=1).argmax()]
            along = rows @ (q - p)
            order[a:b] = order[a:b][np.argsort(along, kind="stable")]
            mid = (a + b) // 2
            stack += [(mid, b, me, 1), (a, mid, me, 0)]
        self.order = order
        self.vectors = vectors[order]
        self.centers, self.radii = np.array(centers), np.array(radii)
        self.lo, self.hi, self.left, self.right = lo, hi, left, right

    def search(self, queries: np.ndarray, floors: np.ndarray, skip: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int):
        """For each query the k best (score, id) of these rows, ``ids`` and ``rows`` their ids and row numbers, that reach its floor; ``skip`` is the query's own row.

        Best node first by upper bound: center . query + radius * |query|. A node whose bound is below the larger of the floor and
        the current kth score is not opened, and as bounds only fall from there, the search ends.
        """
        ids, rows = ids[self.order], rows[self.order]
        norms = np.sqrt((queries**2).sum(axis=1))
        bounds = queries @ self.centers.T
        bounds += norms[:, None] * self.radii[None, :]
        bounds += 1e-6 * (1 + np.abs(bounds))  # rounding of the bound; the scores are exact integers
        out = []
        for i in range(len(queries)):
            q, bound, floor = queries[i], bounds[i].tolist(), floors[i]
            best: list[tuple[float, int]] = []  # heap of (score, -id): its root is the worst that stays
            heap = [(-bound[0], 0)]
            while heap:
                b, node = heapq.heappop(heap)
                kth = max(floor, best[0][0]) if len(best) == k else floor
                if -b < kth:
                    break
                if self.left[node] >= 0:
                    for child in (self.left[node], self.right[node]):
                        if bound[child] >= kth:
                            heapq.heappush(heap, (-bound[child], child))
                    continue
                a, z = self.lo[node], self.hi[node]
                scores = self.vectors[a:z] @ q
                good = np.flatnonzero(scores >= kth)
                for j in good.tolist():
                    if rows[a + j] == skip[i]:
                        continue
                    x = int(ids[a + j])
                    item = (float(scores[j]), -x)
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
            out.append([(s, -x) for s, x in best])
        return out


def _matrix(col) -> np.ndarray:
    """List column of equally long vectors as a matrix."""
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1).astype(np.float64) if len(flat) else np.zeros((len(col), 0))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best inner products of each query with all vectors but its own row.

    Both frames are (vec_id, v), v finite doubles, and may have ``row``, a number that tells rows apart; without it rows of one vec_id are one another's own. Vectors of unequal length do not meet.
    Ties go to the smaller vec_id. With ``row`` a repeated vec_id counts once for each of its rows, and as often as a query: each gets its own ranking, in which the others
    stand. Queries with fewer than k candidates get all.

    Vectors lie in shards, each with its own tree. Queries meet every shard in blocks, so no side is broadcast whatever its size:
    the blocks of queries are the keys, and a task holds one shard and one block. Before that each query is scored against a fixed
    number of vectors, and the kth of these is the floor that all shards prune with from the start; a shard returns at
    most k rows a query that reach it.
    """
    spark = vectors.sparkSession
    numbered = lambda df: df if "row" in df.columns else df.withColumn("row", F.col("vec_id").cast("long"))
    vectors = written(numbered(vectors).select("row", "vec_id", "v", F.size("v").alias("dim")), "vectors")
    queries = written(numbered(queries).select("row", "vec_id", "v", F.size("v").alias("dim")), "queries")
    n, m = vectors.count(), queries.count()
    shards, blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-m // QUERY_BLOCK))
    cores = spark.sparkContext.defaultParallelism
    shards = max(shards, min(cores, -(-n // 2_000)))
    pivots = vectors.orderBy(F.xxhash64("row"), "row").limit(PIVOTS).collect()
    by_dim: dict[int, tuple] = {}
    for r in pivots:
        ids, rows = by_dim.setdefault(r["dim"], ([], []))
        ids.append(r["row"])
        rows.append(r["v"])
    shared = spark.sparkContext.broadcast({d: (np.array(i), np.array(v).reshape(len(i), d)) for d, (i, v) in by_dim.items()})

    def floors(batches):
        for b in batches:
            dims = b.column(3).to_numpy()
            floor = np.full(len(dims), -np.inf)
            ids = b.column(0).to_numpy()
            for d in np.unique(dims).tolist():
                if d not in shared.value:
                    continue
                pid, pv = shared.value[d]
                at = np.flatnonzero(dims == d)
                for i in range(0, len(at), 512):
                    part = at[i : i + 512]
                    s = _matrix(b.column(2).take(pa.array(part))) @ pv.T
                    s[ids[part][:, None] == pid[None, :]] = -np.inf
                    if s.shape[1] >= k:
                        floor[part] = np.partition(s, -k, axis=1)[:, -k]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(floor)], [*b.schema.names, "floor"])

    deal = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    asked = queries.mapInArrow(floors, "row long, vec_id long, v array<double>, dim int, floor double").withColumn("block", deal)
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))) if shards > 1 else asked.withColumn("shard", F.lit(0))
    held = vectors.withColumn("shard", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(shards)).cast("int")).withColumn("floor", F.lit(None).cast("double"))
    held = held.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) if blocks > 1 else held.withColumn("block", F.lit(0))
    cols = ["shard", "block", "dim", "row", "vec_id", "v", "floor"]
    both = held.select(cols).unionByName(asked.select(cols))

    def search(batches):
        def solve(group):
            at = pa.Table.from_batches(group)
            asks = at.column(6).is_valid().to_numpy()
            v = _matrix(at.column(5).combine_chunks())
            row, ids, floor = (at.column(i).to_numpy() for i in (3, 4, 6))
            if asks.all() or not asks.any():
                return None
            tree = BallTree(v[~asks])
            q, floor, own, found = v[asks], floor[asks], row[asks], []
            for i in range(0, len(q), 512):  # bounds of some queries at a time
                found += tree.search(q[i : i + 512], floor[i : i + 512], own[i : i + 512], ids[~asks], row[~asks], k)
            rows = [(r, q, int(x), int(s)) for r, q, best in zip(own.tolist(), ids[asks].tolist(), found, strict=True) for s, x in best]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["query_row", "query_id", "vec_id", "score"])

        group, key = [], None
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(i).to_numpy() for i in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, z in zip(cuts, cuts[1:], strict=False):
                now = tuple(keys[a].tolist())
                if now != key and group:
                    out = solve(group)
                    group = []
                    if out is not None:
                        yield out
                key = now
                group.append(b.slice(a, z - a))
        if group and (out := solve(group)) is not None:
            yield out

    met = both.repartition(shards * blocks, "shard", "block").sortWithinPartitions("shard", "block", "dim")
    found = met.mapInArrow(search, "query_row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 5 of ``embeddings`` for every row whose vec_id is divisible by 50."""
    vectors = written(quantized(table(spark, sf_dir, "embeddings")).withColumn("row", F.monotonically_increasing_id()), "numbered")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


ORACLE = """
WITH e AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.rid <> q.rid AND len(q.v) = len(c.v))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
