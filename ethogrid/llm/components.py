"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethogrid.llm.common import drop_written, written


def _stamp(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges`` (u, v) -> (node, root): root is the smallest node that each node reaches.

    Every round is two aggregations with map-side minima and two joins whose small side has one row a node, so a
    node with very many links is split by adaptive execution. Rounds are written to the shared folder; only two
    numbers a round (edge count and a checksum) reach the driver. Nodes without an edge are not in the result.
    The result reads its last round's table, which ``drop_written`` deletes.
    Raises RuntimeError if the edges have not settled after ``rounds`` rounds.
    """
    e = written(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    before = _stamp(e)
    for _ in range(rounds):
        if before[0] == 0:
            break
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = (
            both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low.withColumnRenamed("u", "k"), F.col("u") == F.col("k"))
        small = (
            joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .union(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        nxt = written(small, "edges")
        after = _stamp(nxt)
        drop_written(e)
        e = nxt
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    out = e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
    out.written_path = e.written_path
    return out
