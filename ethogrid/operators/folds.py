"""Stratified folds of subjects, by date or one by one, without collecting subjects."""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ethogrid.functions.scalars import hash_order

PINNED = -1  # fold of rows that are always trained on


def ranked(rows: DataFrame, by: list[str], order: str, tie: str, name: str) -> DataFrame:
    """``name``: place of each row (from 0) among the rows of ``by`` in the order of a hexadecimal hash.

    A class may hold most rows, so its hash order is cut into slices by the first two digits; places in a slice are numbered apart and start after the rows of the slices before.
    """
    cut = rows.withColumn("__slice", F.substring(order, 1, 2))
    sizes = cut.groupBy(*by, "__slice").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*by, "__slice", F.coalesce(before, F.lit(0)).alias("__start"))
    own = F.row_number().over(Window.partitionBy(*by, "__slice").orderBy(order, tie)) - 1
    placed = cut.withColumn("__own", own)
    same = [placed[c].eqNullSafe(starts[c]) for c in [*by, "__slice"]]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    return placed.join(starts, cond).select(*[placed[c] for c in rows.columns], (F.col("__own") + F.col("__start")).cast("long").alias(name))


def assign_dates(counts: list[tuple[str, str, str, int]], k: int) -> dict[str, int]:
    """Fold of each date of (date, its hash, label, rows): larger dates first, each to the fold whose class counts come nearest to a k-th of all; ties to the smaller, then to the first fold.

    Costs are whole numbers: with have the fold's rows of a class, n the date's and N all, the growth of (k have - N)^2 is n (2 k have - 2 N + k n) times k.
    """
    by_date: dict[str, dict[str, int]] = defaultdict(dict)
    hashes, whole = {}, defaultdict(int)
    for date, h, label, n in counts:
        by_date[date][label] = by_date[date].get(label, 0) + n
        hashes[date] = h
        whole[label] += n
    k = max(1, min(k, len(by_date), max(whole.values(), default=1)))
    have = [defaultdict(int) for _ in range(k)]
    size = [0] * k
    out = {}
    for date in sorted(by_date, key=lambda d: (-sum(by_date[d].values()), hashes[d])):
        own = by_date[date]
        best = min(range(k), key=lambda f: (sum(n * (2 * k * have[f][c] - 2 * whole[c] + k * n) for c, n in own.items()), size[f], f))
        for c, n in own.items():
            have[best][c] += n
            size[best] += n
        out[date] = best
    return out


def folds(rows: DataFrame, k: int = 5, repeats: int = 1, seed: int = 0, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, scheme, repeat, video_id, fold) of subjects (keys, video_id, label, date), each group of ``keys`` on its own.

    Scheme A keeps a date in one fold and balances labels over folds; labels seen on one date only are pinned (fold -1). It is left out for a group with fewer than two
    dates of other labels. Only counts by date and label meet in one task of a group and repeat. Scheme B deals each label's subjects in turn, in a seeded hash order, each label starting
    where the one before ended. k is at most the size of the largest label, in scheme A also the number of dates. Null dates are one date, null labels drop out.
    """
    keys = list(keys)
    rows = rows.where("label IS NOT NULL").select(*keys, "video_id", F.col("label").cast("string").alias("label"), F.coalesce(F.col("date").cast("string"), F.lit("")).alias("date"))
    times = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat")
    counts = rows.groupBy(*keys, "label", "date").agg(F.count("*").alias("n"))
    spread = counts.groupBy(*keys, "label").agg((F.count("*") == 1).alias("pinned"), F.sum("n").alias("size"))
    free = counts.join(spread.where("NOT pinned").drop("pinned", "size"), [*keys, "label"]).select("*", times)
    free = free.withColumn("hash", hash_order(seed, F.col("repeat"), F.col("date")))

    def assign(group: pa.Table) -> pa.Table:
        got = assign_dates(list(zip(*(group.column(c).to_pylist() for c in ("date", "hash", "label", "n")), strict=True)), k)
        first = {c: group.column(c)[0] for c in [*keys, "repeat"]}
        if len(got) < 2:
            got = {}
        columns = {c: pa.array([v.as_py()] * len(got), group.schema.field(c).type) for c, v in first.items()}
        return pa.table(columns | {"date": pa.array(list(got), pa.string()), "fold": pa.array(list(got.values()), pa.int32())})

    kinds = {f.name: f.dataType.simpleString() for f in free.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keys), "repeat int", "date string", "fold int"])
    dated = free.groupBy(*keys, "repeat").applyInArrow(assign, schema)
    a = rows.join(spread.drop("size"), [*keys, "label"])
    pinned = a.where("pinned").join(dated.select(*keys, "repeat").distinct(), keys) if keys else a.where("pinned").crossJoin(F.broadcast(dated.select("repeat").distinct()))
    pinned = pinned.select(*keys, "repeat", "video_id", F.lit(PINNED).alias("fold"))
    placed = a.where("NOT pinned").join(dated, [*keys, "date"]).select(*keys, "repeat", "video_id", "fold")
    a = placed.unionByName(pinned).withColumn("scheme", F.lit("A"))

    over = Window.partitionBy(*keys)
    starts = F.coalesce(F.sum("size").over(over.orderBy("label").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = spread.select(*keys, "label", starts.alias("start"), F.least(F.lit(k), F.max("size").over(over)).alias("k"))
    b = rows.select(*keys, "video_id", "label", times).withColumn("hash", hash_order(seed, F.col("repeat"), F.col("video_id")))
    b = ranked(b, [*keys, "repeat", "label"], "hash", "video_id", "place").join(sizes, [*keys, "label"])
    b = b.select(*keys, "repeat", "video_id", ((F.col("place") + F.col("start")) % F.col("k")).cast("int").alias("fold"), F.lit("B").alias("scheme"))
    return a.unionByName(b).select(*keys, "scheme", "repeat", "video_id", "fold")
