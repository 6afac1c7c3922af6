"""Agreement with reference proportions and the search for thresholds."""

from __future__ import annotations

import math
import random
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethogrid.operators import labeling
from ethogrid.schemas import UNDETERMINED


def proportions(states: DataFrame, group: str, kept: list[str]) -> DataFrame:
    """(group, state, proportion): shares of the kept states among kept rows, 0 for states a group never shows."""
    counts = states.where(F.col("state").isin(kept)).groupBy(group, "state").agg(F.count("*").alias("n"))
    names = F.array(*[F.lit(s) for s in kept])
    grid = states.select(group).distinct().select(group, F.explode(names).alias("state"))
    full = grid.join(counts, [group, "state"], "left").na.fill(0, ["n"])
    totals = full.groupBy(group).agg(F.sum("n").alias("total"))
    return full.join(totals, group).select(group, "state", F.coalesce(F.try_divide("n", "total"), F.lit(0.0)).alias("proportion"))


def total_variation(got: DataFrame, targets: DataFrame, group: str) -> DataFrame:
    """(group, tv): half the summed absolute differences; 1 for a target group without any kept row."""
    g = got.select(group, "state", F.col("proportion").alias("p"))
    both = targets.select(group, "state", F.col("proportion").alias("q")).join(g, [group, "state"], "left")
    tv = F.when(F.sum(F.coalesce("p", F.lit(0.0))) > 0, 0.5 * F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.col("q")))).otherwise(1.0)
    return both.groupBy(group).agg(tv.alias("tv"))


def coverage(states: DataFrame, group: str) -> DataFrame:
    return states.groupBy(group).agg(F.avg((F.col("state") != UNDETERMINED).cast("double")).alias("coverage"))


def agreeing_targets(panels: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Mean proportions of duplicate panels of a group; ``agree`` tells whether every pair is within ``tolerance`` total variation."""
    a = panels.select("grp", F.col("panel").alias("pa"), "state", F.col("proportion").alias("a"))
    b = panels.select("grp", F.col("panel").alias("pb"), "state", F.col("proportion").alias("b"))
    tv = a.join(b, ["grp", "state"]).where("pa < pb").groupBy("grp", "pa", "pb").agg((0.5 * F.sum(F.abs(F.col("a") - F.col("b")))).alias("tv"))
    worst = tv.groupBy("grp").agg(F.max("tv").alias("tv"))
    mean = panels.groupBy("grp", "state").agg(F.avg("proportion").alias("proportion"))
    return mean.join(worst, "grp", "left").select("grp", "state", "proportion", (F.coalesce("tv", F.lit(0.0)) <= tolerance).alias("agree"))


#: parameters of the labelling rules, and what a set that does not name them has
DEFAULTS = {"freeze": 3.0, "min_freeze_s": 1.0, "erratic": 6.0, "surface_depth": 0.0, "min_dead_s": float("inf")}


COPIES = 400_000  # rows of a labelling task, once a set: windows sort them in memory


def dealt(rows: int, sets: int, least: int = 1) -> int:
    """Tasks over which ``rows`` are dealt by subject for ``sets`` parameter sets; adaptive execution would put them together by their size before they are copied."""
    return max(least, math.ceil(rows * sets / COPIES))


def score_sets(with_speed: DataFrame, targets: DataFrame, sets: list[dict], kept: list[str], width: float | None = None, min_determined: float = 0.5, rows: int | None = None) -> DataFrame:
    """(set_no, grp, tv, coverage, scored): how far the states that each parameter set gives are from the target shares of each group.

    ``with_speed``: tracks with smoothed speed and ``grp``; ``targets``: grp, state, proportion, over which a group's shares are made to sum to one on the ``kept`` states.
    States outside ``kept`` leave shares and targets, Undetermined too; coverage is the share of rows that are not Undetermined. tv is 1 where no row or no target is kept.
    With ``width`` the states of time bins are scored. All sets are labelled in one job: tracks are dealt by subject once, and each is copied once a set in its task. The number of tasks goes by
    the number of rows (``rows``, counted if not given), so that a task's memory does not grow with them.
    A set whose erratic threshold is not above its freeze floor is not labelled and gives no row; a group without targets is an error.
    """
    full = [{**DEFAULTS, **s} for s in sets]
    unknown = {k for s in sets for k in s} - DEFAULTS.keys()
    if unknown:
        raise ValueError(f"unknown parameters: {', '.join(sorted(unknown))}")
    good = [(i, s) for i, s in enumerate(full) if s["erratic"] > s["freeze"]]
    each = F.array(*[F.struct(F.lit(i).alias("set_no"), *[F.lit(float(s[k])).alias(f"p_{k}") for k in DEFAULTS]) for i, s in good])
    kind = "array<struct<set_no:int," + ",".join(f"p_{k}:double" for k in DEFAULTS) + ">>"
    need = ["video_id", "frame_idx", "t_sec", "detected", "y_from_frame_top", "orientation_deg", "speed", "speed_valid", "grp"]
    key = ["video_id", "set_no"]
    n = dealt(with_speed.count() if rows is None else rows, len(sets), with_speed.sparkSession.sparkContext.defaultParallelism)
    copied = with_speed.select(*need).repartition(n, "video_id").select("*", F.inline(each.cast(kind)))
    states = labeling.classify(copied, *[F.col(f"p_{k}") for k in DEFAULTS], key=key)
    if width is not None:
        states = labeling.consolidate(states, width, min_determined, key)
    counts = [F.count_if(F.col("state") == s).alias(f"n_{i}") for i, s in enumerate(kept)]
    got = states.groupBy("set_no", "grp").agg(F.count("*").alias("total"), F.count_if(F.col("state") != UNDETERMINED).alias("known"), *counts)
    q = targets.groupBy("grp").agg(*[F.coalesce(F.sum(F.when(F.col("state") == s, F.col("proportion"))), F.lit(0.0)).alias(f"q_{i}") for i, s in enumerate(kept)])
    both = got.join(q.withColumn("there", F.lit(True)), "grp", "left")
    both = both.where(F.when(F.col("there").isNull(), F.raise_error(F.concat(F.lit("no target for group "), F.col("grp").cast("string"))).cast("boolean")).otherwise(True))
    n = sum((F.col(f"n_{i}") for i in range(1, len(kept))), F.col("n_0"))
    mass = sum((F.col(f"q_{i}") for i in range(1, len(kept))), F.col("q_0"))
    parts = [F.abs(F.try_divide(F.col(f"n_{i}").cast("double"), n) - F.try_divide(F.col(f"q_{i}"), mass)) for i in range(len(kept))]
    tv = F.when((n > 0) & (mass > 0), 0.5 * sum(parts[1:], parts[0])).otherwise(1.0)
    return both.select("set_no", "grp", tv.alias("tv"), (F.col("known") / F.col("total")).alias("coverage"), n.alias("scored"))


def mean_distance(scores: DataFrame, sets: int) -> list[float]:
    """Mean tv over groups of each set by its number; 1 for those that were not labelled. One row a set comes to the driver."""
    got = {r["set_no"]: r["tv"] for r in scores.groupBy("set_no").agg(F.avg("tv").alias("tv")).collect()}
    return [got.get(i, 1.0) for i in range(sets)]


def sets_objective(with_speed: DataFrame, targets: DataFrame, kept: list[str], fixed: dict | None = None, width: float | None = None) -> Callable[[list[dict]], list[float]]:
    """Objective of :func:`search`: a batch of parameter sets, with ``fixed`` ones merged in, scored in one job."""

    rows = with_speed.count()

    def objective(batch: list[dict]) -> list[float]:
        return mean_distance(score_sets(with_speed, targets, [{**(fixed or {}), **b} for b in batch], kept, width, rows=rows), len(batch))

    return objective


def search(objective: Callable[[list[dict]], list[float]], ranges: dict[str, tuple[float, float]], draws: int = 20, rounds: int = 6, seed: int = 0, log: tuple[str, ...] = (), initial: dict | None = None) -> tuple[dict, float]:
    """Least of a batched objective: ``initial`` and seeded draws, then steps along each parameter, whose width halves when none improves. ``log``: ranges that are logarithmic.

    The objective gets a whole batch of parameter sets at once, so that one Spark job can score them together. The result is never worse than ``initial``.
    """
    rng = random.Random(seed)

    def at(k: str, unit: float) -> float:
        lo, hi = ranges[k]
        unit = min(1.0, max(0.0, unit))
        return math.exp(math.log(lo) + unit * (math.log(hi) - math.log(lo))) if k in log else lo + unit * (hi - lo)

    def unit(k: str, v: float) -> float:
        lo, hi = ranges[k]
        return (math.log(v) - math.log(lo)) / (math.log(hi) - math.log(lo)) if k in log else (v - lo) / (hi - lo)

    tries = [dict(initial)] if initial else []
    tries += [{k: at(k, rng.random()) for k in ranges} for _ in range(draws)]
    scores = objective(tries)
    best, least = min(zip(tries, scores, strict=True), key=lambda x: x[1])
    step = 0.25
    for _ in range(rounds):
        batch = [{**best, k: at(k, unit(k, best[k]) + sign * step)} for k in ranges for sign in (-1, 1)]
        batch = [b for b in batch if b != best]
        scores = objective(batch)
        found, score = min(zip(batch, scores, strict=True), key=lambda x: x[1])
        if score < least:
            best, least = found, score
        else:
            step /= 2
    return best, least
