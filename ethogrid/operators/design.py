"""Splits, permutations and greedy samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ethogrid.functions.scalars import hash_order
from ethogrid.sources.tables import written


def hash_split(rows: DataFrame, group: str, key: str, share: float, seed: int, least: int = 5) -> DataFrame:
    """``split``: in each group of ``least`` rows or more, the first max(1, round(share * n)) by a seeded hash are held out."""
    order = hash_order(seed, F.col(group), F.col(key))
    w = Window.partitionBy(group)
    n = F.count("*").over(w)
    place = F.row_number().over(w.orderBy(order, key))
    held = (n >= least) & (place <= F.greatest(F.lit(1), F.bround(n * share).cast("int")))
    return rows.withColumn("split", F.when(held, "test").otherwise("train"))


def permute_within(rows: DataFrame, group: str, key: str, label: str, seed: int) -> DataFrame:
    """``permuted``: labels shuffled inside each group, by joining two orders of its rows."""
    a = Window.partitionBy(group).orderBy(key)
    b = Window.partitionBy(group).orderBy(hash_order(seed, F.col(group), F.col(key)), key)
    left = rows.withColumn("__k", F.row_number().over(a))
    right = rows.select(F.col(group).alias("__g"), F.row_number().over(b).alias("__r"), F.col(label).alias("permuted"))
    return left.join(right, (F.col(group) == F.col("__g")) & (F.col("__k") == F.col("__r"))).drop("__k", "__g", "__r")


def evenly_spaced(rows: DataFrame, group: str, order: str, k: int) -> DataFrame:
    """``k`` rows of each group evenly spaced in order, first and last included; all rows of smaller groups."""
    w = Window.partitionBy(group)
    out = rows.withColumn("__n", F.count("*").over(w)).withColumn("__i", F.row_number().over(w.orderBy(order)) - 1)
    picks = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.bround(j * ((F.col("__n") - 1) / float(max(k - 1, 1)))).cast("int"))
    return out.where((F.col("__n") <= k) | F.array_contains(picks, F.col("__i").cast("int"))).drop("__n", "__i")


def candidates(tracks: DataFrame, shortest: int, longest: int, stride: int) -> DataFrame:
    """(video_id, pos, reason): middles of undetected gaps of ``shortest`` to ``longest`` rows, quartiles of longer ones, and every ``stride``-th row."""
    from ethogrid.operators.flags import undetected_gaps

    gaps = undetected_gaps(tracks)
    mid = gaps.where(F.col("length").between(shortest, longest)).select("video_id", F.col("mid_pos").cast("long").alias("pos"), F.lit("gap").alias("reason"))
    at = F.array(*[(F.col("start_pos") + F.floor(F.col("length") * q)).cast("long") for q in (0.25, 0.5, 0.75)])
    quart = gaps.where(F.col("length") > longest).select("video_id", F.explode(at).alias("pos"), F.lit("long_gap").alias("reason"))
    every = tracks.withColumn("pos", (F.row_number().over(Window.partitionBy("video_id").orderBy("frame_idx")) - 1).cast("long"))
    grid = every.where(F.col("pos") % stride == 0).select("video_id", "pos", F.lit("stride").alias("reason"))
    return mid.unionByName(quart).unionByName(grid)


def spaced_out(found: DataFrame, taken: DataFrame, rows: int) -> DataFrame:
    """Candidates that have no taken row within ``rows`` of them in the same video."""
    t = taken.select(F.col("video_id").alias("t_id"), F.col("pos").alias("t_pos"))
    return found.join(t, (F.col("video_id") == F.col("t_id")) & (F.abs(F.col("pos") - F.col("t_pos")) <= rows), "left_anti")


def greedy_sample(found: DataFrame, per_video: int, spacing: int, seed: int) -> DataFrame:
    """Up to ``per_video`` candidates of each video at least ``spacing`` rows apart, taken in a seeded order.

    What is taken depends on what was taken before, so each video's candidates go through one Python function.
    """

    def pick(pdf):
        pdf = pdf.sort_values("o")
        kept: list[int] = []
        rows = []
        for i, p in zip(pdf.index, pdf["pos"], strict=True):
            if len(kept) < per_video and all(abs(p - q) >= spacing for q in kept):
                kept.append(p)
                rows.append(i)
        return pdf.loc[rows, ["video_id", "pos", "reason"]]

    ordered = found.withColumn("o", hash_order(seed, F.col("video_id"), F.col("pos"), F.col("reason")))
    return ordered.groupBy("video_id").applyInPandas(pick, "video_id string, pos long, reason string")


def quota_round_robin(found: DataFrame, group: str, order: list, total: int) -> DataFrame:
    """``total`` rows taken in turns from the groups: all first rows, then all second ones, and so on."""
    out = found.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return out.orderBy("turn", group).limit(total)


def _unguarded(good: DataFrame, annotated: DataFrame, guard_s: float) -> DataFrame:
    """Rows of ``good`` that are more than ``guard_s`` from each annotated row (video_id, frame_idx) of their video: the nearest ones before and after decide."""
    met = good.withColumn("guard", F.lit(None).cast("long")).unionByName(annotated.select("video_id", "frame_idx", F.col("frame_idx").alias("guard")), allowMissingColumns=True)
    w = Window.partitionBy("video_id").orderBy("frame_idx", F.col("guard").asc_nulls_last())  # an annotated row goes before the others of its frame
    before = F.last("guard", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.expr("lead(guard) IGNORE NULLS OVER (PARTITION BY video_id ORDER BY frame_idx, guard NULLS LAST)")
    reach = F.col("fps") * guard_s
    met = met.withColumns({"before": before, "after": after}).where("guard IS NULL")
    far = (F.col("before").isNull() | (F.col("frame_idx") - F.col("before") > reach)) & (F.col("after").isNull() | (F.col("after") - F.col("frame_idx") > reach))
    return met.where(far).select(*good.columns)


def _first_videos(offered: DataFrame, enough: dict[str, int]) -> DataFrame:
    """Rows of ``offered`` (.., rank) of those videos whose best row is among the ``enough[split]`` best ones of their split and compound."""
    best = offered.groupBy("split", "compound", "video_id").agg(F.min("rank").alias("rank"))
    place = F.row_number().over(Window.partitionBy("split", "compound").orderBy("rank"))
    first = best.withColumn("place", place).where(F.col("place") <= max(enough.values(), default=0)).where(F.col("place") <= _by_split(enough))
    first = first.select(F.col("video_id").alias("__v"))
    return offered.join(first, F.col("video_id").eqNullSafe(F.col("__v")), "left_semi")


def _by_split(numbers: dict[str, int]) -> Column:
    out = F.lit(0)
    for split, n in numbers.items():
        out = F.when(F.col("split") == split, n).otherwise(out)
    return out


def _free_picks(found: DataFrame, gap_s: float, per_video: int) -> DataFrame:
    """Rows of ``found`` (.., rank, kind) that may be picked when a video's rows are offered in the order of ``rank``: at most ``per_video`` of them with those taken before, ``gap_s`` from each
    other and from those taken.

    Whether a row may be picked depends on its own video only, so a fold over each video's rows keeps at most ``per_video`` of them. kind: 0 candidate, 2 taken before.
    """
    row = F.struct("rank", *[c for c in found.columns if c != "rank"])
    videos = found.groupBy("video_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") == 0, row))).alias("rows"), F.collect_list(F.when(F.col("kind") == 2, F.col("frame_idx"))).alias("taken")
    )

    def free(kept: Column, r: Column) -> Column:
        def apart(frame: Column) -> Column:
            return F.abs(r["frame_idx"] - frame) >= r["fps"] * gap_s

        return (F.size(kept) + F.size("taken") < per_video) & F.forall("taken", apart) & F.forall(kept, lambda k: apart(k["frame_idx"]))

    picks = F.aggregate("rows", F.slice("rows", 1, 0), lambda kept, r: F.when(free(kept, r), F.concat(kept, F.array(r))).otherwise(kept))
    return videos.select(F.inline(picks))


def select_candidates(
    scanned: DataFrame, annotated: DataFrame, quotas: dict[str, tuple[int, int]], seed: int, least_score: float = 0.5, tilted: float = 100.0, unsure: tuple[float, float] = (60.0, 100.0),
    gap_s: float = 20.0, guard_s: float = 2.0, per_video: int = 4,
) -> DataFrame:
    """(video_id, frame_idx, split, reason, tilt, turn) of the rows to annotate next, from ``scanned`` (video_id, frame_idx, fps, compound, split, box_score, tilt).

    ``quotas[split]``: how many tilted rows, highest tilt first, then how many unsure ones, in a seeded order. Compounds take turns: all first picks, then all second ones; a compound whose rows
    run out is passed over. A video is of one compound and split. Rows near annotated ones (video_id, frame_idx), of a low score or without a tilt are not picked; other splits aren't either.

    A compound's n-th pick is the n-th of its rows that may be picked, whatever the others do; so picks are found video by video, numbered within their compound, and cut at the quota.

    All rows are looked at, but few videos are gone through row by row: the best row of a video without picks can always be picked, so where n are wanted, none comes from a video whose best row
    is behind those of n such videos. Videos with tilted picks are not more than that quota; so unsure rows come from as many videos as both quotas together.
    """
    order = F.concat_ws(":", F.lit(str(seed)), "split", "video_id", F.col("frame_idx").cast("string"))
    long, tilt = F.col("frame_idx").cast("long").alias("frame_idx"), F.col("tilt").cast("double")
    wanted = (("tilted", tilt >= tilted), ("unsure", (tilt >= unsure[0]) & (tilt < unsure[1])))
    good = scanned.where((F.col("box_score") >= least_score) & F.col("tilt").isNotNull() & ~F.isnan("tilt") & F.col("split").isin(*quotas) & (wanted[0][1] | wanted[1][1]))
    good = good.select("video_id", long, F.col("fps").cast("double").alias("fps"), "compound", "split", tilt.alias("tilt"), F.lit(0).alias("kind"))
    good = written(_unguarded(good, annotated.select("video_id", long), guard_s), "offered")
    ranks = (F.struct((-F.col("tilt")).alias("a"), F.lit("").alias("b"), "video_id", "frame_idx"), F.struct(F.lit(0.0).alias("a"), F.sha2(order, 256).alias("b"), "video_id", "frame_idx"))
    taken, out = None, None
    for n, ((reason, keep), rank) in enumerate(zip(wanted, ranks, strict=True)):
        met = _first_videos(good.where(keep).withColumn("rank", rank), {split: sum(both[: n + 1]) for split, both in quotas.items()})
        met = met if taken is None else met.unionByName(taken.withColumn("kind", F.lit(2)), allowMissingColumns=True)
        free = _free_picks(met, gap_s, per_video)
        quota = _by_split({split: both[n] for split, both in quotas.items()})
        turn = F.row_number().over(Window.partitionBy("split", "compound").orderBy("rank"))
        turns = free.withColumn("turn", turn).where(F.col("turn") <= quota)  # no compound can give more
        nth = F.row_number().over(Window.partitionBy("split").orderBy("turn", "compound"))
        picks = written(turns.withColumn("nth", nth).where(F.col("nth") <= quota).select("video_id", "frame_idx", "split", F.lit(reason).alias("reason"), "tilt", "turn"), "picks")
        taken = picks.select("video_id", "frame_idx")
        out = picks if out is None else out.unionByName(picks)
    return out
