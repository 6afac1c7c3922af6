"""Runs of consecutive rows (gaps and islands) over one window per subject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Key = str | list[str]  # what tells subjects apart; several columns where a subject comes more than once, as once a set of parameters


def names(key: Key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def by_time(key: Key = "video_id", order: str = "frame_idx"):
    return Window.partitionBy(*names(key)).orderBy(order)


def with_island(df: DataFrame, breaks: Column, name: str = "island", key: Key = "video_id", order: str = "frame_idx") -> DataFrame:
    """``name`` numbers the runs: it rises by one on every row where ``breaks`` is true."""
    running = by_time(key, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.when(breaks, 1).otherwise(0)).over(running))


def adjacent(key: Key = "video_id", order: str = "frame_idx") -> Column:
    """The row's index follows that of the row before it; false on the first row."""
    return F.coalesce(F.col(order) - F.lag(order).over(by_time(key, order)) == 1, F.lit(False))


def holding_runs(df: DataFrame, holds: str, name: str = "run", key: Key = "video_id") -> DataFrame:
    """Run numbers of rows where ``holds``; a row that doesn't hold, or an index gap, ends a run."""
    before = F.coalesce(F.lag(holds).over(by_time(key)), F.lit(False))
    return with_island(df, ~(F.col(holds) & before & adjacent(key)), name, key)


def run_length(df: DataFrame, name: str = "run_length") -> DataFrame:
    """Position inside the run of detected rows with adjacent indices; 0 where nothing is detected. Adds ``run`` too."""
    out = holding_runs(df, "detected")
    place = F.row_number().over(Window.partitionBy("video_id", "run").orderBy("frame_idx"))
    return out.withColumn(name, F.when(F.col("detected"), place).otherwise(0))


def sustained(df: DataFrame, holds: str, least_s: float | Column, name: str, key: Key = "video_id") -> DataFrame:
    """Every row of a run of ``holds`` that spans ``least_s`` of time or more."""
    out = holding_runs(df, holds, "__run", key)
    w = Window.partitionBy(*names(key), "__run")
    span = F.max("t_sec").over(w) - F.min("t_sec").over(w)
    return out.withColumn(name, F.col(holds) & (span >= least_s)).drop("__run")


def terminal_run(df: DataFrame, holds: str, least_s: float | Column, name: str, key: Key = "video_id") -> DataFrame:
    """The rows of the run of ``holds`` that ends on the subject's last row, if it spans ``least_s`` or more."""
    out = holding_runs(df, holds, "__run", key)
    every = Window.partitionBy(*names(key))
    run = Window.partitionBy(*names(key), "__run")
    out = out.withColumn("__last", F.max("__run").over(every))
    span = F.max("t_sec").over(run) - F.min("t_sec").over(run)
    return out.withColumn(name, (F.col("__run") == F.col("__last")) & F.col(holds) & (span >= least_s)).drop("__run", "__last")
