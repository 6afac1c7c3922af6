"""Overlapping windows over an unbounded track."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_sliding(rows: DataFrame, width: str, step: str, late: str = "10 seconds") -> DataFrame:
    """Rows and mean score of each (video_id, window of ``width`` begun every ``step``); ``rows`` may be a stream or a table.

    A row enters width / step windows before the partial aggregate, so the shuffle carries open windows, not rows.
    """
    marked = rows.withWatermark("ts", late) if rows.isStreaming else rows
    got = marked.groupBy("video_id", F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"))
    return got.select("video_id", F.col("w.start").alias("start"), "n", "mean_score")
