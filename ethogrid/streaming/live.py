"""Streaming twins: bin votes and hit sessions over an unbounded track, and a stateful tracker."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ethogrid.operators.labeling import bin_winner
from ethogrid.schemas import STATES


def stream_bins(rows: DataFrame, width: str = "1 second", late: str = "10 seconds", min_determined: float = 0.5) -> DataFrame:
    """One state for each (video_id, tumbling window of ``ts``), emitted when the watermark passes it.

    ``rows`` (video_id, ts, state) may be a stream or a table; both give the same bins. State held: counts of open windows only.
    """
    counts = [F.count_if(F.col("state") == s).alias(f"n_{i}") for i, s in enumerate(STATES)]
    marked = rows.withWatermark("ts", late) if rows.isStreaming else rows
    got = marked.groupBy("video_id", F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), *counts)
    return got.select("video_id", F.col("w.start").alias("start"), "n", bin_winner(min_determined).alias("state"))


def stream_sessions(rows: DataFrame, gap: str, late: str = "10 seconds", least: int = 1) -> DataFrame:
    """Sessions of hits of ``rows`` (video_id, ts, score) that are less than ``gap`` apart."""
    marked = rows.withWatermark("ts", late) if rows.isStreaming else rows
    got = marked.groupBy("video_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.max("score").alias("max_score"))
    return got.where(F.col("n") >= least).select("video_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "max_score")


def accept_positions(rows: list[tuple], state: tuple | None, max_jump: float, max_missed: int) -> tuple[list[tuple], tuple]:
    """Jump rejection for one subject's (frame_idx, x, y) in order, x null where nothing is seen.

    A position is accepted if there is no anchor or it is within ``max_jump`` of it; after ``max_missed`` misses in a row the anchor is dropped.
    """
    ax, ay, missed = state or (None, None, 0)
    out = []
    for idx, x, y in rows:
        ok = x is not None and (ax is None or ((x - ax) ** 2 + (y - ay) ** 2) ** 0.5 <= max_jump)
        if ok:
            ax, ay, missed = x, y, 0
        else:
            missed += 1
            if missed >= max_missed:
                ax = ay = None
        out.append((idx, x if ok else 0.0, y if ok else 0.0, ok))
    return out, (ax, ay, missed)


SCHEMA = "video_id string, frame_idx int, x double, y double, detected boolean"


def _rows(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf.sort_values("frame_idx")
    return [(int(i), None if pd.isna(x) else float(x), None if pd.isna(y) else float(y)) for i, x, y in zip(pdf["frame_idx"], pdf["x"], pdf["y"], strict=True)]


def reject_jumps(rows: DataFrame, max_jump: float, max_missed: int = 30) -> DataFrame:
    """Batch form over whole subjects; each row depends on what was accepted before it, so a subject goes through one function."""

    def run(key, pdf):
        got, _ = accept_positions(_rows(pdf), None, max_jump, max_missed)
        return pd.DataFrame([(key[0], *r) for r in got], columns=["video_id", "frame_idx", "x", "y", "detected"])

    return rows.select("video_id", "frame_idx", "x", "y").groupBy("video_id").applyInPandas(run, SCHEMA)


def stream_reject_jumps(rows: DataFrame, max_jump: float, max_missed: int = 30) -> DataFrame:
    """Streaming form: anchor and misses of each subject are kept as state between batches."""

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = None
        if state.exists:
            ax, ay, missed = state.get
            old = (None if ax is None else ax, None if ay is None else ay, missed)
        got, new = accept_positions(_rows(pd.concat(list(parts))), old, max_jump, max_missed)
        state.update(new)
        yield pd.DataFrame([(key[0], *r) for r in got], columns=["video_id", "frame_idx", "x", "y", "detected"])

    chosen = rows.select("video_id", "frame_idx", "x", "y").groupBy("video_id")
    return chosen.applyInPandasWithState(run, SCHEMA, "ax double, ay double, missed int", "append", GroupStateTimeout.NoTimeout)
