"""Rolling windows over an unbounded track: velocity, meander and immobility with rows in event time, timers and state that expires."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "video_id string, frame_idx int, t_sec double, velocity double, velocity_valid boolean, meander double, is_immobile boolean"
_WAITING = "ms bigint, frame_idx int, t_sec double, x double, y double, detected boolean"
_TAIL = "frame_idx int, t_sec double, x double, y double, detected boolean, run bigint, heading double, turn double, dist double, slow boolean"


def rolled(rows: list[tuple], tail: list[tuple], window: int, floor: float, still: int) -> tuple[list[tuple], list[tuple]]:
    """Features of (frame_idx, t_sec, x, y, detected) in order, and the new tail: the last rows that later ones need (of ``_TAIL``)."""
    last: deque = deque(tail, maxlen=max(window, still))
    out = []
    for frame, t, x, y, detected in rows:
        p = last[-1] if last else None
        follows = p is not None and p[4] and frame == p[0] + 1
        run = 0 if not detected else p[5] + 1 if follows else 1
        dx, dy = (x - p[2], y - p[3]) if run >= 2 else (0.0, 0.0)
        dist = math.hypot(dx, dy)
        dt = t - p[1] if p is not None else 0.0
        valid = run >= 2 and dt > 0
        v = dist / dt if valid else 0.0
        heading = math.degrees(math.atan2(dy, dx)) if run >= 2 else None
        turn = abs((heading - p[6] + 180.0) % 360.0 - 180.0) if run >= 3 else None
        last.append((frame, t, x, y, detected, run, heading, turn, dist if run >= 2 else None, valid and v <= floor))
        own = list(last)[-min(window, run) :] if run else []
        total = sum(r[8] for r in own if r[8] is not None)
        meander = sum(r[7] for r in own if r[7] is not None) / total if total > 1e-9 else 0.0
        slow = list(last)[-still:]
        out.append((frame, t, v, valid, meander, len(slow) == still and all(r[9] for r in slow)))
    return out, list(last)


class RollingFeatures(StatefulProcessor):
    """Rows wait until the watermark has passed them, so late ones fall into place; a subject without rows for ``idle_ms`` of event time loses its state."""

    def __init__(self, window: int, floor: float, still: int, idle_ms: int):
        self.window, self.floor, self.still, self.idle_ms = window, floor, still, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.tail = handle.getListState("tail", _TAIL)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for pdf in rows:
            ms = pdf["ts"].astype("datetime64[ms]").astype("int64")
            new += [(int(m), int(f), float(t), float(x), float(y), bool(d)) for m, f, t, x, y, d in zip(ms, pdf["frame_idx"], pdf["t_sec"], pdf["x"], pdf["y"], pdf["detected"], strict=True)]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(max(r[0] for r in new) + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        ready = sorted((r for r in waiting if r[0] < now), key=lambda r: (r[0], r[1]))
        if not ready:
            if not waiting:  # the timer of an idle subject
                self.tail.clear()
            return
        left = [r for r in waiting if r[0] >= now]
        if left:
            self.waiting.put(left)
        else:
            self.waiting.clear()
            self.handle.registerTimer(ready[-1][0] + self.idle_ms)
        out, tail = rolled([r[1:] for r in ready], [tuple(r) for r in self.tail.get()] if self.tail.exists() else [], self.window, self.floor, self.still)
        self.tail.put(tail)
        yield pd.DataFrame([(key[0], *r) for r in out], columns=["video_id", "frame_idx", "t_sec", "velocity", "velocity_valid", "meander", "is_immobile"])

    def close(self) -> None:
        pass


def stream_rolling(rows: DataFrame, window: int, floor: float, still: int, late: str = "10 seconds", idle_s: float = 3600.0) -> DataFrame:
    """Velocity, meander over ``window`` rows and immobility over ``still`` rows of a stream (video_id, ts, frame_idx, t_sec, x, y, detected), as the batch operators give them.

    Rows may come up to ``late`` after later ones; older ones are dropped. Output is final and appended once the watermark has passed a row. State of a subject: rows that wait, and the last few
    done; it goes after ``idle_s`` of event time without rows (longer than any pause after which windows must go on). Needs the RocksDB state store (:func:`use_state_store`).
    """
    chosen = rows.select("video_id", "ts", "frame_idx", "t_sec", "x", "y", "detected").withWatermark("ts", late)
    return chosen.groupBy("video_id").transformWithStateInPandas(RollingFeatures(window, floor, still, int(idle_s * 1000)), OUTPUT, "Append", "EventTime")


def use_state_store(spark) -> None:
    """Sets the session's state store to the one that stateful processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
