"""Structured Streaming forms of the filter, coverage, segmentation and dedupe operators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from strandline.operators.filters import first_failure
from strandline.operators.signal import next_cuts


def filter_reasons(stream: DataFrame, rules: Sequence[tuple[str, Column]], ts: str = "ts", width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts per tumbling window and first failing rule (``pass`` when none fails)."""
    return (
        stream.withWatermark(ts, late)
        .groupBy(F.window(ts, width), F.coalesce(first_failure(rules), F.lit("pass")).alias("reason"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "reason", "n")
    )


def passing(stream: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    return stream.where(first_failure(rules).isNull())


def coverage(
    stream: DataFrame, keys: Sequence[str], ts: str = "ts", width: str = "1 hour", slide: str | None = None, late: str = "1 hour"
) -> DataFrame:
    """Events per key and tumbling (or sliding) window."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return (
        stream.withWatermark(ts, late).groupBy(*keys, w).agg(F.count(F.lit(1)).alias("depth"))
        .select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "depth")
    )


def session_islands(stream: DataFrame, keys: Sequence[str], ts: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Islands of activity: events closer than the gap belong together."""
    return (
        stream.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, gap)).agg(F.count(F.lit(1)).alias("n"))
        .select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
    )


def dedupe_first_wins(stream: DataFrame, key: Sequence[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """First arrival per key inside the watermark; state is dropped once the watermark passes."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(key))


_TAIL = StructType([StructField("pos", LongType()), StructField("p", DoubleType())])
SEGMENTS = StructType([
    StructField("k", StringType()), StructField("start", LongType()), StructField("end", LongType()), StructField("kind", StringType()),
])


class SegmentProcessor(StatefulProcessor):
    """Cut regions of one key as positions arrive.

    A list state holds the positions not yet emitted, at most ``max_size + lookahead`` of them plus a batch.
    A region leaves only when that many are buffered, so later arrivals cannot change it. A jump in position,
    or no news for ``idle_ms``, flushes. Positions behind the frontier come out as kind ``late``.
    """

    def __init__(self, threshold: float, min_size: int, max_size: int, lookahead: int, idle_ms: int):
        self.threshold, self.min_size, self.max_size = threshold, min_size, max_size
        self.lookahead, self.idle_ms = lookahead, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tail = handle.getListState("tail", _TAIL)
        self.frontier = handle.getValueState("frontier", StructType([StructField("next", LongType())]))

    def _cut(self, pos: np.ndarray, p: np.ndarray, flush: bool) -> tuple[list[tuple[int, int, str]], int]:
        out, i, n = [], 0, len(pos)
        need = self.max_size + self.lookahead
        act = p > self.threshold
        while i < n and (flush or n - i >= need):
            room = act[i : i + self.max_size]
            change = np.flatnonzero(room != act[i])
            size = int(change[0]) if len(change) else len(room)
            if act[i] and size == self.max_size:
                size = int(next_cuts(p[i:], 1, self.min_size, self.max_size)[0])
            out.append((int(pos[i]), int(pos[i + size - 1]), "active" if act[i] else "inactive"))
            i += size
        return out, i

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = list(self.tail.get()) if self.tail.exists() else []
        front = self.frontier.get()[0] if self.frontier.exists() else None
        new = pd.concat(list(rows)).sort_values("pos")
        late = new[new["pos"] < front] if front is not None else new.iloc[:0]
        new = new[new["pos"] >= front] if front is not None else new
        pos = np.array([h[0] for h in held] + new["pos"].tolist(), dtype=np.int64)
        p = np.array([h[1] for h in held] + new["prob"].tolist(), dtype=float)
        order = np.argsort(pos, kind="stable")
        pos, p = pos[order], p[order]
        out = [(int(x), int(x), "late") for x in late["pos"]]
        breaks = np.flatnonzero(np.diff(pos) != 1) + 1
        parts = np.split(np.arange(len(pos)), breaks)
        for j, idx in enumerate(parts):
            got, used = self._cut(pos[idx], p[idx], flush=j < len(parts) - 1)
            out += got
        rest = parts[-1][used:] if len(pos) else np.array([], dtype=int)
        self.tail.put([(int(pos[i]), float(p[i])) for i in rest])
        if len(pos):
            self.frontier.update((int(pos[rest[0]]) if len(rest) else int(pos[-1]) + 1,))
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        if len(rest):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = list(self.tail.get()) if self.tail.exists() else []
        pos, p = np.array([h[0] for h in held], dtype=np.int64), np.array([h[1] for h in held], dtype=float)
        out, _ = self._cut(pos, p, flush=True) if len(pos) else ([], 0)
        if len(pos):
            self.frontier.update((int(pos[-1]) + 1,))
        self.tail.clear()
        yield self._frame(key, out)

    def _frame(self, key, out) -> pd.DataFrame:
        return pd.DataFrame([(str(key[0]), *o) for o in out], columns=["k", "start", "end", "kind"])

    def close(self) -> None:
        pass


def segment_stream(
    stream: DataFrame, key: str, threshold: float = 0.002, min_size: int = 50, max_size: int = 300, lookahead: int = 100, idle_ms: int = 60_000
) -> DataFrame:
    """Incremental segmentation of ``key, pos, prob``; needs the RocksDB state store."""
    return stream.select(F.col(key).cast("string").alias("k"), F.col("pos").cast("long"), F.col("prob").cast("double")).groupBy("k").transformWithStateInPandas(
        statefulProcessor=SegmentProcessor(threshold, min_size, max_size, lookahead, idle_ms), outputStructType=SEGMENTS,
        outputMode="Append", timeMode="ProcessingTime",
    )
