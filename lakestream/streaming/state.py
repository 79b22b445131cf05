"""Custom keyed state with timers: sessions that close after a time without events."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# the processor travels with its query, so workers need not have this package installed
register_pickle_by_value(sys.modules[__name__])

SESSION_SCHEMA = "user_id long, first_ms long, last_ms long, n long"


class SessionTimeout(StatefulProcessor):
    """Merge time slices of a key into sessions; emit a session once its timeout has passed.

    Input rows are slices ``(first_ms, last_ms, n)`` pre-aggregated on the map side, so a busy key brings few
    rows. State holds the open sessions only, as one value with one timer per key. A session stays open for one
    slice length beyond its timeout: a slice that still belongs to it may end, and so be sent, that much later.
    """

    def __init__(self, timeout_ms: int, slice_ms: int):
        self.timeout_ms = timeout_ms
        self.wait_ms = timeout_ms + slice_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "first_ms array<long>, last_ms array<long>, n array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        slices = self._stored()
        for pdf in rows:
            slices += zip(pdf["first_ms"].tolist(), pdf["last_ms"].tolist(), pdf["n"].tolist())
        merged: list[tuple[int, int, int]] = []
        for first, last, n in sorted(slices):
            if merged and first - merged[-1][1] < self.timeout_ms:
                begin, end, count = merged.pop()
                first, last, n = begin, max(end, last), count + n
            merged.append((first, last, n))
        return self._settle(key, merged, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._settle(key, self._stored(), timerValues.getCurrentWatermarkInMs())

    def _stored(self) -> list[tuple[int, int, int]]:
        return list(zip(*self.open.get())) if self.open.exists() else []

    def _settle(self, key, sessions: list[tuple[int, int, int]], watermark: int) -> Iterator[pd.DataFrame]:
        """Emit what is over, keep the rest, and wake up when the next session can be over."""
        waiting = [s for s in sessions if s[1] + self.wait_ms > watermark]
        if waiting:
            self.open.update(tuple(list(column) for column in zip(*waiting)))
            self.handle.registerTimer(min(last for _, last, _ in waiting) + self.wait_ms)
        else:
            self.open.clear()
        closed = [(key[0], *s) for s in sessions if s[1] + self.wait_ms <= watermark]
        if closed:
            yield pd.DataFrame(closed, columns=["user_id", "first_ms", "last_ms", "n"])

    def close(self) -> None:
        pass


def session_timeout(stream: DataFrame, ts: str, timeout_ms: int, late: str, slice_seconds: int) -> DataFrame:
    """Closed sessions per ``user_id`` of an event stream.

    Events are counted per key and short time slice first. A slice must be shorter than the timeout, so two
    events of one slice always share a session.
    """
    if slice_seconds * 1000 >= timeout_ms:
        raise ValueError("slices must be shorter than the timeout")
    at = F.unix_millis(F.col(ts))
    slices = (
        stream.withWatermark(ts, late)
        .groupBy("user_id", F.window(ts, f"{slice_seconds} seconds"))
        .agg(F.min(at).alias("first_ms"), F.max(at).alias("last_ms"), F.count("*").alias("n"))
        .select("user_id", F.window_time("window").alias(ts), "first_ms", "last_ms", "n")
    )
    return slices.groupBy("user_id").transformWithStateInPandas(
        SessionTimeout(timeout_ms, slice_seconds * 1000), SESSION_SCHEMA, outputMode="Append", timeMode="EventTime"
    )
