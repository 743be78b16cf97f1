"""Keyed state over streams: last value with a lifetime, fixed windows from the first hit."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def merged(old: str | None, new: str | None) -> str | None:
    """Two JSON objects, the later keys winning; anything else replaces."""
    if old is None or new is None:
        return new if new is not None else old
    try:
        a, b = json.loads(old), json.loads(new)
    except ValueError:
        return new
    return json.dumps({**a, **b}, sort_keys=True) if isinstance(a, dict) and isinstance(b, dict) else new


def last_known(events: DataFrame, ttl_seconds: int = 3_600, late: str = "10 minutes") -> DataFrame:
    """``(key, payload, updated_at)`` per key of ``(key, ts, payload)``, in update mode.

    Payloads are merged key by key; a key that was silent for the lifetime, by
    event time, is forgotten.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        payload, at = state.get if state.exists else (None, None)
        for pdf in frames:
            for ts, new in sorted(zip(pdf["ts"], pdf["payload"]), key=lambda r: (r[0], r[1] or "")):
                now = ts.timestamp()
                if at is not None and now - at > ttl_seconds:
                    payload = None
                if at is None or now >= at:
                    payload, at = merged(payload, new), now
                else:
                    payload = merged(new, payload)
        state.update((payload, at))
        state.setTimeoutTimestamp(max(int((at + ttl_seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [key[0]], "payload": [payload], "updated_at": [at]})

    rows = events.select(F.col("key").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "payload").withWatermark("ts", late)
    return rows.groupBy("key").applyInPandasWithState(step, "key string, payload string, updated_at double", "payload string, updated_at double", "update", GroupStateTimeout.EventTimeTimeout)


def rate_limited(events: DataFrame, limit: int, window_seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """``(key, id, allowed)`` of ``(key, ts, id)``: at most ``limit`` a window, windows begin with their first hit."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, count = state.get if state.exists else (None, 0)
        out = []
        for ts, i in sorted((r for pdf in frames for r in zip(pdf["ts"], pdf["id"])), key=lambda r: (r[0], r[1])):
            now = ts.timestamp()
            if start is None or now >= start + window_seconds:
                start, count = now, 0
            count += 1
            out.append((key[0], i, count <= limit))
        if start is not None:
            state.update((start, count))
            state.setTimeoutTimestamp(max(int((start + window_seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "id", "allowed"])

    rows = events.select(F.col("key").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("id").cast("long").alias("id")).withWatermark("ts", late)
    return rows.groupBy("key").applyInPandasWithState(step, "key string, id long, allowed boolean", "start double, hits long", "append", GroupStateTimeout.EventTimeTimeout)
