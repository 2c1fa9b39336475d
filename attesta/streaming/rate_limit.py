"""Sliding-log rate limit per key: at most ``limit`` accepted events within ``window`` seconds; rejected events are not logged.

The batch form and the streaming form share one step. State of a key is its log of accepted times, at
most ``limit`` long; in a stream it expires when the window has passed.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, WINDOW_SECONDS = 20, 60.0
SCHEMA = "key string, event_id long, t double, allowed boolean, wait double"


def step(log: deque, t: float, limit: int, window: float) -> tuple[bool, float]:
    """Whether an event at ``t`` passes, and how long to wait if not; the log is kept up to date."""
    while log and t - log[0] >= window:
        log.popleft()
    if len(log) >= limit:
        return False, max(window - (t - log[0]), 0.0)
    log.append(t)
    return True, 0.0


def batch(events: DataFrame, limit: int = LIMIT, window: float = WINDOW_SECONDS) -> DataFrame:
    """Decisions for all events (``key``, ``event_id``, ``t`` in seconds), in order of time and identifier.

    A partition sorted by key streams through one log at a time: no key's events are gathered.
    """
    if limit < 1:
        raise ValueError("a quota below one closes the service")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, log = None, deque()
        for b in batches:
            out = []
            for k, t in zip(b["key"], b["t"], strict=True):
                if k != key:
                    key, log = k, deque()
                out.append(step(log, t, limit, window))
            yield b.assign(allowed=[a for a, _ in out], wait=[w for _, w in out])

    ordered = events.select(F.col("key").cast("string").alias("key"), F.col("event_id").cast("long").alias("event_id"), F.col("t").cast("double").alias("t")).repartition("key").sortWithinPartitions("key", "t", "event_id")
    return ordered.mapInPandas(run, SCHEMA)


def stream(events: DataFrame, limit: int = LIMIT, window: float = WINDOW_SECONDS) -> DataFrame:
    """The same over a stream (``key``, ``event_id``, ``ts`` timestamp with a watermark): keyed state with a timeout."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = deque(state.get[0] if state.exists else [])
        rows = pd.concat(list(frames))
        rows = rows.assign(t=rows["ts"].astype("int64") / 1e9 if str(rows["ts"].dtype).startswith("datetime64[ns") else rows["ts"].map(lambda x: x.timestamp())).sort_values(["t", "event_id"])
        out = [step(log, t, limit, window) for t in rows["t"]]
        state.update((list(log),))
        mark = state.getCurrentWatermarkMs()
        state.setTimeoutTimestamp(max(mark + 1, int((log[-1] + window) * 1000)) if log else mark + 1)
        yield pd.DataFrame({"key": key[0], "event_id": rows["event_id"].to_numpy(), "t": rows["t"].to_numpy(), "allowed": [a for a, _ in out], "wait": [w for _, w in out]})

    return events.groupBy("key").applyInPandasWithState(run, SCHEMA, "log array<double>", "append", GroupStateTimeout.EventTimeTimeout)
