"""Keyed state with timers on streams: leases, staleness and liveness, and an orderly end. The lives of tasks are in `lifecycle`, keys that
were ever seen in `operators.seen`.

The batch forms of these are plain filters (`transitions.maintenance`, `scheduling.free_slots`); these keep their state in
Spark's state store and use event time, so that a run over stored events gives the same as one that follows them live.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def expiring(beats: DataFrame, ttl_seconds: int, delay: str = "0 seconds", key: str = "key", when: str = "ts") -> DataFrame:
    """key, state and at: `live` with a key's first beat, `expired` ttl after its last once the watermark has passed that; a later beat is live again.

    A lease has a ttl of max(300, stale + 60) seconds, a task is stale after 180, a worker offline after 60."""

    def step(keys: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        row = lambda kind, at: pd.DataFrame({"key": [keys[0]], "state": [kind], "at": [at]})
        ttl = pd.Timedelta(seconds=ttl_seconds)
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield row("expired", pd.Timestamp(last) + ttl)
            return
        beats = sorted(t for frame in frames for t in frame["ts"])
        last = pd.Timestamp(state.get[0]) if state.exists else None
        for t in beats:
            if last is None:
                yield row("live", t)
            elif t > last + ttl:  # it had expired before the watermark told
                yield row("expired", last + ttl)
                yield row("live", t)
            last = t if last is None else max(last, t)
        ends = last + ttl
        if ends.value // 1_000_000 <= state.getCurrentWatermarkMs():
            if state.exists:
                state.remove()
            yield row("expired", ends)
            return
        state.update((last.to_pydatetime(),))
        state.setTimeoutTimestamp(ends.value // 1_000_000)

    rows = beats.select(F.col(key).cast("string").alias("key"), F.col(when).cast("timestamp").alias("ts")).withWatermark("ts", delay)
    return rows.groupBy("key").applyInPandasWithState(step, "key string, state string, at timestamp", "last timestamp", "append", GroupStateTimeout.EventTimeTimeout)


def drain(query: StreamingQuery, seconds: float = 60) -> None:
    """Stops between two micro-batches, or after so many seconds at the latest: what was begun is finished, nothing new is taken."""
    end = time.monotonic() + seconds
    while query.isActive and query.status["isTriggerActive"] and time.monotonic() < end:
        time.sleep(0.05)
    query.stop()
