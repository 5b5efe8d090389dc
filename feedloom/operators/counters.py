"""What a write has seen, counted while it is written: no second pass over the rows, in batches and in streams."""

from __future__ import annotations

import threading
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import QueryIdleEvent, QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

NAMES = ("seen", "assets", "characters", "bytes")


def measures(content: str = "content", assets: str | None = "assets") -> list[Column]:
    """Records, their assets (an array; null has none), and the characters and UTF-8 bytes of their contents; 0 of nothing."""
    total = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    held = total(F.when(F.col(assets).isNotNull(), F.size(assets)).otherwise(0)) if assets else F.lit(0).cast("long")
    return [F.count(F.lit(1)).alias("seen"), held.alias("assets"), total(F.length(content)).alias("characters"), total(F.octet_length(content)).alias("bytes")]


def written(rows: DataFrame, write: Callable[[DataFrame], Any], *counted: Column) -> dict[str, int]:
    """Has the rows written once, and returns what was counted of them on the way. A task that runs twice counts once.

    What `write` does must take all rows in one job: a limit would count less, a second job is not looked at."""
    seen = Observation()
    write(rows.observe(seen, *(counted or measures())))
    return dict(seen.get)


class StreamCounters(StreamingQueryListener):
    """Adds up what the micro-batches of streams count under a name (see `counting`)."""

    def __init__(self, name: str):
        self.name, self.lock = name, threading.Lock()
        self.total: dict[str, int] = {}
        self.batches: set[tuple[str, int]] = set()

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        pass

    def onQueryIdle(self, event: QueryIdleEvent) -> None:
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        pass

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        found = event.progress.observedMetrics.get(self.name)
        batch = (str(event.progress.id), event.progress.batchId)
        with self.lock:
            if found is None or batch in self.batches:
                return
            self.batches.add(batch)
            for k, v in found.asDict().items():
                self.total[k] = self.total.get(k, 0) + (v or 0)


def counting(stream: DataFrame, name: str, *counted: Column) -> DataFrame:
    """The stream, its micro-batches counted under the name."""
    return stream.observe(name, *(counted or measures()))
