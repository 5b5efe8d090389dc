"""A task's life as a stateful processor: claims, heartbeats, lost leases, retries after their delay, and nothing left at the end.

Events of a task are taken in the order of their times. What falls due between
two of them (a lease that no heartbeat has renewed, a retry whose delay is over)
happens at its own time, whether the next event or the watermark tells of it. So
however the events are cut into micro-batches the steps are those of `replay`,
the batch form. A task lives from its `submit` to its end, when its state and
timers go; events of other tasks are ignored.

Times are milliseconds. Of the state a task's status and attempts, its lease and
its delay are variables of their own: the one that isn't there isn't stored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from feedloom.functions import expr

#: Seconds without a heartbeat after which a lease is lost, and until such a task may be claimed again.
STALE, AGAIN = 180, 15
EVENT = ("task_id", "ts", "seq", "kind", "worker", "error_class", "retry_after")
STEP = "task_id long, t long, step string, attempts int, worker string"


class Task(NamedTuple):
    status: str  # pending, running or retry
    attempts: int = 0
    worker: str | None = None  # of the lease
    beat: int = 0
    due: int = 0  # when a retry may be claimed


class Step(NamedTuple):
    t: int
    step: str
    attempts: int
    worker: str | None


@dataclass(frozen=True)
class Rules:
    most_attempts: int = 3
    base_seconds: float = 30
    most_seconds: float = 3600
    stale_seconds: float = STALE
    again_seconds: float = AGAIN

    def delay(self, attempts: int, asked: float | None) -> int:
        """Milliseconds until a failed task may be claimed again: what the other side asks for, else doubled with each attempt."""
        seconds = max(0.0, asked) if asked is not None else self.base_seconds * 2 ** min(max(0, attempts - 1), 60)
        return int(1000 * min(self.most_seconds, seconds))

    def deadline(self, task: Task) -> int | None:
        """From when on something is due."""
        if task.status == "running":
            return task.beat + int(1000 * self.stale_seconds) + 1
        return task.due if task.status == "retry" else None

    def settle(self, task: Task, until: int) -> tuple[Task, list[Step]]:
        """What falls due up to a time."""
        steps: list[Step] = []
        while (at := self.deadline(task)) is not None and at <= until:
            if task.status == "running":
                steps.append(Step(at - 1, "lost", task.attempts, task.worker))
                task = Task("retry", task.attempts, due=at - 1 + int(1000 * self.again_seconds))
            else:
                steps.append(Step(at, "ready", task.attempts, None))
                task = Task("pending", task.attempts)
        return task, steps

    def take(self, task: Task | None, e: Any) -> tuple[Task | None, list[Step]]:
        """The task after an event, None once it has ended, and its steps."""
        if task is None:
            return (Task("pending"), [Step(e.t, "submitted", 0, None)]) if e.kind == "submit" else (None, [])
        task, steps = self.settle(task, e.t)
        if e.kind == "claim" and task.status == "pending":
            task = Task("running", task.attempts + 1, e.worker, e.t)
            return task, [*steps, Step(e.t, "claimed", task.attempts, e.worker)]
        if task.status != "running" or e.worker != task.worker:
            return task, steps
        if e.kind == "beat":
            return task._replace(beat=e.t), steps
        if e.kind == "complete":
            return None, [*steps, Step(e.t, "done", task.attempts, e.worker)]
        if e.kind == "fail":
            if e.error_class not in expr.RETRYABLE or task.attempts >= self.most_attempts:
                return None, [*steps, Step(e.t, "dead", task.attempts, e.worker)]
            return Task("retry", task.attempts, due=e.t + self.delay(task.attempts, e.retry_after)), [*steps, Step(e.t, "retry", task.attempts, e.worker)]
        return task, steps


def in_order(rows: pd.DataFrame) -> Iterator[Any]:
    for e in rows.sort_values(["t", "seq"], kind="stable").itertuples(index=False):
        yield e._replace(worker=None if pd.isna(e.worker) else e.worker, retry_after=None if pd.isna(e.retry_after) else e.retry_after)


def steps_frame(task_id: int, steps: list[Step]) -> pd.DataFrame:
    rows = [(task_id, *s) for s in steps]
    return pd.DataFrame(rows, columns=["task_id", "t", "step", "attempts", "worker"]).astype({"task_id": "int64", "t": "int64", "attempts": "int32"})


class Lifecycle(StatefulProcessor):
    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", "status string, attempts int")
        self.lease = handle.getValueState("lease", "worker string, beat long")
        self.delay = handle.getValueState("delay", "due long")

    def known(self) -> Task | None:
        if not self.life.exists():
            return None
        status, attempts = self.life.get()
        worker, beat = self.lease.get() if self.lease.exists() else (None, 0)
        return Task(status, attempts, worker, beat, self.delay.get()[0] if self.delay.exists() else 0)

    def keep(self, before: Task | None, task: Task | None) -> None:
        """Writes what has changed; the timer is always that of the next deadline."""
        if before == task:
            return
        for state, value in ((self.life, task and (task.status, task.attempts)), (self.lease, (task.worker, task.beat) if task and task.status == "running" else None), (self.delay, (task.due,) if task and task.status == "retry" else None)):
            if value:
                state.update(value)
            elif state.exists():
                state.clear()
        old, new = (t and self.rules.deadline(t) for t in (before, task))
        if old != new:
            if old is not None and old in set(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            if new is not None:
                self.handle.registerTimer(new)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        before = task = self.known()
        steps: list[Step] = []
        for e in in_order(pd.concat(list(rows))):
            task, more = self.rules.take(task, e)
            steps += more
        self.keep(before, task)
        if steps:
            yield steps_frame(key[0], steps)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        before = self.known()
        if before is not None:
            task, steps = self.rules.settle(before, timerValues.getCurrentWatermarkInMs())
            self.keep(before, task)
            if steps:
                yield steps_frame(key[0], steps)

    def close(self) -> None:
        pass


def prepared(events: DataFrame) -> DataFrame:
    return events.select("task_id", F.col("ts").cast("timestamp").alias("ts"), F.unix_millis(F.col("ts").cast("timestamp")).alias("t"), "seq", "kind", "worker", "error_class", F.col("retry_after").cast("double").alias("retry_after"))


def lives(events: DataFrame, rules: Rules = Rules(), delay: str = "0 seconds") -> DataFrame:
    """The steps (task_id, t, step, attempts, worker) of a stream of events (EVENT); submitted, claimed, lost, retry, ready, done and dead.

    kinds: submit, claim, beat, complete and fail. Events may be late by `delay`, but those of a task must come in order of
    time. The state is in RocksDB, so spark.sql.streaming.stateStore.providerClass is set to it."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = prepared(events).withWatermark("ts", delay)
    return rows.groupBy("task_id").transformWithStateInPandas(Lifecycle(rules), STEP, "Append", "eventtime")


def replay(events: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The same steps of stored events, up to the time of the last one. A task's events are one task's stream, sorted on disk."""
    rows = prepared(events)
    last = rows.agg(F.max("t").alias("last"))  # one row
    ordered = rows.crossJoin(F.broadcast(last)).drop("ts").repartition("task_id").sortWithinPartitions("task_id", "t", "seq")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: tuple[int, Task | None, int] | None = None  # the task, its state and the end of time
        for frame in frames:
            found: list[tuple] = []
            for task_id, own in frame.groupby("task_id", sort=False):
                if now is not None and now[0] != task_id:
                    found += [(now[0], *s) for s in (rules.settle(now[1], now[2])[1] if now[1] else [])]
                    now = None
                task = now[1] if now else None
                for e in in_order(own):
                    task, steps = rules.take(task, e)
                    found += [(task_id, *s) for s in steps]
                now = (int(task_id), task, int(own["last"].iloc[0]))
            yield pd.DataFrame(found, columns=["task_id", "t", "step", "attempts", "worker"])
        if now is not None and now[1]:
            yield steps_frame(now[0], rules.settle(now[1], now[2])[1])

    return ordered.mapInPandas(run, STEP)
