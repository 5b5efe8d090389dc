"""The scheduler as a stream: each tick registers what is due at its time, and no task twice."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from feedloom.functions import expr
from feedloom.operators import scheduling
from feedloom.operators.seen import SeenKeys

Tables = Callable[[], tuple[DataFrame, DataFrame]]


def due_tasks(schedules: DataFrame, sources: DataFrame, as_of: dt.datetime, limit: int = 500) -> DataFrame:
    """The tasks (dedupe_key, schedule_id, source_id, scheduled_for) of the schedules that are due, the earliest ones first: a key names the
    schedule and the time that it was due."""
    due = scheduling.due_schedules(schedules, sources, as_of, limit)
    key = F.concat(F.lit("schedule:"), "schedule_id", F.lit(":"), expr.iso_utc(F.col("next_run_at")))
    return due.select(key.alias("dedupe_key"), "schedule_id", "source_id", F.col("next_run_at").alias("scheduled_for"))


def registered(tasks: DataFrame, index: SeenKeys, number: int, hand_on: Callable[[DataFrame, int], None]) -> None:
    """Hands on the tasks whose keys the index hasn't seen before this number, then adds them: a tick that was stopped between the two hands
    the same ones on again, with its number."""
    new = index.unseen(tasks.select(F.col("dedupe_key").alias("key")), number)
    hand_on(tasks.join(new.select(F.col("key").alias("dedupe_key")), "dedupe_key", "left_semi"), number)
    index.add(new, number)


def ticking(spark: SparkSession, tables: Tables, index: SeenKeys, hand_on: Callable[[DataFrame, int], None], checkpoint: str, seconds: int = 10, limit: int = 500) -> StreamingQuery:
    """Registers every so many seconds, one at least. `tables` reads schedules and sources as they then are; a tick's time is the latest of its
    micro-batch, so a tick that runs again after a stop asks for the same schedules."""
    beats = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def tick(rows: DataFrame, number: int) -> None:
        time = rows.agg(F.max(F.col("timestamp").cast("timestamp_ntz")).alias("t")).first()["t"]
        if time is not None:
            registered(due_tasks(*tables(), time, limit), index, number, hand_on)

    return beats.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(processingTime=f"{max(1, seconds)} seconds").start()
