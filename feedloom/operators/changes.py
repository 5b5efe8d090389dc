"""The rows that heartbeats and reports change, as rows: what a table holds afterwards, what goes, and what is free again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions import expr
from feedloom.operators import transitions


def beaten_workers(workers: DataFrame, beats: DataFrame) -> DataFrame:
    """node_id, effective_state and last_heartbeat_at of the workers (node_id, instance_id, desired_state) whose beats (node_id, instance_id, ts)
    are accepted: a beat of a replaced instance changes nothing, of several the last counts."""
    last = beats.join(workers.select("node_id", "instance_id"), ["node_id", "instance_id"], "left_semi").groupBy("node_id").agg(F.max("ts").alias("last_heartbeat_at"))
    return workers.join(last, "node_id").select("node_id", F.col("desired_state").alias("effective_state"), "last_heartbeat_at")


def beaten_tasks(tasks: DataFrame, beats: DataFrame) -> DataFrame:
    """id and heartbeat_at of the running tasks that beats (worker_id, task_id, lease_token, ts) name with their worker and token."""
    running = tasks.where("status = 'running'").select(F.col("id").alias("task_id"), F.col("locked_by").alias("worker_id"), "lease_token")
    held = beats.join(running, ["task_id", "worker_id", "lease_token"], "left_semi")
    return held.groupBy(F.col("task_id").alias("id")).agg(F.max("ts").alias("heartbeat_at"))


def released(tasks: DataFrame, reports: DataFrame, leases: DataFrame) -> DataFrame:
    """what (task or lease), task_id, resource_key and slot of all that accepted reports set free: a task goes when it has ended, its leases
    also when it is put back for another try."""
    rows = transitions.guarded(tasks, reports.where("status IS NOT NULL")).where("accepted")
    again = (F.col("status") == "failed") & expr.retryable(F.col("error_class"), F.col("task.attempts"), F.col("task.max_attempts"))
    told = rows.groupBy("task_id").agg(F.max(~again).alias("ended"))
    # not a union of what has ended and of leases: Spark 4.1 fails where a union of joins that stand by one key is joined by it again
    held = told.join(leases.select("task_id", F.struct("resource_key", "slot").alias("lease")), "task_id", "left")
    placed = held.withColumn("place", F.row_number().over(Window.partitionBy("task_id").orderBy("lease")))
    freed = lambda what, key, slot: F.struct(F.lit(what).alias("what"), key.alias("resource_key"), slot.alias("slot"))
    task = F.when((F.col("place") == 1) & F.col("ended"), freed("task", F.lit(None).cast("string"), F.lit(None).cast("int")))
    lease = F.when(F.col("lease").isNotNull(), freed("lease", F.col("lease.resource_key"), F.col("lease.slot")))
    return placed.select("task_id", F.explode(F.array_compact(F.array(task, lease))).alias("x")).select("x.what", "task_id", "x.resource_key", "x.slot")


def capabilities(fetcher: Column, sink: Column, asset_store: Column, more: Column) -> Column:
    """What a task of a source needs of a worker, sorted and each once: its fetcher, its sink, its asset store if it has one, and what its
    routing adds (an array)."""
    named = lambda kind, name: F.when(name.isNotNull() & (name != ""), F.concat(F.lit(f"{kind}:"), name))
    every = F.concat(F.array(named("fetcher", fetcher), named("sink", sink), named("asset_store", asset_store)), F.coalesce(more, F.array().cast("array<string>")))
    return F.array_sort(F.array_distinct(F.array_compact(every)))
