"""State transitions of schedules, tasks, batches and workers: snapshots and inputs in, new rows out.

Nothing here reads a clock or draws a number: the time comes in as `as_of`, tokens and request ids come with the rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions import expr
from feedloom.operators import scheduling

#: Characters of an error message that are kept.
MESSAGE = 16_000
#: Seconds after which a stale task is tried again, and the least time that a lease lasts.
STALE_DELAY, LEAST_TTL = 15, 300


def at(as_of: dt.datetime) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def reconcile(config: DataFrame, sources: DataFrame, schedules: DataFrame, as_of: dt.datetime) -> DataFrame:
    """source_id, action, config_hash, enabled and next_run_at of every source once the catalogue is applied.

    config: source_id, spec (canonical text), enabled, schedule_type, seconds, first_run_at (where it isn't an interval).
    Stored sources that the catalogue lacks are retired if it manages them. An enabled schedule keeps its next run; any
    other starts anew, an interval within its first minute at most, at the second that the id's hash gives.
    """
    stored = sources.select("source_id", "managed_by", F.col("enabled").alias("was_enabled"), F.col("config_hash").alias("old_hash"))
    kept = schedules.where("enabled").select("source_id", F.col("next_run_at").alias("old_run"))
    both = config.select("*", F.lit(True).alias("listed")).join(stored, "source_id", "full").join(kept, "source_id", "left")
    new_hash = F.left(F.sha2("spec", 256), F.lit(16))
    action = (
        F.when(F.col("managed_by").isNull(), "insert")
        .when(F.col("listed") & (F.col("old_hash") == new_hash), "same")
        .when(F.col("listed"), "update")
        .when(F.col("managed_by") == "config", "retire")
        .otherwise("keep")
    )
    enabled = F.when(F.col("listed"), F.col("enabled")).otherwise(F.col("was_enabled") & (F.col("managed_by") != "config"))
    second = expr.hash_modulo(F.col("source_id"), F.greatest(F.least("seconds", F.lit(60)), F.lit(1)).cast("long"))
    first = F.when(F.col("schedule_type") == "interval", at(as_of) + F.make_dt_interval(secs=second)).otherwise(F.col("first_run_at"))
    run = F.coalesce("old_run", F.when(F.col("listed"), first))
    return (
        both
            .select(
                "source_id", action.alias("action"), F.coalesce(new_hash, "old_hash").alias("config_hash"), enabled.alias("enabled"),
                F.when(enabled, run).alias("next_run_at")
            )
    )


def inserted(new: DataFrame, live: DataFrame, history: DataFrame) -> DataFrame:
    """The new task rows with `registered`: the first of a dedupe_key (by its `request` order) that neither live tasks nor history hold."""
    seen = live.select("dedupe_key").unionByName(history.select("dedupe_key")).distinct().withColumn("seen", F.lit(True))
    first = F.row_number().over(Window.partitionBy("dedupe_key").orderBy("request")) == 1
    return (
        new.withColumn("first", first).join(seen, "dedupe_key", "left")
            .withColumn("registered", F.col("first") & F.col("seen").isNull()).drop("first", "seen")
    )


def register_due(schedules: DataFrame, sources: DataFrame, live: DataFrame, history: DataFrame, as_of: dt.datetime, limit: int = 500) -> DataFrame:
    """The tasks of the due schedules, with the schedule's next_run_at afterwards: empty once its task is registered, as before where the key was known."""
    due = scheduling.due_schedules(schedules, sources, as_of, limit)
    key = F.concat(F.lit("schedule:"), "schedule_id", F.lit(":"), expr.iso_utc(F.col("next_run_at")))
    tasks = due.select(
        key.alias("dedupe_key"), "schedule_id", "source_id", F.lit("fetch").alias("operation"), F.lit("scheduled").alias("workload"),
        F.col("next_run_at").alias("scheduled_for"), F.col("next_run_at").alias("not_before"), F.col("schedule_id").alias("request"),
    )
    return inserted(tasks, live, history).withColumn("next_run_at", F.when(~F.col("registered"), F.col("scheduled_for"))).drop("request")


def submit(requests: DataFrame, sources: DataFrame, live: DataFrame, history: DataFrame) -> DataFrame:
    """request, dedupe_key and outcome (registered, duplicate, unknown_source) of manual tasks; without a key of its own a request has one by its id."""
    known = sources.select("source_id", F.lit(True).alias("known"))
    key = F.coalesce("dedupe_key", F.concat(F.lit("manual:"), "source_id", F.lit(":"), F.col("request").cast("string")))
    rows = requests.join(known, "source_id", "left").select("request", "source_id", key.alias("dedupe_key"), "known")
    made = (
        inserted(rows.where("known"), live, history)
            .select("request", "dedupe_key", F.when(F.col("registered"), "registered").otherwise("duplicate").alias("outcome"))
    )
    return made.unionByName(rows.where("known IS NULL").select("request", "dedupe_key", F.lit("unknown_source").alias("outcome")))


def create_backfills(requests: DataFrame, sources: DataFrame) -> DataFrame:
    """A row per window of each accepted request (batch_id, source_id, range_start, range_end, window_seconds), one with its reason per rejected request.

    sources: source_id, backfill_enabled, backfill_window_seconds (for requests without a width). Windows are 60 seconds at
    least, the last one is cut at the end.
    """
    rows = requests.join(sources.select("source_id", "backfill_enabled", "backfill_window_seconds"), "source_id", "left")
    reason = (
        F.when(F.col("backfill_enabled").isNull(), "unknown_source").when(~F.col("backfill_enabled"), "not_enabled").when(
            F.col("range_end") <= F.col("range_start"), "empty_range"
        )
    )
    width = F.greatest(F.lit(60), F.coalesce("window_seconds", "backfill_window_seconds")).cast("long")
    judged = rows.withColumn("reason", reason).withColumn("width", width)
    steps = (
        F.floor(
            (
                F.unix_micros(F.col("range_end").cast("timestamp")) - F.unix_micros(F.col("range_start").cast("timestamp")) - 1
            ) / (F.col("width") * 1_000_000)
        )
    )
    each = judged.where("reason IS NULL").withColumn("n", F.explode(F.sequence(F.lit(0).cast("long"), steps)))
    start = F.col("range_start") + F.make_dt_interval(secs=F.col("n") * F.col("width"))
    windows = (
        each.withColumn("window_start", start)
            .withColumn("window_end", F.least("range_end", F.col("window_start") + F.make_dt_interval(secs=F.col("width"))))
    )
    key = (
        F.concat(
            F.lit("backfill:"), F.col("batch_id").cast("string"), F.lit(":"), expr.iso_utc(F.col("window_start")), F.lit(":"),
            expr.iso_utc(F.col("window_end"))
        )
    )
    made = windows.select("batch_id", "source_id", "window_start", "window_end", key.alias("dedupe_key"), F.lit(None).cast("string").alias("reason"))
    none = F.lit(None).cast("timestamp_ntz")
    refused = (
        judged.where("reason IS NOT NULL")
            .select(
                "batch_id", "source_id", none.alias("window_start"), none.alias("window_end"), F.lit(None).cast("string").alias("dedupe_key"),
                "reason"
            )
    )
    return made.unionByName(refused)


def batch_actions(batches: DataFrame, actions: DataFrame, tasks: DataFrame) -> DataFrame:
    """id, new status and removed tasks for each action (id, action: pause, resume, cancel); null status where the batch is neither running nor paused.

    Cancelling removes the batch's waiting tasks."""
    waiting = (
        tasks.where(F.col("status").isin("pending", "retry") & F.col("batch_id").isNotNull()).groupBy(F.col("batch_id").alias("id"))
            .agg(F.count(F.lit(1)).alias("waiting"))
    )
    becomes = F.when(F.col("action") == "pause", "paused").when(F.col("action") == "resume", "running").when(F.col("action") == "cancel", "cancelled")
    new = F.when(F.col("status").isin("running", "paused"), becomes)
    rows = actions.join(batches.select("id", "status"), "id").join(waiting, "id", "left")
    return rows.select("id", "action", new.alias("status"), F.when(new == "cancelled", F.coalesce("waiting", F.lit(0))).otherwise(0).alias("removed"))


def guarded(tasks: DataFrame, reports: DataFrame) -> DataFrame:
    """The reports (task_id, lease_token, ...) with their task's columns as `task` and whether they are accepted: same token, still running.

    Reports pass by a hash table of the tasks, without being sorted: their messages make them far larger than tasks, and a task
    that sorts them takes memory for all of them."""
    held = tasks.select(F.col("id").alias("task_id"), F.struct(*tasks.columns).alias("task")).hint("shuffle_hash")
    ok = (F.col("task.status") == "running") & (F.col("task.lease_token") == F.col("lease_token"))
    return reports.join(held, "task_id", "left").withColumn("accepted", F.coalesce(ok, F.lit(False)))


def archived(ended: DataFrame, as_of: dt.datetime) -> DataFrame:
    """The runs of ended tasks (task, final_status, added, error_class, message)."""
    seconds = (F.unix_micros(at(as_of).cast("timestamp")) - F.unix_micros(F.col("task.locked_at").cast("timestamp"))) / 1e6
    return ended.select(
        F.col("task.id").alias("task_id"), F.col("task.dedupe_key").alias("dedupe_key"), F.col("task.batch_id").alias("batch_id"), "final_status", F.col("task.attempts").alias("attempts"),
        F.col("task.locked_by").alias("worker_id"), F.coalesce("added", F.lit(0)).alias("rows_added"), "error_class", F.left("message", F.lit(MESSAGE)).alias("error_message"),
        F.col("task.locked_at").alias("started_at"), seconds.alias("duration_seconds"),
    )


def complete(tasks: DataFrame, reports: DataFrame, history: DataFrame, as_of: dt.datetime) -> DataFrame:
    """The runs of tasks whose completion (status, added, message) is accepted and whose key history doesn't hold yet, one of each key; a
    completion doesn't carry an error class.

    Accepted completions are counted by key without their messages first; only those of keys with several are compared."""
    told = reports.where(F.col("status") != "failed")
    free = tasks.where("status = 'running'").join(history.select("dedupe_key"), "dedupe_key", "left_anti")
    accepted = guarded(free, told.select("task_id", "lease_token")).where("accepted")
    times = accepted.groupBy(F.col("task.dedupe_key").alias("dedupe_key")).agg(F.count(F.lit(1)).alias("times"))
    counted = free.join(times.withColumnRenamed("dedupe_key", "key"), F.col("dedupe_key").eqNullSafe(F.col("key"))).drop("key")
    done = guarded(counted, told).where("accepted")
    ended = done.select("task", F.col("status").alias("final_status"), "added", F.lit(None).cast("string").alias("error_class"), "message")
    several = archived(ended.where("task.times > 1"), as_of).dropDuplicates(["dedupe_key"])
    return archived(ended.where("task.times = 1"), as_of).unionByName(several)


def fail(tasks: DataFrame, reports: DataFrame, as_of: dt.datetime) -> DataFrame:
    """task_id, action (retry, dead, lease_lost), delay and the waiting task's not_before, status and last_error of each failure.

    reports: task_id, lease_token, error_class, message, retry_after; tasks also have base_seconds, max_seconds and backoff.
    """
    rows = guarded(tasks, reports)
    again = expr.retryable(F.col("error_class"), F.col("task.attempts"), F.col("task.max_attempts"))
    action = F.when(~F.col("accepted"), "lease_lost").when(again, "retry").otherwise("dead")
    delay = (
        F.when(
            action == "retry",
            expr.retry_delay(
                F.col("task.attempts"), F.col("task.base_seconds"), F.col("task.max_seconds"), F.col("task.backoff"), F.col("retry_after")
            )
        )
    )
    status = F.when(action == "retry", "retry").when(action == "dead", "dead").otherwise(F.col("task.status"))
    return rows.select(
        "task_id", action.alias("action"), delay.alias("delay"), (at(as_of) + F.make_dt_interval(secs=delay)).alias("not_before"), status.alias("status"),
        F.when(F.col("accepted"), F.left("message", F.lit(MESSAGE))).alias("last_error"),
    )


def finish_schedules(schedules: DataFrame, ended: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Schedules (schedule_id, enabled, kind, seconds, once_at, cron, zone) whose task has ended: the next run counts from now; one without any is disabled."""
    next_run = scheduling.next_run(F.col("kind"), F.col("seconds"), F.col("once_at"), F.col("cron"), F.col("zone"), at(as_of))
    rows = schedules.join(ended.select("schedule_id").distinct(), "schedule_id", "left_semi").withColumn("next_run_at", next_run)
    return (
        rows
            .select(
                "schedule_id", (F.col("enabled") & F.col("next_run_at").isNotNull()).alias("enabled"), "next_run_at",
                F.lit(None).cast("long").alias("active_task_id")
            )
    )


def finish_batches(batches: DataFrame, runs: DataFrame) -> DataFrame:
    """id, total, completed, failed and status of batches (id, status, total_tasks) after these runs: partial and dead ones count as failed.

    Once all have ended a batch is completed, or partial if any failed; until then its status stays."""
    ended = (
        runs.where("batch_id IS NOT NULL").groupBy(F.col("batch_id").alias("id"))
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("final_status").isin("partial", "dead")).alias("bad"))
    )
    done, bad = F.coalesce("n", F.lit(0)), F.coalesce("bad", F.lit(0))
    status = F.when((done > 0) & (done >= F.col("total_tasks")), F.when(bad > 0, "partial").otherwise("completed")).otherwise(F.col("status"))
    return (
        batches.join(ended, "id", "left")
            .select("id", F.col("total_tasks").alias("total"), done.alias("completed"), bad.alias("failed"), status.alias("status"))
    )


def heartbeat(tasks: DataFrame, leases: DataFrame, beats: DataFrame, stale_seconds: int = 180) -> DataFrame:
    """resource_key, slot and new expires_at of the leases that beats (worker_id, task_id, lease_token, ts) renew: same task, worker and token; of several beats the last counts."""
    ttl = max(LEAST_TTL, stale_seconds + 60)
    running = tasks.where("status = 'running'").select(F.col("id").alias("task_id"), F.col("locked_by").alias("worker_id"), "lease_token")
    last = beats.join(running, ["task_id", "worker_id", "lease_token"], "left_semi").groupBy("task_id").agg(F.max("ts").alias("ts"))
    return leases.join(last, "task_id").select("resource_key", "slot", "task_id", (F.col("ts") + F.make_dt_interval(secs=F.lit(ttl))).alias("expires_at"))


def maintenance(tasks: DataFrame, workers: DataFrame, as_of: dt.datetime, offline_seconds: int = 60, stale_seconds: int = 180) -> DataFrame:
    """One row: offline_workers and stale_tasks, as many as are marked and put back."""
    before = lambda c, seconds: F.col(c) < at(as_of) - F.make_dt_interval(secs=F.lit(seconds))
    gone = workers.where(before("last_heartbeat_at", offline_seconds) & (F.col("effective_state") != "offline")).agg(F.count(F.lit(1)).alias("offline_workers"))
    stale = tasks.where((F.col("status") == "running") & before("heartbeat_at", stale_seconds)).agg(F.count(F.lit(1)).alias("stale_tasks"))
    return gone.join(stale)  # a row each


def merged_report(told: DataFrame, counted: DataFrame) -> DataFrame:
    """Counters per task_id: what the plugin told or what was counted, whichever is larger; a missing one counts as 0."""
    names = [c for c in counted.columns if c != "task_id"]
    own = told.select("task_id", *[F.col(c).alias(f"told_{c}") for c in names if c in told.columns])
    return (
        counted.join(own, "task_id", "full")
            .select(
                "task_id",
                *[F.greatest(F.coalesce(F.col(c), F.lit(0)), F.coalesce(f"told_{c}", F.lit(0)) if f"told_{c}" in own.columns else F.lit(0)).alias(c) for c in names]
            )
    )
