"""Due schedules, registration without duplicates, backfill windows, claims, retries and maintenance."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions import cron, expr


def due_schedules(schedules: DataFrame, sources: DataFrame, as_of: dt.datetime, limit: int = 500) -> DataFrame:
    on = sources.where("enabled").select("source_id")
    ready = schedules.where(F.col("enabled") & F.col("active_task_id").isNull() & (F.col("next_run_at") <= F.lit(as_of).cast("timestamp_ntz")))
    return ready.join(on, "source_id").orderBy("next_run_at", "schedule_id").limit(limit)


def not_registered(new: DataFrame, live: DataFrame, history: DataFrame, key: str = "dedupe_key") -> DataFrame:
    """One row for each key that neither live tasks nor history hold."""
    seen = live.select(key).unionByName(history.select(key))
    return new.dropDuplicates([key]).join(seen, key, "left_anti")


def backfill_windows(ranges: DataFrame, seconds: int) -> DataFrame:
    """[window_start, window_end) of max(60, seconds) each from start to end; the last is cut, an empty range has none."""
    width = max(60, seconds)
    steps = F.expr(f"explode(sequence(range_start, range_end, INTERVAL '{width}' SECOND))")
    at = ranges.where("range_end > range_start").withColumn("window_start", steps).where("window_start < range_end")
    return at.withColumn("window_end", F.least("range_end", F.expr(f"window_start + INTERVAL '{width}' SECOND")))


def next_run(kind: Column, seconds: Column, once_at: Column, line: Column, zone: Column, after: Column) -> Column:
    """interval: after + seconds; once: its time if still to come, else null; cron: the next minute in its zone, null for a line that can't be read
    (`cron.next_time` says why)."""
    later = after + F.make_dt_interval(secs=seconds)
    return F.when(kind == "interval", later).when(kind == "once", F.when(once_at > after, once_at)).otherwise(cron.next_time(F.when(kind == "cron", line), zone, after)["at"])


def ready_tasks(tasks: DataFrame, batches: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Waiting tasks whose time has come and whose batch, if they have one, is running."""
    ready = tasks.where(F.col("status").isin("pending", "retry") & (F.col("not_before") <= F.lit(as_of).cast("timestamp_ntz")))
    running = batches.where("status = 'running'").select(F.col("id").alias("batch_id"), F.lit(True).alias("runs"))
    return ready.join(running, "batch_id", "left").where(F.col("batch_id").isNull() | F.col("runs")).drop("runs")


def online_places(workers: DataFrame) -> DataFrame:
    """(node_id, offered, queue): what each online worker offers, a row for each of its queues."""
    queues = F.explode(expr.csv_array(F.col("queues_csv"))).alias("queue")
    return workers.where("effective_state = 'online'").select("node_id", expr.csv_array(F.col("caps_csv")).alias("offered"), queues)


def claim_candidates(tasks: DataFrame, workers: DataFrame, batches: DataFrame, as_of: dt.datetime, most: int = 200) -> DataFrame:
    """Each online worker's first tasks in order: right queue and capabilities, no other preferred worker, batch absent or running.

    Of each kind (queue, capabilities, preferred worker) no more than the first `most` tasks meet the workers."""
    preferred = F.col("preferred_worker").isNull() | (F.col("preferred_worker") == F.col("node_id"))
    able = expr.contains_all(expr.csv_array(F.col("caps_csv")), F.col("offered"))
    first = Window.partitionBy("queue", "caps_csv", "preferred_worker").orderBy("priority", "not_before", "id")
    front = ready_tasks(tasks, batches, as_of).withColumn("n", F.row_number().over(first)).where(F.col("n") <= most).drop("n")
    return first_of_each(front.join(online_places(workers), "queue").where(able & preferred), most)


def first_of_each(fits: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("node_id").orderBy("priority", "not_before", "id")
    return fits.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)


def offers(tasks: DataFrame, workers: DataFrame, batches: DataFrame, as_of: dt.datetime, most: int = 200, slots: DataFrame | None = None) -> DataFrame:
    """As `claim_candidates`, but each task is offered to one worker only, so that all may claim at once: to the preferred one,
    else to the (id mod number)-th of those that can take it. Workers are matched with the few distinct (queue, capabilities).
    With slots (node_id, slots) those that have none left are offered nothing. `rounds.claim_rounds` also passes on what a worker leaves."""
    if slots is not None:
        workers = workers.join(slots.where("slots > 0").select("node_id"), "node_id", "left_semi")
    ready = ready_tasks(tasks, batches, as_of)
    able = expr.contains_all(expr.csv_array(F.col("caps_csv")), F.col("offered"))
    kinds = ready.select("queue", "caps_csv").distinct().join(online_places(workers), "queue").where(able)
    takers = kinds.groupBy("queue", "caps_csv").agg(F.array_sort(F.collect_set("node_id")).alias("takers"))
    turn = F.element_at("takers", (F.pmod(F.col("id"), F.size("takers")) + 1).cast("int"))
    own = F.when(F.col("preferred_worker").isNull(), turn).when(F.array_contains("takers", F.col("preferred_worker")), F.col("preferred_worker"))
    return first_of_each(ready.join(takers, ["queue", "caps_csv"]).withColumn("node_id", own).where("node_id IS NOT NULL"), most)


def slots_left(workers: DataFrame, tasks: DataFrame, quota: int | Column = 1) -> DataFrame:
    """(node_id, slots, backfill_left): free slots of each worker, and of these what a resident one may still give to backfills (null: no limit).

    quota: the slots that a resident worker may give to backfills in all; a column of `workers` if they differ."""
    running = tasks.where("status = 'running'").groupBy(F.col("locked_by").alias("node_id"))
    used = running.agg(F.sum("slot_cost").alias("used"), F.sum(F.when(F.col("workload") == "backfill", F.col("slot_cost"))).alias("backfill"))
    left = F.when(F.col("mode") == "resident", (quota if isinstance(quota, Column) else F.lit(quota)) - F.coalesce("backfill", F.lit(0)))
    rows = workers.join(used, "node_id", "left")
    return (
        rows
            .select(
                "node_id", F.greatest(F.col("max_concurrency") - F.coalesce("used", F.lit(0)), F.lit(0)).cast("int").alias("slots"),
                left.cast("long").alias("backfill_left")
            )
    )


def held_slots(leases: DataFrame, as_of: dt.datetime) -> DataFrame:
    """resource_key and slot of the leases that haven't expired."""
    return leases.where(F.col("expires_at") > F.lit(as_of).cast("timestamp_ntz")).select("resource_key", "slot")


def held_before(candidates: DataFrame, slots: DataFrame, held: DataFrame) -> DataFrame:
    """Of each worker (node_id) a map `held` of the resources that its candidates name to the slots taken before its turn.

    held: resource_key, slot and maybe `by`, the turn of the worker that takes it (null: taken anyway)."""
    named = candidates.select("node_id", F.explode(F.map_keys("resources")).alias("resource_key")).distinct()
    if "by" in held.columns:
        named = named.join(slots.select("node_id", "turn"), "node_id")
        before = F.col("by").isNull() | (F.col("by") < F.col("turn"))
    else:
        before = F.lit(True)
    taken = named.join(held, "resource_key").where(before).groupBy("node_id", "resource_key").agg(F.collect_set("slot").alias("slots"))
    return taken.groupBy("node_id").agg(F.map_from_entries(F.collect_list(F.struct("resource_key", "slots"))).alias("held"))


def claim_greedy(candidates: DataFrame, slots: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """Walks each worker's candidates (at most a few hundred) in order and takes those that still fit: node_id, id, slot_cost, n, leases.

    slots: node_id, slots and backfill_left, which a backfill must fit in too unless it is null. Candidates may carry
    `resources`, a map of keys to capacities: such a task needs the lowest free slot of each of them, all or none; `held`
    (see `held_before`) says which are taken. Only the claims of one worker see each other's slots; `rounds.claim_rounds`
    lets workers that share resources claim together.
    """
    taken = "map<string,array<int>>"
    has = "resources" in candidates.columns
    need = (
        F.array_sort(
            F.map_entries(F.coalesce("resources", F.create_map().cast("map<string,int>")))
        ) if has else F.array().cast("array<struct<key:string,value:int>>")
    )
    part = F.when(F.col("workload") == "backfill", F.col("slot_cost")).otherwise(0)
    rows = candidates.select("node_id", F.struct("n", "id", "slot_cost", part.alias("part"), need.alias("need")).alias("t"))
    rows = rows.groupBy("node_id").agg(F.array_sort(F.collect_list("t")).alias("rows")).join(slots, "node_id")
    if held is not None and has:
        rows = rows.join(held_before(candidates, slots, held), "node_id", "left")
    else:
        rows = rows.withColumn("held", F.create_map().cast(taken))
    got = "array<struct<n:int,id:bigint,slot_cost:int,leases:array<struct<key:string,slot:int>>>>"
    start = (
        F.struct(
            F.col("slots").alias("left"), F.col("backfill_left").alias("quota"),
            F.coalesce("held", F.create_map().cast(taken)).cast(taken).alias("held"), F.array().cast(got).alias("got")
        )
    )

    def free(state: Column, r: Column) -> Column:
        every = F.sequence(F.lit(1), F.greatest(r["value"], F.lit(1)))
        return F.array_min(F.array_except(every, F.coalesce(F.element_at(state["held"], r["key"]), F.array().cast("array<int>"))))

    def fits(state: Column, t: Column) -> Column:
        backfill = (t["part"] == 0) | state["quota"].isNull() | (t["part"] <= state["quota"])
        return (t["slot_cost"] <= state["left"]) & backfill & F.forall(t["need"], lambda r: free(state, r).isNotNull())

    def take(state: Column, t: Column) -> Column:
        leases = F.transform(t["need"], lambda r: F.struct(r["key"].alias("key"), free(state, r).alias("slot")))
        others = F.map_filter(state["held"], lambda k, v: ~F.exists(t["need"], lambda r: r["key"] == k))
        longer = lambda x: F.concat(F.coalesce(F.element_at(state["held"], x["key"]), F.array().cast("array<int>")), F.array(x["slot"]))
        more = F.map_from_entries(F.transform(leases, lambda x: F.struct(x["key"].alias("key"), longer(x).alias("value"))))
        one = F.struct(t["n"].alias("n"), t["id"].alias("id"), t["slot_cost"].alias("slot_cost"), leases.alias("leases"))
        return (
            F.struct(
                (state["left"] - t["slot_cost"]).alias("left"), (state["quota"] - t["part"]).alias("quota"), F.map_concat(others, more).alias("held"),
                F.array_append(state["got"], one).alias("got")
            )
        )

    walked = F.aggregate("rows", start, lambda s, t: F.when(fits(s, t), take(s, t)).otherwise(s), lambda s: s["got"])
    return rows.select("node_id", F.explode(walked).alias("t")).select("node_id", "t.id", "t.slot_cost", "t.n", "t.leases")


def claimed(tasks: DataFrame, claims: DataFrame, as_of: dt.datetime) -> DataFrame:
    """The claimed tasks as they are afterwards: running, one attempt more, locked, with a lease token made of task, attempt and worker."""
    time = F.lit(as_of).cast("timestamp_ntz")
    rows = tasks.drop("locked_by", "locked_at", "heartbeat_at", "lease_token", "status").join(claims.select("id", F.col("node_id").alias("locked_by")), "id")
    rows = rows.withColumn("attempts", F.col("attempts") + 1).withColumn("status", F.lit("running"))
    token = F.sha2(F.concat_ws(":", F.col("id").cast("string"), F.col("attempts").cast("string"), "locked_by"), 256)
    return rows.withColumn("locked_at", time).withColumn("heartbeat_at", time).withColumn("lease_token", token)


def lease_rows(claims: DataFrame, as_of: dt.datetime, stale_seconds: int = 180) -> DataFrame:
    """resource_key, slot, task_id, worker_id and expires_at of the claims' leases."""
    until = F.lit(as_of).cast("timestamp_ntz") + F.make_dt_interval(secs=F.lit(max(300, stale_seconds + 60)))
    each = claims.select("id", "node_id", F.explode("leases").alias("l"))
    return (
        each
            .select(
                F.col("l.key").alias("resource_key"), F.col("l.slot").alias("slot"), F.col("id").alias("task_id"),
                F.col("node_id").alias("worker_id"), until.alias("expires_at")
            )
    )


def free_slots(capacities: DataFrame, leases: DataFrame, as_of: dt.datetime) -> DataFrame:
    """The lowest slot of each resource (resource_key, capacity) that no live lease holds."""
    live = leases.where(F.col("expires_at") > F.lit(as_of).cast("timestamp_ntz")).select("resource_key", "slot")
    slots = capacities.select("resource_key", F.explode(F.sequence(F.lit(1), F.col("capacity"))).alias("slot"))
    return slots.join(live, ["resource_key", "slot"], "left_anti").groupBy("resource_key").agg(F.min("slot").alias("slot"))


def stuck_tasks(tasks: DataFrame, workers: DataFrame, limit: int = 200) -> DataFrame:
    """Waiting tasks that no online worker can take, with the reason, oldest first.

    Tasks are matched by their distinct (queue, capabilities), a few rows, not one by one.
    """
    waiting = tasks.where(F.col("status").isin("pending", "retry"))
    online = (
        workers.where("effective_state = 'online'")
            .select(expr.csv_array(F.col("caps_csv")).alias("offered"), F.explode(expr.csv_array(F.col("queues_csv"))).alias("queue"))
    )
    kinds = waiting.select("queue", "caps_csv").distinct()
    can = kinds.join(online, "queue").where(expr.contains_all(expr.csv_array(F.col("caps_csv")), F.col("offered"))).select("queue", "caps_csv").distinct()
    able = can.withColumn("able", F.lit(True))
    judged = (
        waiting.join(able, ["queue", "caps_csv"], "left")
            .withColumn("reason", F.when(F.col("caps_csv") == "", "unroutable").when(F.col("able").isNull(), "no_capable_worker"))
    )
    return judged.where("reason IS NOT NULL").orderBy("created_at", "id").limit(limit)
