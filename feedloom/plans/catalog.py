"""The registered queries, each with the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions import cron, expr
from feedloom.operators import scheduling, transitions, upsert
from feedloom.plans.views import view, with_views
from feedloom.sources import extract

AS_OF = dt.datetime(2024, 1, 30)
NOW_SQL = "TIMESTAMP '2024-01-30 00:00:00'"
View = Callable[[str], DataFrame]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
DEFINED: dict[str, Callable[[View], DataFrame]] = {}


def now() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def query(name: str, sql: str | None = None) -> Callable[[Callable[[View], DataFrame]], Callable[[View], DataFrame]]:
    def register(f: Callable[[View], DataFrame]) -> Callable[[View], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(lambda table: view(spark, sf_dir, table))
        DEFINED[name] = f
        if sql:
            ORACLE_SQL[name] = with_views(sql)
        return f

    return register


def head(name: str, table: str, columns: str, where: str, order: str, limit: int) -> None:
    query(name, f"SELECT {columns} FROM {table} WHERE {where} ORDER BY {order} LIMIT {limit}")(
        lambda v: (
            v(table).where(where)
                .orderBy(
                    *[F.expr(o.removesuffix(" DESC")).desc_nulls_last() if o.endswith(" DESC") else F.expr(o).asc_nulls_last() for o in order.split(", ")]
                )
                .limit(limit).selectExpr(*columns.split(", "))
        )
    )


# operational views
query("task_counts", "SELECT status, count(*) AS n FROM tasks_v GROUP BY status")(lambda v: v("tasks_v").groupBy("status").agg(F.count(F.lit(1)).alias("n")))
head("queue_head", "tasks_v", "id, source_id, workload, priority, status, queue", "status IN ('pending', 'retry')", "priority, not_before, id", 100)
head("running_head", "tasks_v", "id, source_id, locked_by, locked_at", "status = 'running'", "locked_at, id", 100)
head("recent_errors", "runs_v", "task_id, source_id, error_class, finished_at", "final_status IN ('dead', 'partial')", "finished_at DESC, task_id", 200)
head("recent_runs", "runs_v", "task_id, source_id, final_status, rows_added, finished_at", "true", "finished_at DESC, task_id", 200)


@query(
    "schedule_overview",
    """SELECT schedule_id, source_id, fetcher, s.enabled AS enabled, next_run_at FROM schedules_v s JOIN (SELECT source_id, fetcher
    FROM sources_v) x USING (source_id)"""
    " ORDER BY s.enabled DESC, next_run_at NULLS LAST, schedule_id LIMIT 500",
)
def _(v: View) -> DataFrame:
    rows = v("schedules_v").join(v("sources_v").select("source_id", "fetcher"), "source_id")
    order = (F.desc("enabled"), F.asc_nulls_last("next_run_at"), "schedule_id")
    return rows.orderBy(*order).limit(500).select("schedule_id", "source_id", "fetcher", "enabled", "next_run_at")


@query("source_list", "SELECT source_id, fetcher, sink, enabled, managed_by FROM sources_v ORDER BY source_id")
def _(v: View) -> DataFrame:
    return v("sources_v").orderBy(F.col("source_id").asc_nulls_last()).select("source_id", "fetcher", "sink", "enabled", "managed_by")


@query("last_24h", f"""SELECT count(*) AS total, count(*) FILTER (WHERE final_status = 'succeeded') AS succeeded, count(*) FILTER (WHERE final_status = 'dead') AS dead, COALESCE(sum(rows_added), 0)::BIGINT AS rows_added
    FROM runs_v WHERE finished_at >= {NOW_SQL} - INTERVAL '24 hours'""")
def _(v: View) -> DataFrame:
    day = v("runs_v").where(F.col("finished_at") >= now() - F.expr("INTERVAL '24' HOUR"))
    return (
        day
            .agg(
                F.count(F.lit(1)).alias("total"), F.count_if(F.col("final_status") == "succeeded").alias("succeeded"),
                F.count_if(F.col("final_status") == "dead").alias("dead"), F.coalesce(F.sum("rows_added"), F.lit(0)).alias("rows_added")
            )
    )


@query("resource_summary", f"""SELECT count(*) AS total, count(*) FILTER (WHERE observed_at >= {NOW_SQL} - INTERVAL '24 hours') AS fresh, max(observed_at) AS latest
    FROM records_v""")
def _(v: View) -> DataFrame:
    return (
        v("records_v")
            .agg(
                F.count(F.lit(1)).alias("total"), F.count_if(F.col("observed_at") >= now() - F.expr("INTERVAL '24' HOUR")).alias("fresh"),
                F.max("observed_at").alias("latest")
            )
    )


@query("kind_top20", "SELECT kind, count(*) AS n, max(observed_at) AS latest FROM records_v GROUP BY kind ORDER BY n DESC, kind LIMIT 20")
def _(v: View) -> DataFrame:
    return v("records_v").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.max("observed_at").alias("latest")).orderBy(F.desc("n"), "kind").limit(20)


@query("worker_load", """SELECT node_id, max_concurrency, COALESCE(sum(t.slot_cost), 0)::BIGINT AS used FROM workers_v LEFT JOIN (SELECT * FROM tasks_v
    WHERE status = 'running') t ON locked_by = node_id GROUP BY node_id, max_concurrency""")
def _(v: View) -> DataFrame:
    used = v("tasks_v").where("status = 'running'").groupBy(F.col("locked_by").alias("node_id")).agg(F.sum("slot_cost").alias("used"))
    return v("workers_v").select("node_id", "max_concurrency").join(used, "node_id", "left").fillna(0, ["used"])


@query("running_backfill_slots", """SELECT locked_by AS node_id, COALESCE(sum(slot_cost), 0)::BIGINT AS slots FROM tasks_v WHERE status = 'running'
    AND workload = 'backfill' GROUP BY locked_by""")
def _(v: View) -> DataFrame:
    return (
        v("tasks_v").where("status = 'running' AND workload = 'backfill'").groupBy(F.col("locked_by").alias("node_id"))
            .agg(F.coalesce(F.sum("slot_cost"), F.lit(0)).alias("slots"))
    )


@query("metrics_lines", """SELECT 'feedloom_tasks{status=\"' || status || '\"} ' || count(*) AS line FROM tasks_v GROUP BY status UNION ALL
    SELECT 'feedloom_workers{state=\"' || effective_state || '\"} ' || count(*) FROM workers_v GROUP BY effective_state""")
def _(v: View) -> DataFrame:
    line = lambda df, metric, label, by: df.groupBy(by).count().select(F.format_string(f'{metric}{{{label}="%s"}} %d', by, "count").alias("line"))
    return line(v("tasks_v"), "feedloom_tasks", "status", "status").unionByName(line(v("workers_v"), "feedloom_workers", "state", "effective_state"))


ABLE = "EXISTS (SELECT 1 FROM workers_v w WHERE w.effective_state = 'online' AND list_contains(string_split(w.queues_csv, ','), t.queue) AND list_has_all(string_split(w.caps_csv, ','), string_split(t.caps_csv, ',')))"


@query("stuck_tasks", f"""SELECT id, source_id, queue, CASE WHEN caps_csv = '' THEN 'unroutable' ELSE 'no_capable_worker' END AS reason FROM tasks_v t
    WHERE status IN ('pending', 'retry') AND (caps_csv = '' OR NOT {ABLE}) ORDER BY created_at, id LIMIT 200""")
def _(v: View) -> DataFrame:
    return scheduling.stuck_tasks(v("tasks_v"), v("workers_v")).select("id", "source_id", "queue", "reason")


# scheduling
@query("due_schedules", f"""SELECT schedule_id, source_id, next_run_at FROM schedules_v JOIN (SELECT source_id FROM sources_v
    WHERE enabled) s USING (source_id) WHERE enabled AND active_task_id IS NULL AND next_run_at <= {NOW_SQL}
    ORDER BY next_run_at, schedule_id LIMIT 500""")
def _(v: View) -> DataFrame:
    return scheduling.due_schedules(v("schedules_v"), v("sources_v"), AS_OF).select("schedule_id", "source_id", "next_run_at")


@query("dedupe_registration", """SELECT DISTINCT n.key AS dedupe_key FROM (SELECT concat('task:', o_orderkey * 2) AS key FROM orders) n
    WHERE n.key NOT IN (SELECT dedupe_key FROM tasks_v UNION ALL SELECT dedupe_key FROM runs_v)""")
def _(v: View) -> DataFrame:
    return scheduling.not_registered(v("orders").select(F.concat(F.lit("task:"), F.col("o_orderkey") * 2).alias("dedupe_key")), v("tasks_v"), v("runs_v"))


@query("reconcile_sources", """SELECT COALESCE(c.source_id, s.source_id) AS source_id, CASE WHEN s.source_id IS NULL THEN 'insert' WHEN c.source_id IS NULL
    AND s.managed_by = 'config' THEN 'retire' WHEN c.source_id IS NULL THEN 'keep' ELSE 'update' END AS action FROM (SELECT *
    FROM sources_v WHERE n % 4 <> 0) c FULL JOIN (SELECT * FROM sources_v WHERE n % 5 <> 0) s ON c.source_id = s.source_id
    WHERE COALESCE(c.source_id, s.source_id) IS NOT NULL""")
def _(v: View) -> DataFrame:
    config, stored = v("sources_v").where("n % 4 <> 0").select("source_id", F.lit(True).alias("c")), v("sources_v").where("n % 5 <> 0").select("source_id", "managed_by")
    action = (
        F.when(F.col("managed_by").isNull(), "insert").when(
            F.col("c").isNull() & (F.col("managed_by") == "config"), "retire"
        ).when(F.col("c").isNull(), "keep").otherwise("update")
    )
    return config.join(stored, "source_id", "full").select("source_id", action.alias("action"))


@query("retire_sources", "SELECT schedule_id FROM schedules_v WHERE source_id IN (SELECT source_id FROM sources_v WHERE NOT enabled)")
def _(v: View) -> DataFrame:
    return v("schedules_v").join(v("sources_v").where("NOT enabled").select("source_id"), "source_id", "left_semi").select("schedule_id")


@query("duplicate_key_check", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(v: View) -> DataFrame:
    return v("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("hash_spread", """SELECT source_id, sha256(source_id)[1:16] AS hash16, list_reduce(list_transform(range(1, 65), lambda i: CAST(instr('0123456789abcdef', substr(sha256(source_id), i, 1)) - 1 AS BIGINT)), lambda a, d: (a * 16 + d) % 60) AS spread
    FROM sources_v""")
def _(v: View) -> DataFrame:
    return (
        v("sources_v")
            .select(
                "source_id", F.left(F.sha2("source_id", 256), F.lit(16)).alias("hash16"), expr.hash_modulo(F.col("source_id"), 60).alias("spread")
            )
    )


@query("backfill_windows", """SELECT source_id, w AS window_start, least(hi, w + INTERVAL '604800 seconds') AS window_end
    FROM (SELECT source_id, hi, unnest(generate_series(lo, hi, INTERVAL '604800 seconds')) AS w
    FROM (SELECT source_id, min(created_at) AS lo, max(created_at) AS hi FROM tasks_v GROUP BY source_id)) WHERE w < hi""")
def _(v: View) -> DataFrame:
    ranges = v("tasks_v").groupBy("source_id").agg(F.min("created_at").alias("range_start"), F.max("created_at").alias("range_end"))
    return scheduling.backfill_windows(ranges, 604_800).select("source_id", "window_start", "window_end")


@query(
    "batch_progress",
    """SELECT b.id AS id, any_value(total_tasks) AS total, count(r.batch_id) AS completed, count(r.batch_id) FILTER (WHERE final_status
    IN ('partial', 'dead')) AS failed,
       CASE WHEN count(r.batch_id) = 0 OR count(r.batch_id) < any_value(total_tasks) THEN any_value(b.status)
    WHEN bool_or(final_status IN ('partial', 'dead')) THEN 'partial' ELSE 'completed' END AS status
FROM totals_v b LEFT JOIN runs_v r ON r.batch_id = b.id GROUP BY b.id""",
)
def _(v: View) -> DataFrame:
    return transitions.finish_batches(v("totals_v"), v("runs_v"))


@query("batch_cancel", "SELECT id FROM tasks_v WHERE status IN ('pending', 'retry') AND batch_id IN (SELECT id FROM batches_v WHERE status = 'cancelled')")
def _(v: View) -> DataFrame:
    gone = v("batches_v").where("status = 'cancelled'").select(F.col("id").alias("batch_id"))
    return v("tasks_v").where(F.col("status").isin("pending", "retry")).join(gone, "batch_id", "left_semi").select("id")


CLAIM = f"""cand AS (SELECT node_id, t.id, t.slot_cost, row_number() OVER (PARTITION BY node_id ORDER BY t.priority, t.not_before, t.id) AS n FROM tasks_v t JOIN workers_v w
ON w.effective_state = 'online' AND list_contains(string_split(w.queues_csv, ','), t.queue) AND (t.caps_csv = '' OR list_has_all(string_split(w.caps_csv, ','), string_split(t.caps_csv, ','))) AND (t.preferred_worker IS NULL OR t.preferred_worker = w.node_id)
WHERE t.status IN ('pending', 'retry') AND t.not_before <= {NOW_SQL} AND (t.batch_id IS NULL OR EXISTS (SELECT 1 FROM batches_v b WHERE b.id = t.batch_id AND b.status = 'running')))"""


def candidates(v: View) -> DataFrame:
    return scheduling.claim_candidates(v("tasks_v"), v("workers_v"), v("batches_v"), AS_OF)


query("claim_candidates", f"WITH {CLAIM} SELECT node_id, id, slot_cost, CAST(n AS INT) AS n FROM cand WHERE n <= 200")(
    lambda v: (
        candidates(v).select("node_id", "id", "slot_cost", "n")
    )
)
# workers have room for what they run and some slots more
BUDGET = """budget AS (SELECT node_id, greatest(max_concurrency - COALESCE(sum(slot_cost), 0), 0) AS slots, CASE WHEN mode = 'resident' THEN backfill_quota - COALESCE(sum(slot_cost) FILTER (WHERE workload = 'backfill'), 0) ELSE 1000000 END AS quota
  FROM staffed_v LEFT JOIN (SELECT * FROM tasks_v WHERE status = 'running') t ON locked_by = node_id GROUP BY node_id, max_concurrency, mode, backfill_quota)"""
OFFERED = f"""fits AS (SELECT t.*, node_id, row_number() OVER (PARTITION BY t.id ORDER BY node_id) AS k, count(*) OVER (PARTITION BY t.id) AS c FROM tasks_v t JOIN workers_v w
ON w.effective_state = 'online' AND list_contains(string_split(w.queues_csv, ','), t.queue) AND (t.caps_csv = '' OR list_has_all(string_split(w.caps_csv, ','), string_split(t.caps_csv, ',')))
WHERE t.status IN ('pending', 'retry') AND t.not_before <= {NOW_SQL} AND (t.batch_id IS NULL OR EXISTS (SELECT 1 FROM batches_v b WHERE b.id = t.batch_id AND b.status = 'running'))),
cand AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY priority, not_before, id) AS n FROM fits WHERE CASE WHEN preferred_worker IS NULL THEN k = 1 + id % c ELSE node_id = preferred_worker END),
{BUDGET}"""


@query(
    "claim_greedy",
    f"""WITH RECURSIVE {OFFERED}, walk AS (SELECT node_id, CAST(0 AS BIGINT) AS id, CAST(0 AS INT) AS slot_cost, CAST(0 AS BIGINT) AS n, slots AS rem, quota AS q, false AS took
    FROM budget UNION ALL
SELECT c.node_id, c.id, c.slot_cost, c.n, CASE WHEN x.ok THEN w.rem - c.slot_cost ELSE w.rem END, CASE WHEN x.ok
    AND c.workload = 'backfill' THEN w.q - c.slot_cost ELSE w.q END, x.ok
FROM walk w JOIN cand c ON c.node_id = w.node_id AND c.n = w.n + 1, LATERAL (SELECT c.slot_cost <= w.rem
    AND (c.workload <> 'backfill' OR c.slot_cost <= w.q) AS ok) x WHERE c.n <= 200)
SELECT node_id, id, slot_cost, CAST(n AS INT) AS n FROM walk WHERE took""",
)
def _(v: View) -> DataFrame:
    offered = scheduling.offers(v("tasks_v"), v("workers_v"), v("batches_v"), AS_OF)
    slots = scheduling.slots_left(v("staffed_v"), v("tasks_v"), F.col("backfill_quota"))
    return scheduling.claim_greedy(offered, slots).select("node_id", "id", "slot_cost", "n")


# one worker with resources: a task needs none, one of three a, the one b (a lease holds the second slot of a), or both
@query(
    "claim_worker",
    f"""WITH RECURSIVE {CLAIM}, own AS (SELECT c.n, c.id, c.slot_cost, t.need IN (1, 3) AS a, t.need IN (2, 3) AS b FROM cand c
    JOIN leased_v t USING (id) WHERE c.node_id = 'n-5' AND c.n <= 200),
walk AS (SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS id, CAST(0 AS INT) AS slot_cost, 9 AS rem, [2] AS ha, CAST([] AS INT[]) AS hb, false AS took, CAST(NULL AS INT) AS sa, CAST(NULL AS INT) AS sb
    UNION ALL
SELECT o.n, o.id, o.slot_cost, CASE WHEN x.ok THEN w.rem - o.slot_cost ELSE w.rem END, CASE WHEN x.ok
    AND o.a THEN list_append(w.ha, x.fa) ELSE w.ha END, CASE WHEN x.ok AND o.b THEN list_append(w.hb, x.fb) ELSE w.hb END, x.ok,
  CASE WHEN x.ok AND o.a THEN x.fa END, CASE WHEN x.ok AND o.b THEN x.fb END
FROM walk w JOIN own o ON o.n = w.n + 1, LATERAL (SELECT *, o.slot_cost <= w.rem AND (NOT o.a OR fa IS NOT NULL)
    AND (NOT o.b OR fb IS NOT NULL) AS ok
  FROM (SELECT CASE WHEN NOT list_contains(w.ha, 1) THEN 1 WHEN NOT list_contains(w.ha, 2) THEN 2
    WHEN NOT list_contains(w.ha, 3) THEN 3 END AS fa, CASE WHEN NOT list_contains(w.hb, 1) THEN 1 END AS fb)) x)
SELECT id, slot_cost, CAST(n AS INT) AS n, concat_ws(',', 'a=' || sa, 'b=' || sb) AS leases FROM walk WHERE took""",
)
def _(v: View) -> DataFrame:
    need = F.expr("CASE need WHEN 0 THEN map() WHEN 1 THEN map('a', 3) WHEN 2 THEN map('b', 1) ELSE map('a', 3, 'b', 1) END").cast("map<string,int>")
    node = v("workers_v").where("node_id = 'n-5'")
    rows = scheduling.claim_candidates(v("leased_v").withColumn("resources", need), node, v("batches_v"), AS_OF)
    leases = (
        v("leases_v").where("resource_key = 'domain:ASIA' AND slot = 2")
            .select(F.lit("a").alias("resource_key"), "slot", F.expr("TIMESTAMP_NTZ '2030-01-01 00:00:00'").alias("expires_at"))
    )
    slots = node.select("node_id", F.col("max_concurrency").alias("slots"), F.lit(None).cast("long").alias("backfill_left"))
    taken = scheduling.claim_greedy(rows, slots, scheduling.held_slots(leases, AS_OF))
    return (
        taken
            .select(
                "id", "slot_cost", "n",
                F.array_join(F.transform("leases", lambda x: F.concat_ws("=", x["key"], x["slot"].cast("string"))), ",").alias("leases")
            )
    )


@query("free_slot", f"""SELECT k AS resource_key, CAST(min(s) AS INT) AS slot FROM (SELECT k, unnest(range(1, 6)) AS s
    FROM (SELECT DISTINCT resource_key AS k FROM leases_v)) x WHERE NOT EXISTS (SELECT 1 FROM leases_v l WHERE l.resource_key = k
    AND l.slot = s AND l.expires_at > {NOW_SQL}) GROUP BY k""")
def _(v: View) -> DataFrame:
    return scheduling.free_slots(v("leases_v").select("resource_key").distinct().withColumn("capacity", F.lit(5)), v("leases_v"), AS_OF)


query("expired_leases", f"SELECT resource_key, slot, task_id FROM leases_v WHERE expires_at <= {NOW_SQL}")(
    lambda v: (
        v("leases_v").where(F.col("expires_at") <= now()).select("resource_key", "slot", "task_id")
    )
)
query("resource_entries", "SELECT task_id, string_agg(resource_key || '=' || slot, ',' ORDER BY resource_key, slot) AS entries FROM leases_v GROUP BY task_id")(
    lambda v: (
        v("leases_v").groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("resource_key", "slot"))).alias("e"))
            .select(
                "task_id",
                F.array_join(F.transform("e", lambda x: F.concat_ws("=", x["resource_key"], x["slot"].cast("string"))), ",").alias("entries")
            )
    )
)


@query("retry_decision", """SELECT task_id, COALESCE(error_class IN ('transient', 'rate_limited', 'timeout', 'network', 'unknown')
    AND attempts < 3, false) AS retry, least(3600.0::DOUBLE, 30 * pow(2.0, greatest(attempts - 1, 0))) AS delay FROM runs_v
    WHERE final_status = 'dead'""")
def _(v: View) -> DataFrame:
    dead = v("runs_v").where("final_status = 'dead'")
    return (
        dead
            .select(
                "task_id", expr.retryable(F.col("error_class"), F.col("attempts"), F.lit(3)).alias("retry"),
                expr.retry_delay(F.col("attempts")).alias("delay")
            )
    )


@query("retry_after_parse", """SELECT task_id, CASE WHEN task_id % 3 = 0 THEN least(3600.0, attempts * 1000.0)::DOUBLE ELSE 30.0::DOUBLE END AS seconds
    FROM runs_v""")
def _(v: View) -> DataFrame:
    header = F.when(F.col("task_id") % 3 == 0, (F.col("attempts") * 1000).cast("string")).otherwise(F.lit("soon"))
    return v("runs_v").select("task_id", expr.retry_after_seconds(header, now(), 30.0).alias("seconds"))


query("stale_tasks", f"""SELECT id, attempts, {NOW_SQL} + INTERVAL '15 seconds' AS not_before FROM tasks_v WHERE status = 'running'
    AND locked_at < {NOW_SQL} - INTERVAL '180 seconds'""")(
    lambda v: (
        v("tasks_v").where((F.col("status") == "running") & (F.col("locked_at") < now() - F.expr("INTERVAL '180' SECOND")))
            .select("id", "attempts", (now() + F.expr("INTERVAL '15' SECOND")).alias("not_before"))
    )
)
query("latest_heartbeat", "SELECT worker_id, max(finished_at) AS beat FROM runs_v GROUP BY worker_id")(
    lambda v: (
        v("runs_v").groupBy("worker_id").agg(F.max("finished_at").alias("beat"))
    )
)
query("offline_workers", "SELECT worker_id FROM runs_v GROUP BY worker_id HAVING max(finished_at) < TIMESTAMP '2024-02-01 00:00:00' - INTERVAL '60 seconds'")(
    lambda v: (
        v("runs_v").groupBy("worker_id").agg(F.max("finished_at").alias("beat"))
            .where(F.col("beat") < F.expr("TIMESTAMP_NTZ '2024-02-01 00:00:00' - INTERVAL '60' SECOND")).select("worker_id")
    )
)


@query("complete_guard", """SELECT r.task_id AS task_id, CASE WHEN t.id IS NULL THEN 'lease_lost' ELSE 'accepted' END AS outcome FROM reports_v r LEFT
    JOIN leased_v t ON t.id = r.task_id AND t.lease_token = r.lease_token AND t.status = 'running'""")
def _(v: View) -> DataFrame:
    return transitions.guarded(v("leased_v"), v("reports_v")).select("task_id", F.when(F.col("accepted"), "accepted").otherwise("lease_lost").alias("outcome"))


@query("archive_runs", f"""SELECT id AS task_id, dedupe_key, epoch_us({NOW_SQL}) / 1e6 - epoch_us(locked_at) / 1e6 AS duration_seconds FROM tasks_v t
    WHERE status = 'running' AND NOT EXISTS (SELECT 1 FROM runs_v r WHERE r.dedupe_key = t.dedupe_key)""")
def _(v: View) -> DataFrame:
    micros = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    return (
        v("tasks_v").where("status = 'running'").join(v("runs_v").select("dedupe_key"), "dedupe_key", "left_anti")
            .select(F.col("id").alias("task_id"), "dedupe_key", (micros(now()) - micros(F.col("locked_at"))).alias("duration_seconds"))
    )


@query("next_run", f"""SELECT source_id, CASE WHEN schedule_type = 'interval' THEN {NOW_SQL} + schedule_seconds * INTERVAL '1 second'
    WHEN n > 10 THEN {NOW_SQL} + n * INTERVAL '1 hour' - INTERVAL '10 hours' END AS next_run_at FROM sources_v
    WHERE schedule_type <> 'cron'""")
def _(v: View) -> DataFrame:
    once = F.expr("TIMESTAMP_NTZ '2024-01-30 00:00:00' + n * INTERVAL '1' HOUR - INTERVAL '10' HOUR")
    rows = v("sources_v").where("schedule_type <> 'cron'")
    return (
        rows
            .select(
                "source_id",
                scheduling.next_run(F.col("schedule_type"), F.col("schedule_seconds"), once, F.lit("0 9 * * *"), F.lit("UTC"), now())
                    .alias("next_run_at")
            )
    )


# lines, what they say of a local time t in SQL, and a zone with its hours
CRON = (
    ("0 9 * * *", "hour(t) = 9 AND minute(t) = 0", "Asia/Shanghai", 8),
    ("*/15 8-17 * * MON-fri", "minute(t) % 15 = 0 AND hour(t) BETWEEN 8 AND 17 AND dayofweek(t) BETWEEN 1 AND 5", "Asia/Kolkata", 5.5),
    ("@monthly", "day(t) = 1 AND hour(t) = 0 AND minute(t) = 0", "UTC", 0),
    ("30 6 L * ?", "t::DATE = last_day(t::DATE) AND hour(t) = 6 AND minute(t) = 30", "America/Phoenix", -7),
    ("0 12 * * fri#2", "dayofweek(t) = 5 AND (day(t) + 6) // 7 = 2 AND hour(t) = 12 AND minute(t) = 0", "UTC", 0),
    ("15 3 1,15 feb,mar 2", "month(t) IN (2, 3) AND (day(t) IN (1, 15) OR dayofweek(t) = 2) AND hour(t) = 3 AND minute(t) = 15", "UTC", 0),
    ("0 9 31 2 *", "false", "UTC", 0),
    ("0 25 * * *", "false", "UTC", 0),
)
CRON_SQL = f"""WITH minutes AS (SELECT unnest(generate_series({NOW_SQL} + INTERVAL 1 MINUTE, {NOW_SQL} + INTERVAL 120 DAY, INTERVAL 1 MINUTE)) AS u),
found AS ({" UNION ALL ".join(f"SELECT {k} AS k, min(u) AS due FROM (SELECT u, u + INTERVAL '{int(h * 60)} minutes' AS t FROM minutes) WHERE {fits}" for k, (_, fits, _, h) in enumerate(CRON))})
SELECT source_id, due AS next_run_at, CASE WHEN k = 7 THEN 'hour' END AS error FROM sources_v JOIN found ON k = n % 8"""


@query("next_run_cron", CRON_SQL)
def _(v: View) -> DataFrame:
    pick = lambda i: F.element_at(F.array(*[F.lit(c[i]) for c in CRON]), (F.col("n") % len(CRON) + 1).cast("int"))
    rows = v("sources_v").select("source_id", cron.next_time(pick(0), pick(2), now()).alias("r"))
    return rows.select("source_id", F.col("r.at").alias("next_run_at"), F.col("r.error").alias("error"))


# versioned upsert
def hashed(v: View) -> DataFrame:
    arrivals = v("arrivals_v")
    return arrivals.withColumn("content_hash", expr.record_hash(arrivals.columns))


def record_hash_sql(given: dict[str, str]) -> str:
    """The record hash in DuckDB, from a text for each of the nine fields that there is."""
    part = lambda c: f"COALESCE(length({given[c]}) || ':' || {given[c]}, '-')" if c in given else "'-'"
    return f"sha256(concat({', '.join(part(c) for c in expr.HASHED)}))"


OUTCOMES = """SELECT source_id, external_id, seq, CASE WHEN b IS NULL THEN 'added' WHEN b <> content THEN 'updated'
    ELSE 'duplicate' END AS outcome FROM (SELECT *, lag(content) OVER (PARTITION BY source_id, external_id ORDER BY seq) AS b
    FROM arrivals_v)"""
query("upsert_outcomes", f"SELECT source_id, outcome, count(*) AS n FROM ({OUTCOMES}) GROUP BY source_id, outcome")(
    lambda v: upsert.outcomes(hashed(v)).groupBy("source_id", "outcome").agg(F.count(F.lit(1)).alias("n"))
)
query("current_state", "SELECT source_id, external_id, arg_max(content, seq) AS content, max(seq) AS seq FROM arrivals_v GROUP BY source_id, external_id")(
    lambda v: upsert.current_state(v("arrivals_v")).select("source_id", "external_id", "content", "seq")
)
query("version_history", f"""SELECT source_id, external_id, {record_hash_sql({'content': 'content'})} AS content_hash, min(seq) AS seq FROM arrivals_v
    GROUP BY source_id, external_id, content""")(
    lambda v: upsert.version_history(hashed(v)).select("source_id", "external_id", "content_hash", "seq")
)
RECORD = {c: c for c in ("kind", "url", "title", "content", "content_type", "language")}
query("content_hash", f"SELECT source_id, external_id, {record_hash_sql(RECORD)} AS content_hash FROM records_v")(
    lambda v: (
        v("records_v").select("source_id", "external_id", expr.record_hash(v("records_v").columns).alias("content_hash"))
    )
)
query("stable_id", "SELECT external_id, sha256(concat(source_id, '|', COALESCE(url, ''), '|', title)) AS stable_id FROM records_v")(
    lambda v: (
        v("records_v").select("external_id", expr.stable_id(F.col("source_id"), F.col("url"), F.col("title")).alias("stable_id"))
    )
)


@query("checkpoint_merge", """SELECT COALESCE(f.source_id, s.source_id) AS source_id, COALESCE(f.checkpoint, s.checkpoint) AS checkpoint, COALESCE(f.etag, s.etag) AS etag, s.last_modified AS last_modified
    FROM (SELECT source_id, 'a' AS checkpoint, 'e' || n AS etag, 'm' AS last_modified FROM sources_v WHERE n % 2 = 0) s FULL
    JOIN (SELECT source_id, 'b' AS checkpoint, CASE WHEN n % 4 = 0 THEN 'new' END AS etag FROM sources_v WHERE n % 3 = 0) f
    ON s.source_id = f.source_id""")
def _(v: View) -> DataFrame:
    s = v("sources_v")
    stored = s.where("n % 2 = 0").selectExpr("source_id", "'a' AS checkpoint", "concat('e', n) AS etag", "'m' AS last_modified")
    return (
        upsert.merge_checkpoints(
            stored,
            s.where("n % 3 = 0")
                .selectExpr("source_id", "'b' AS checkpoint", "CASE WHEN n % 4 = 0 THEN 'new' END AS etag", "CAST(NULL AS STRING) AS last_modified")
        )
    )


query("changed_sources_only", "SELECT source_id FROM sources_v WHERE NOT (n % 3 = 0 AND 'v' || (n % 2) = 'v0')")(
    lambda v: (
        v("sources_v").select("source_id", F.concat(F.lit("v"), F.col("n") % 2).alias("etag"))
            .join(v("sources_v").where("n % 3 = 0").select("source_id", F.lit("v0").alias("etag")), ["source_id", "etag"], "left_anti")
            .select("source_id")
    )
)
query("asset_upsert", "SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type")(
    lambda v: (
        v("events").groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("value"))
    )
)
query("asset_path", """SELECT page_id, COALESCE(NULLIF(substr(regexp_replace(regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), 1, 100), ''), sha256(url)[1:20]) AS segment
    FROM pages""")(lambda v: v("pages").select("page_id", expr.path_segment(F.col("url")).alias("segment")))
query("micro_batches", """SELECT source_id, CAST((rn - 1) // 100 AS INT) AS flush, count(*) AS n
    FROM (SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY seq) AS rn FROM records_v) GROUP BY ALL""")(
    lambda v: (
        extract.micro_batches(v("records_v")).groupBy("source_id", "flush").agg(F.count(F.lit(1)).alias("n"))
    )
)
query("fetch_counters", """SELECT source_id, count(*) AS seen, CAST(sum(length(content)) AS BIGINT) AS characters, CAST(sum(octet_length(encode(content))) AS BIGINT) AS bytes
    FROM records_v GROUP BY source_id""")(
    lambda v: (
        v("records_v").groupBy("source_id")
            .agg(F.count(F.lit(1)).alias("seen"), F.sum(F.length("content")).alias("characters"), F.sum(F.octet_length("content")).alias("bytes"))
    )
)

# extraction
TEXT = "NULLIF(trim(regexp_replace(regexp_extract(html, '<{0}(?:\\s[^>]*)?>(.*?)</{0}>', 1, 's'), '<[^>]*>', '', 'g')), '')"
PAGES = f"(SELECT page_id, url, COALESCE({TEXT.format('h1')}, {TEXT.format('title')}) AS title, COALESCE({TEXT.format('article')}, {TEXT.format('body')}) AS content FROM pages)"
HREFS = "(SELECT page_id, h, generate_subscripts(h, 1) - 1 AS pos, unnest(h) AS href FROM (SELECT page_id, list_filter(x, lambda y, i: list_position(x, y) = i) AS h FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS x FROM pages)))"
query("page_extract", f"SELECT CAST(page_id AS VARCHAR) AS external_id, url, title, content FROM {PAGES}")(lambda v: extract.pages_to_records(v("pages")))
query("link_explode", f"SELECT page_id, CAST(pos AS INT) AS pos, href FROM {HREFS} WHERE pos < 5")(lambda v: extract.links(v("pages"), 5))
query("page_assets", f"SELECT page_id, CAST(pos AS INT) AS pos, sha256(href)[1:12] AS asset_key FROM {HREFS}")(
    lambda v: (
        extract.links(v("pages")).select("page_id", "pos", F.left(F.sha2("href", 256), F.lit(12)).alias("asset_key"))
    )
)
query("fulltext_enrich", f"""SELECT p.page_id AS page_id, CASE WHEN length(content) > length(substr(title, 1, 20)) THEN content
    ELSE substr(title, 1, 20) END AS content FROM {PAGES} p""")(
    lambda v: (
        extract.enriched(
            extract.pages_to_records(v("pages"))
                .select(F.col("external_id").cast("long").alias("page_id"), "url", F.left("title", F.lit(20)).alias("content")),
            extract.pages_to_records(v("pages"))
        )
            .select("page_id", "content")
    )
)
query("json_field_map", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")(
    lambda v: (
        extract.json_records(
            v("events").select("event_id", F.concat(F.lit('{"data":['), "props", F.lit("]}")).alias("payload")), "payload", "$.data", {"k": "$.k"}
        )
    )
)
query("rss_items", """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'id-' || page_id ELSE 'http://x/' || page_id END AS external_id, CASE
    WHEN page_id % 3 = 0 THEN 't' || page_id ELSE 'd' END AS content, TIMESTAMP '2024-01-02 03:04:05' AS published_at FROM pages""")(
    lambda v: (
        extract.rss_items(
            v("pages")
                .selectExpr(
                    "page_id",
                    "concat('<rss><channel><title>c</title><item><guid>', CASE WHEN page_id % 2 = 0 THEN concat('id-', page_id) ELSE '' END, '</guid><link>http://x/', page_id, '</link><title>t', page_id, '</title><description>', CASE WHEN page_id % 3 = 0 THEN '' ELSE 'd' END, '</description><pubDate>Tue, 2 Jan 2024 03:04:05 GMT</pubDate></item></channel></rss>') AS payload"
                )
        )
            .select("page_id", "external_id", "content", F.col("published_at").cast("timestamp_ntz").alias("published_at"))
    )
)
query("sitemap_locs", "SELECT page_id, 'http://x/' || page_id AS loc, page_id % 2 = 0 AS is_index FROM pages")(
    lambda v: (
        extract.sitemap_locs(
            v("pages")
                .selectExpr(
                    "page_id",
                    "concat(CASE WHEN page_id % 2 = 0 THEN '<sitemapindex><sitemap>' ELSE '<urlset><url>' END, '<loc> http://x/', page_id, ' </loc>', CASE WHEN page_id % 2 = 0 THEN '</sitemap></sitemapindex>' ELSE '</url></urlset>' END) AS payload"
                )
        )
            .select("page_id", "loc", "is_index")
    )
)
query("external_id_coalesce", """SELECT seq, CASE WHEN seq % 2 = 0 THEN external_id WHEN title <> '' THEN title ELSE sha256(content) END AS external_id
    FROM records_v""")(
    lambda v: (
        v("records_v")
            .select(
                "seq",
                expr.first_filled(F.when(F.col("seq") % 2 == 0, F.col("external_id")).otherwise(""), F.col("title"), F.sha2("content", 256))
                    .alias("external_id")
            )
    )
)
query("attribute_map", "SELECT event_id, 'event_type=' || event_type || ',user_id=' || user_id AS attributes FROM events")(
    lambda v: (
        v("events")
            .select(
                "event_id",
                F.map_filter(
                    F.create_map(
                        F.lit("event_type"), "event_type", F.lit("none"), F.lit(None).cast("string"), F.lit("user_id"),
                        F.col("user_id").cast("string")
                    ),
                    lambda k, x: x.isNotNull() & ~k.isin("external_id", "title")
                )
                    .alias("m")
            )
            .select(
                "event_id",
                F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("attributes")
            )
    )
)
query("url_parts", """SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host, regexp_extract(url, '^([a-z]+://[^?#]*)', 1) AS redacted
    FROM pages""")(
    lambda v: (
        v("pages")
            .select(
                "page_id", F.try_parse_url("url", F.lit("PROTOCOL")).alias("scheme"), F.try_parse_url("url", F.lit("HOST")).alias("host"),
                expr.redacted_url(F.col("url")).alias("redacted")
            )
    )
)
query("content_type_filter", "SELECT event_id FROM events WHERE event_type IN ('click', 'view', 'error')")(
    lambda v: (
        v("events")
            .where(
                expr.content_type_allowed(
                    F.expr(
                        "CASE event_type WHEN 'click' THEN 'Application/JSON; charset=utf-8' WHEN 'view' THEN 'application/feed+json' WHEN 'error' THEN '' ELSE 'text/html' END"
                    ),
                    ["application/json"]
                )
            )
            .select("event_id")
    )
)
query("parse_time", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE o_orderdate END AS t FROM orders")(
    lambda v: (
        v("orders")
            .select(
                "o_orderkey",
                expr.parse_time(
                    F.expr(
                        "CASE o_orderkey % 3 WHEN 0 THEN date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") WHEN 1 THEN concat(date_format(o_orderdate, 'E, d MMM yyyy HH:mm:ss'), ' GMT') ELSE 'soon' END"
                    )
                ).cast("timestamp_ntz")
                    .alias("t")
            )
    )
)
query("capability_set", "SELECT source_id, CASE WHEN fetcher < 'sink:postgres' THEN fetcher || ',sink:postgres' END AS capabilities FROM sources_v")(
    lambda v: (
        v("sources_v")
            .select(
                "source_id",
                F.array_join(F.array_sort(F.array_distinct(F.array("fetcher", F.concat(F.lit("sink:"), "sink"), "fetcher"))), ",")
                    .alias("capabilities")
            )
    )
)
query("contract_validation", """SELECT source_id, regexp_full_match(source_id, '[A-Za-z0-9][A-Za-z0-9_.:-]{0,191}')
    AND (schedule_type <> 'interval' OR schedule_seconds >= 600) AS valid FROM sources_v""")(
    lambda v: (
        v("sources_v")
            .select(
                "source_id",
                (
                    F.col("source_id").rlike("^[A-Za-z0-9][A-Za-z0-9_.:-]{0,191}$") & (
                        (F.col("schedule_type") != "interval") | (F.col("schedule_seconds") >= 600)
                    )
                )
                    .alias("valid")
            )
    )
)
