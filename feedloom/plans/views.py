"""The data model's tables as views of the given ones, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")
VIEWS = {
    "sources_v": """SELECT source AS source_id, concat('fetcher:', CASE n % 5 WHEN 0 THEN 'rss' WHEN 1 THEN 'web_page' WHEN 2 THEN 'web_list' WHEN 3 THEN 'json_api' ELSE 'sitemap' END) AS fetcher,
       'postgres' AS sink, n % 7 <> 0 AS enabled, CASE WHEN n % 9 = 4 THEN 'api' ELSE 'config' END AS managed_by, n,
       CASE n % 3 WHEN 0 THEN 'interval' WHEN 1 THEN 'once' ELSE 'cron' END AS schedule_type, 60 * (n + 1) AS schedule_seconds
FROM (SELECT source, CAST(substr(source, 4) AS INT) AS n FROM documents GROUP BY source) s""",
    "schedules_v": """SELECT concat('source:', source_id) AS schedule_id, source_id, n % 7 <> 0 AS enabled,
       CASE WHEN n % 6 <> 5 THEN TIMESTAMP_LIT'2024-01-30 00:00:00' + n * INTERVAL '1' HOUR - INTERVAL '10' HOUR END AS next_run_at,
       CASE WHEN n % 8 = 3 THEN n END AS active_task_id
FROM sources_v""",
    "tasks_v": """SELECT o_orderkey AS id, concat('task:', o_orderkey) AS dedupe_key, concat('src', o_custkey % 20) AS source_id,
       CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'retry' ELSE 'running' END AS status,
       CASE WHEN o_orderkey % 5 = 0 THEN 'backfill' ELSE 'scheduled' END AS workload,
       CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 7 END AS batch_id,
       CAST(substr(o_orderpriority, 1, 1) AS INT) * 10 AS priority, o_orderdate AS not_before, o_orderdate AS created_at,
       CAST(1 + o_orderkey % 4 AS INT) AS slot_cost, CAST(1 + o_orderkey % 3 AS INT) AS attempts, 3 AS max_attempts,
       CASE o_orderkey % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'default' ELSE 'gpu' END AS queue,
       CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 2 = 0 THEN 'fetcher:rss,sink:postgres' ELSE 'fetcher:json_api,sink:postgres' END AS caps_csv,
       CASE WHEN o_orderkey % 10 = 0 THEN concat('n-', o_custkey % 8) END AS preferred_worker,
       CASE WHEN o_orderstatus = 'F' THEN concat('n-', o_custkey % 8) END AS locked_by,
       CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL '1' HOUR END AS locked_at
FROM orders""",
    "workers_v": """SELECT concat('n-', n_nationkey) AS node_id, CASE WHEN n_nationkey % 4 = 3 THEN 'offline' ELSE 'online' END AS effective_state,
       CASE WHEN n_nationkey % 2 = 0 THEN 'resident' ELSE 'burst' END AS mode, 4 + n_nationkey AS max_concurrency,
       CASE WHEN n_nationkey % 2 = 0 THEN 'fetcher:rss,sink:postgres' ELSE 'fetcher:json_api,fetcher:rss,sink:postgres' END AS caps_csv,
       CASE WHEN n_nationkey < 4 THEN 'default' ELSE 'default,web' END AS queues_csv
FROM nation WHERE n_nationkey < 8""",
    "staffed_v": """SELECT w.node_id, effective_state, mode, CAST(max_concurrency + COALESCE(used, 0) AS INT) AS max_concurrency, COALESCE(backfill, 0) + 3 AS backfill_quota, caps_csv, queues_csv
FROM workers_v w LEFT JOIN (SELECT locked_by, sum(slot_cost) AS used, sum(CASE WHEN workload = 'backfill' THEN slot_cost ELSE 0 END) AS backfill FROM tasks_v WHERE status = 'running' GROUP BY locked_by) u ON u.locked_by = w.node_id""",
    "batches_v": """SELECT CAST(n_nationkey AS BIGINT) AS id, CASE n_nationkey % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'paused' ELSE 'cancelled' END AS status FROM nation WHERE n_nationkey < 7""",
    "leased_v": """SELECT t.*, concat('lease-', id) AS lease_token, CASE WHEN id % 3 = 0 THEN concat('source:', source_id) END AS schedule_id,
       locked_at + INTERVAL '5' MINUTE AS heartbeat_at, 30 AS base_seconds, CAST(100 + id % 4000 AS INT) AS max_seconds, CASE WHEN id % 5 = 0 THEN 'fixed' ELSE 'exponential' END AS backoff,
       CAST(id % 4 AS INT) AS need
FROM tasks_v t""",
    "reports_v": """SELECT o_orderkey AS task_id, CASE WHEN o_orderkey % 7 = 0 THEN 'lease-old' ELSE concat('lease-', o_orderkey) END AS lease_token,
       CASE o_custkey % 4 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'partial' WHEN 2 THEN 'skipped' ELSE 'failed' END AS status, CAST(o_custkey % 50 AS INT) AS added,
       CASE o_custkey % 5 WHEN 0 THEN 'transient' WHEN 1 THEN 'rate_limited' WHEN 2 THEN 'permanent' WHEN 3 THEN 'network' ELSE 'configuration' END AS error_class,
       repeat('x', CAST(15990 + o_custkey % 20 AS INT)) AS message, CASE WHEN o_custkey % 5 = 1 THEN CAST(o_custkey * 7 - 100 AS DOUBLE) END AS retry_after
FROM orders WHERE o_orderkey % 2 = 0""",
    "runs_v": """SELECT event_id AS task_id, concat('task:', event_id * 3) AS dedupe_key, concat('src', user_id % 20) AS source_id, concat('n-', user_id % 8) AS worker_id,
       CASE event_type WHEN 'error' THEN 'dead' WHEN 'signup' THEN 'partial' WHEN 'view' THEN 'skipped' ELSE 'succeeded' END AS final_status,
       CASE event_type WHEN 'error' THEN CASE event_id % 4 WHEN 0 THEN 'transient' WHEN 1 THEN 'timeout' WHEN 2 THEN 'configuration' ELSE 'permanent' END END AS error_class,
       CASE WHEN event_id % 5 = 0 THEN event_id % 7 END AS batch_id, CAST(1 + event_id % 5 AS INT) AS attempts, CAST(floor(value) AS INT) AS rows_added, ts AS finished_at, props AS result_json
FROM events""",
    "records_v": """SELECT source AS source_id, CAST(doc_id AS STRING) AS external_id, CASE WHEN n_chars > 2000 THEN 'article' ELSE 'document' END AS kind, CAST(NULL AS STRING) AS url,
       substr(text, 1, 60) AS title, text AS content, 'text/plain' AS content_type, lang AS language, doc_id AS seq,
       TIMESTAMP_LIT'2024-01-01 00:00:00' + doc_id * INTERVAL '1' MINUTE AS observed_at
FROM documents""",
    "arrivals_v": """SELECT 'ev' AS source_id, CAST(user_id AS STRING) AS external_id, event_type AS content, event_id AS seq, ts AS observed_at FROM events
UNION ALL
SELECT 'cv', CAST(conv_id AS STRING), role, turn, TIMESTAMP_LIT'2024-01-01 00:00:00' + turn * INTERVAL '1' MINUTE FROM conversations""",
    "leases_v": """SELECT concat('domain:', r_name) AS resource_key, CAST(row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) AS INT) AS slot, n_nationkey AS task_id,
       TIMESTAMP_LIT'2024-01-30 00:00:00' + (n_nationkey - 12) * INTERVAL '1' HOUR AS expires_at
FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "totals_v": """SELECT b.id, b.status, r.n + CASE WHEN b.id % 2 = 1 THEN 1 ELSE 0 END AS total_tasks
FROM batches_v b JOIN (SELECT batch_id, count(*) AS n FROM runs_v WHERE batch_id <> 6 GROUP BY batch_id UNION ALL SELECT 6, 3 FROM nation WHERE n_nationkey = 0) r ON r.batch_id = b.id""",
    "requests_v": """SELECT c_custkey AS request, concat('src', c_custkey % 25) AS source_id, CASE WHEN c_custkey % 3 = 0 THEN concat('k', c_custkey % 50) END AS dedupe_key FROM customer""",
    "beats_v": """SELECT worker_id, max(finished_at) AS last_heartbeat_at FROM runs_v GROUP BY worker_id""",
    "shapes_v": """SELECT n_nationkey AS k, concat('http://s', n_nationkey % 5, '.example/feed/', n_nationkey) AS url, n_nationkey % 5 AS crawl FROM nation""",
}


def needed(sql: str) -> list[str]:
    """The views that the SQL names, those that they name first."""
    found: list[str] = []
    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql):
            found += [x for x in [*needed(VIEWS[name]), name] if x not in found]
    return found


def with_views(sql: str) -> str:
    """The SQL for DuckDB, views as common table expressions."""
    parts = [f"{name} AS ({VIEWS[name].replace('TIMESTAMP_LIT', 'TIMESTAMP ')})" for name in needed(sql)]
    own = re.match(r"\s*WITH (RECURSIVE )?", sql)
    if not parts:
        return sql
    return f"WITH {own[1] or ''}{', '.join(parts)}, {sql[own.end():]}" if own else f"WITH {', '.join(parts)} {sql}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or one of the given tables, without registering anything in the session."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    views = [*needed(VIEWS[name]), name]
    text = " ".join(VIEWS[v] for v in views)
    tables = [b for b in BASE if re.search(rf"\b{b}\b", text)]
    body = [f"{v} AS ({VIEWS[v].replace('TIMESTAMP_LIT', 'TIMESTAMP_NTZ ')})" for v in views]
    for b in tables:
        body = [re.sub(rf"\b(FROM|JOIN) {b}\b", rf"\1 {{{b}}}", x) for x in body]
    return spark.sql(f"WITH {', '.join(body)} SELECT * FROM {name}", **{b: view(spark, sf_dir, b) for b in tables})
