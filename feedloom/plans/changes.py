"""Queries of rows that heartbeats and reports change, and of specifications judged in columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.operators import changes
from feedloom.plans.catalog import View, query
from feedloom.plans.flows import BEATS
from feedloom.sinks import versioned
from feedloom.sources import catalogue, paged, registry

RETRIED = "error_class IN ('transient', 'rate_limited', 'timeout', 'network', 'unknown') AND attempts < max_attempts"

# a worker's beats are its runs' ends; every third worker was replaced since
query(
    "heartbeat_workers",
    "SELECT node_id, CASE WHEN mode = 'burst' THEN 'draining' ELSE 'online' END AS effective_state, max(finished_at) AS last_heartbeat_at FROM workers_v JOIN runs_v ON worker_id = node_id WHERE right(node_id, 1) NOT IN ('0', '3', '6') GROUP BY node_id, mode",
)(
    lambda v: changes.beaten_workers(
        v("workers_v").select("node_id", F.lit("new").alias("instance_id"), F.expr("CASE WHEN mode = 'burst' THEN 'draining' ELSE 'online' END").alias("desired_state")),
        v("runs_v").select(F.col("worker_id").alias("node_id"), F.expr("CASE WHEN right(worker_id, 1) IN ('0', '3', '6') THEN 'old' ELSE 'new' END").alias("instance_id"), F.col("finished_at").alias("ts")),
    )
)


@query("heartbeat_tasks", f"SELECT task_id AS id, max(ts) AS heartbeat_at FROM ({BEATS}) WHERE lease_token <> 'lease-old' GROUP BY task_id")
def _(v: View):
    thrice = v("nation").where("n_nationkey < 3").select(F.col("n_nationkey").alias("b"))
    running = v("leased_v").where("status = 'running'").join(F.broadcast(thrice))  # three rows
    beats = running.selectExpr("id AS task_id", "locked_by AS worker_id", "CASE WHEN id % 3 = 0 THEN 'lease-old' ELSE concat('lease-', id) END AS lease_token", "locked_at + b * INTERVAL '10' MINUTE AS ts")
    return changes.beaten_tasks(v("leased_v"), beats)


# a lease of each running task whose number divides by four, beside the given ones
@query(
    "released_rows",
    f"""WITH l AS (SELECT resource_key, slot, CAST(task_id AS BIGINT) AS task_id FROM leases_v UNION ALL SELECT 'domain:x', CAST(id % 7 AS INT), id FROM leased_v WHERE status = 'running' AND id % 4 = 0),
told AS (SELECT t.id AS task_id, max(CASE WHEN r.status = 'failed' AND {RETRIED} THEN 0 ELSE 1 END) AS ended FROM reports_v r JOIN leased_v t ON t.id = r.task_id AND t.lease_token = r.lease_token WHERE t.status = 'running' GROUP BY t.id)
SELECT 'task' AS what, task_id, CAST(NULL AS VARCHAR) AS lease FROM told WHERE ended = 1 UNION ALL SELECT 'lease', task_id, resource_key || '=' || slot FROM l JOIN told USING (task_id)""",
)
def _(v: View):
    own = v("leased_v").where("status = 'running' AND id % 4 = 0").select(F.lit("domain:x").alias("resource_key"), (F.col("id") % 7).cast("int").alias("slot"), F.col("id").alias("task_id"))
    leases = v("leases_v").select("resource_key", "slot", F.col("task_id").cast("long").alias("task_id")).unionByName(own)
    rows = changes.released(v("leased_v"), v("reports_v"), leases)
    return rows.select("what", "task_id", F.concat("resource_key", F.lit("="), F.col("slot").cast("string")).alias("lease"))


SPECS = "SELECT concat(CASE WHEN n = 1 THEN '-' ELSE '' END, source_id) AS source_id, schedule_type, CASE WHEN n = 3 THEN NULL ELSE n * 3 END AS seconds, CASE WHEN n = 2 THEN '' ELSE '@daily' END AS cron, CASE WHEN n <> 4 THEN n END AS once_at, n * 80 - 300 AS priority, n * 6000 AS timeout_seconds, n * 9 - 20 AS slot_cost, 120 - n * 7 AS max_attempts, 90000 - n * 5000 AS base_seconds, n * 45000 AS max_seconds, n * 20 AS backfill_window_seconds FROM sources_v"
WRONG = " ".join(f"WHEN NOT ({name} BETWEEN {low} AND {high}) THEN '{name}'" for name, (low, high, _) in catalogue.BOUNDS.items())


@query(
    "spec_errors",
    f"""SELECT source_id, CASE WHEN NOT regexp_full_match(source_id, '[A-Za-z0-9][A-Za-z0-9_.:-]{{0,191}}') THEN 'id' WHEN NOT COALESCE(CASE schedule_type WHEN 'interval' THEN seconds IS NOT NULL WHEN 'cron' THEN cron <> '' ELSE once_at IS NOT NULL END, false) THEN 'schedule'
WHEN schedule_type = 'interval' AND seconds < 10 THEN 'seconds' {WRONG} END AS error FROM ({SPECS})""",
)
def _(v: View):
    columns = SPECS.removeprefix("SELECT ").removesuffix(" FROM sources_v")
    specs = v("sources_v").selectExpr(*[c.strip() for c in columns.replace("concat(CASE WHEN n = 1 THEN '-' ELSE '' END, source_id)", "CASE WHEN n = 1 THEN '-' || source_id ELSE source_id END").split(",")])
    return catalogue.judged(specs).select("source_id", "error")


query(
    "task_capabilities",
    """SELECT source_id, list_aggregate(list_sort(list_distinct(list_filter(list_concat([fetcher, 'sink:' || sink, CASE WHEN n % 4 = 1 THEN 'asset_store:folder' END], CASE WHEN n % 3 = 0 THEN ['gpu', 'fetcher:rss'] ELSE [] END), lambda x: x IS NOT NULL))), 'string_agg', ',') AS capabilities FROM sources_v""",
)(
    lambda v: v("sources_v").select(
        "source_id",
        F.array_join(changes.capabilities(F.substring_index("fetcher", ":", -1), F.col("sink"), F.expr("CASE WHEN n % 4 = 1 THEN 'folder' END"), F.expr("CASE WHEN n % 3 = 0 THEN array('gpu', 'fetcher:rss') END")), ",").alias("capabilities"),
    )
)

query("source_checkpoints", "SELECT source_id, CASE WHEN n % 3 = 0 THEN '{\"page\": ' || n || '}' ELSE '{}' END AS checkpoint, CASE WHEN n % 3 = 0 THEN 'e' || n END AS etag FROM sources_v")(
    lambda v: paged.checkpoints(
        v("sources_v"), v("sources_v").where("n % 3 = 0").select("source_id", F.format_string('{"page": %d}', "n").alias("checkpoint"), F.concat(F.lit("e"), F.col("n").cast("string")).alias("etag"), F.lit(None).cast("string").alias("last_modified"))
    ).select("source_id", "checkpoint", "etag")
)


# the sources' fetchers by name, two of them without a plugin, and some sinks that aren't there
@query(
    "plugin_lookup",
    """WITH s AS (SELECT source_id, substr(fetcher, 9) AS fetcher, CASE WHEN n % 6 = 5 THEN 's3' ELSE 'versioned' END AS sink FROM sources_v)
SELECT source_id, CASE WHEN fetcher IN ('rss', 'web_page', 'json_api') AND sink = 'versioned' THEN 'fetcher:' || fetcher || ':api-v1,sink:versioned:api-v1' END AS capabilities,
  CASE WHEN fetcher NOT IN ('rss', 'web_page', 'json_api') THEN 'no fetcher ' || fetcher WHEN sink = 's3' THEN 'no sink s3' END AS error FROM s""",
)
def _(v: View):
    sources = v("sources_v").select("source_id", F.substring_index("fetcher", ":", -1).alias("fetcher"), F.expr("CASE WHEN n % 6 = 5 THEN 's3' ELSE 'versioned' END").alias("sink"))
    rows = [("fetcher", name, "1.0.0", "1", ["fetch"], "web") for name in ("rss", "web_page", "json_api", "Web List")] + [("fetcher", "sitemap", "1.0.0", "1", ["crawl"], "web"), versioned.PLUGIN]
    found = registry.resolved(sources, sources.sparkSession.createDataFrame(rows, registry.PLUGIN))
    return found.select("source_id", F.array_join("capabilities", ",").alias("capabilities"), "error")
