"""Queries of what streams keep: the lives of tasks, and stored pages."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from feedloom.functions import expr
from feedloom.operators import lineage, seen
from feedloom.plans.catalog import ORACLE_SQL, QUERIES, View, query
from feedloom.sources import paged
from feedloom.streaming import lifecycle

# users' groups are tasks, what they do are the events of these; a lease is lost after ten hours without a heartbeat
GROUPS = 50
RULES = lifecycle.Rules(most_attempts=2, base_seconds=7200, most_seconds=14_400, stale_seconds=36_000, again_seconds=1800)
RETRYABLE = ", ".join(f"'{c}'" for c in expr.RETRYABLE)

LIVES = f"""WITH RECURSIVE e AS (SELECT user_id % {GROUPS} AS task_id, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY user_id % {GROUPS} ORDER BY ts, event_id) AS r,
  CASE event_type WHEN 'signup' THEN 'submit' WHEN 'click' THEN 'claim' WHEN 'view' THEN 'beat' WHEN 'purchase' THEN 'complete' ELSE 'fail' END AS kind, 'n-' || event_id % 2 AS worker,
  CASE event_id % 3 WHEN 0 THEN 'timeout' WHEN 1 THEN 'network' ELSE 'permanent' END AS class FROM events),
every AS MATERIALIZED (SELECT * FROM e UNION ALL SELECT task_id, (SELECT max(t) FROM e), max(r) + 1, 'end', NULL, NULL FROM e GROUP BY task_id),
walk AS (SELECT DISTINCT task_id, CAST(0 AS BIGINT) AS r, CAST(NULL AS VARCHAR) AS status, 0 AS n, CAST(NULL AS VARCHAR) AS w, CAST(0 AS BIGINT) AS beat, CAST(0 AS BIGINT) AS due,
  CAST([] AS STRUCT(t BIGINT, step VARCHAR, attempts INT, worker VARCHAR)[]) AS steps FROM e
UNION ALL
SELECT task_id, r, CASE WHEN status IS NULL THEN CASE WHEN kind = 'submit' THEN 'pending' END WHEN claims THEN 'running' WHEN ends THEN NULL WHEN fails THEN 'retry' ELSE status END,
  CASE WHEN claims THEN n + 1 WHEN status IS NULL OR ends THEN 0 ELSE n END, CASE WHEN claims THEN worker WHEN ends OR fails THEN NULL ELSE w END,
  CASE WHEN claims OR holds AND kind = 'beat' THEN t ELSE beat END, CASE WHEN fails THEN t + least({14_400_000}, 7200000 * (1 << (n - 1))) ELSE due END,
  list_concat(list_filter([CASE WHEN lost THEN {{'t': lost_at, 'step': 'lost', 'attempts': n, 'worker': w0}} END, CASE WHEN ready THEN {{'t': due, 'step': 'ready', 'attempts': n, 'worker': CAST(NULL AS VARCHAR)}} END], lambda x: x IS NOT NULL),
    list_filter([CASE WHEN status IS NULL AND kind = 'submit' THEN {{'t': t, 'step': 'submitted', 'attempts': 0, 'worker': CAST(NULL AS VARCHAR)}} WHEN claims THEN {{'t': t, 'step': 'claimed', 'attempts': n + 1, 'worker': worker}}
      WHEN ends THEN {{'t': t, 'step': CASE WHEN kind = 'complete' THEN 'done' ELSE 'dead' END, 'attempts': n, 'worker': worker}} WHEN fails THEN {{'t': t, 'step': 'retry', 'attempts': n, 'worker': worker}} END], lambda x: x IS NOT NULL))
FROM (SELECT *, coalesce(kind = 'claim' AND status = 'pending', false) AS claims, coalesce(holds AND (kind = 'complete' OR kind = 'fail' AND (class NOT IN ({RETRYABLE}) OR n >= 2)), false) AS ends,
    coalesce(holds AND kind = 'fail' AND class IN ({RETRYABLE}) AND n < 2, false) AS fails
  FROM (SELECT *, coalesce(status = 'running' AND worker = w, false) AS holds
  FROM (SELECT task_id, r, t, kind, worker, class, n, CASE WHEN lost THEN NULL ELSE w END AS w, w AS w0, beat, lost, lost_at, due, coalesce(status1 = 'retry' AND due <= t, false) AS ready,
      CASE WHEN status1 = 'retry' AND due <= t THEN 'pending' ELSE status1 END AS status
  FROM (SELECT *, CASE WHEN lost THEN 'retry' ELSE status END AS status1, CASE WHEN lost THEN lost_at + 1800000 ELSE due0 END AS due
  FROM (SELECT k.task_id, e.r, e.t, e.kind, e.worker, e.class, k.status, k.n, k.w, k.beat, k.due AS due0, k.beat + 36000000 AS lost_at, coalesce(k.status = 'running' AND k.beat + 36000000 < e.t, false) AS lost
  FROM walk k JOIN every e ON e.task_id = k.task_id AND e.r = k.r + 1))))))
SELECT task_id, s.t AS t, s.step AS step, s.attempts AS attempts, s.worker AS worker FROM (SELECT task_id, unnest(steps) AS s FROM walk)"""


@query("task_lives", LIVES)
def _(v: View):
    kind = F.expr("CASE event_type WHEN 'signup' THEN 'submit' WHEN 'click' THEN 'claim' WHEN 'view' THEN 'beat' WHEN 'purchase' THEN 'complete' ELSE 'fail' END")
    error = F.expr("CASE event_id % 3 WHEN 0 THEN 'timeout' WHEN 1 THEN 'network' ELSE 'permanent' END")
    worker = F.concat(F.lit("n-"), (F.col("event_id") % 2).cast("string"))
    events = v("events").select((F.col("user_id") % GROUPS).alias("task_id"), "ts", F.col("event_id").alias("seq"), kind.alias("kind"), worker.alias("worker"), error.alias("error_class"), F.lit(None).cast("double").alias("retry_after"))
    return lifecycle.replay(events, RULES)


QUERIES["stored_pages"] = lambda spark, sf_dir: paged.pages(spark, f"{sf_dir.rstrip('/')}/pages.parquet", "page_id", pages_per_task=500).select("page_id", "url", F.sha2("html", 256).alias("digest"))
ORACLE_SQL["stored_pages"] = "SELECT page_id, url, sha256(html) AS digest FROM pages"


@query("seen_forever", "SELECT DISTINCT dedupe_key FROM tasks_v WHERE dedupe_key NOT IN (SELECT dedupe_key FROM runs_v)")
def _(v: View):
    """History is the first batch of an index, the live tasks' keys are asked of it."""
    history = v("runs_v").select(F.col("dedupe_key").alias("key"))
    index = seen.SeenKeys(history.sparkSession, f"{lineage.shared_folder(history.sparkSession)}/seen-{uuid.uuid4().hex}", buckets=16)
    index.add(index.unseen(history, 0), 0)
    return index.unseen(v("tasks_v").select(F.col("dedupe_key").alias("key")), 1).select(F.col("key").alias("dedupe_key"))
