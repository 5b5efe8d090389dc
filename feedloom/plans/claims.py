"""Queries of claims that several workers make at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.operators import rounds, scheduling
from feedloom.plans.catalog import AS_OF, BUDGET, NOW_SQL, View, query

# a domain has six slots for the tasks of a source, an interface four; leases that haven't expired hold some of them
NEEDS = """(SELECT t.*, CASE WHEN id % 3 = 0 THEN concat('domain:', r_name) END AS k1, CASE WHEN id % 7 = 0 THEN 'api:shared' END AS k2 FROM tasks_v t JOIN region ON r_regionkey = id % 5)"""
free = "list_min(list_filter(range(1, {c} + 1), lambda s: NOT list_contains(held, {k} || '=' || s)))"

CLAIM_ROUNDS = f"""WITH RECURSIVE {BUDGET},
able AS MATERIALIZED (SELECT w.node_id, row_number() OVER (ORDER BY w.node_id) AS turn, w.caps_csv, w.queues_csv, b.slots, b.quota FROM staffed_v w JOIN budget b USING (node_id)),
cand AS (SELECT turn, node_id, t.id, t.slot_cost, t.workload, k1, k2, row_number() OVER (PARTITION BY turn ORDER BY t.priority, t.not_before, t.id) AS n FROM {NEEDS} t
  JOIN (SELECT a.* FROM able a JOIN workers_v USING (node_id) WHERE effective_state = 'online' AND slots > 0) w
  ON list_contains(string_split(w.queues_csv, ','), t.queue) AND (t.caps_csv = '' OR list_has_all(string_split(w.caps_csv, ','), string_split(t.caps_csv, ','))) AND (t.preferred_worker IS NULL OR t.preferred_worker = w.node_id)
  WHERE t.status IN ('pending', 'retry') AND t.not_before <= {NOW_SQL} AND (t.batch_id IS NULL OR EXISTS (SELECT 1 FROM batches_v b WHERE b.id = t.batch_id AND b.status = 'running'))),
front AS MATERIALIZED (SELECT * FROM cand WHERE n <= 300),
walk AS (SELECT CAST(0 AS BIGINT) AS turn, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS seen, CAST(0 AS BIGINT) AS rem, CAST(0 AS BIGINT) AS q, CAST([] AS BIGINT[]) AS done,
  (SELECT list(resource_key || '=' || slot) FROM leases_v WHERE expires_at > {NOW_SQL}) AS held, CAST(NULL AS BIGINT) AS id, CAST(NULL AS INT) AS slot_cost, CAST(NULL AS VARCHAR) AS leases
UNION ALL
SELECT turn, n, seen, CASE WHEN ok THEN rem - cost ELSE rem END, CASE WHEN ok AND workload = 'backfill' THEN q - cost ELSE q END, CASE WHEN ok THEN list_append(done, cid) ELSE done END,
  CASE WHEN ok THEN list_concat(held, list_filter([k1 || '=' || s1, k2 || '=' || s2], lambda x: x IS NOT NULL)) ELSE held END, CASE WHEN ok THEN cid END, CASE WHEN ok THEN cost END,
  CASE WHEN ok THEN concat_ws(',', k2 || '=' || s2, k1 || '=' || s1) END
FROM (SELECT *, coalesce(cid IS NOT NULL AND NOT list_contains(done, cid) AND seen <= 200 AND cost <= rem AND (workload <> 'backfill' OR cost <= q) AND (k1 IS NULL OR s1 IS NOT NULL) AND (k2 IS NULL OR s2 IS NOT NULL), false) AS ok
  FROM (SELECT CASE WHEN c.id IS NULL THEN w.turn + 1 ELSE w.turn END AS turn, CASE WHEN c.id IS NULL THEN 0 ELSE w.n + 1 END AS n,
    CASE WHEN c.id IS NULL THEN 0 WHEN list_contains(w.done, c.id) THEN w.seen ELSE w.seen + 1 END AS seen, CASE WHEN c.id IS NULL THEN a.slots ELSE w.rem END AS rem, CASE WHEN c.id IS NULL THEN a.quota ELSE w.q END AS q,
    done, held, c.id AS cid, c.slot_cost AS cost, c.workload, k1, k2, {free.format(c=6, k="k1")} AS s1, {free.format(c=4, k="k2")} AS s2
    FROM walk w LEFT JOIN front c ON c.turn = w.turn AND c.n = w.n + 1 AND w.seen < 200 LEFT JOIN able a ON a.turn = w.turn + 1 WHERE c.id IS NOT NULL OR a.turn IS NOT NULL)))
SELECT node_id, id, slot_cost, leases FROM walk JOIN able USING (turn) WHERE id IS NOT NULL"""


@query("claim_rounds", CLAIM_ROUNDS)
def _(v: View):
    """All online workers' claims; SQL walks over 300 candidates of each: 200 and more than all workers together have slots for."""
    regions = v("region").select((F.col("r_regionkey")).cast("long").alias("of"), F.concat(F.lit("domain:"), "r_name").alias("k1"))
    one = lambda on, key, capacity: F.when(on, F.create_map(key, F.lit(capacity))).otherwise(F.create_map().cast("map<string,int>"))
    tasks = v("tasks_v").join(regions, F.col("id") % 5 == F.col("of"))
    tasks = tasks.withColumn("resources", F.map_concat(one(F.col("id") % 3 == 0, F.col("k1"), 6), one(F.col("id") % 7 == 0, F.lit("api:shared"), 4)))
    slots = scheduling.slots_left(v("staffed_v"), v("tasks_v"), F.col("backfill_quota"))
    claims = rounds.claim_rounds(tasks, v("workers_v"), v("batches_v"), slots, v("leases_v"), AS_OF)
    leases = F.array_join(F.transform("leases", lambda x: F.concat_ws("=", x["key"], x["slot"].cast("string"))), ",")
    return claims.select("node_id", "id", "slot_cost", leases.alias("leases"))
