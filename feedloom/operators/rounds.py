"""Claims of many workers at once that come out as if they had claimed one after the other.

All workers walk at the same time, each on its own list: what earlier workers (by
their turn) were last known to claim is left out, their slots of shared resources
count as taken. Rounds go on until nobody's claims change. The first worker's
claims hold from the first round on, the second's from the one after at the
latest, and so on; a state that doesn't change is the one that the walks in turn
give. Workers that want the same tasks don't wait for each other: where earlier
ones have claimed the same task twice over, a later one leaves as many further
tasks of that kind to them, so equal workers spread over a queue in two rounds.

A list is made from the first tasks of each kind (queue, capabilities, preferred
worker) only: `most`, and as many as all workers together have slots for.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions import expr
from feedloom.operators import scheduling
from feedloom.operators.lineage import cut

KIND = ("queue", "caps_csv", "preferred_worker")
CLAIMS = "node_id string, turn int, id long, slot_cost int, n int, leases array<struct<key:string,slot:int>>, queue string, caps_csv string, preferred_worker string"


def takers(ready: DataFrame, workers: DataFrame, slots: DataFrame) -> DataFrame:
    """The online workers with free slots that can take a kind of task: the kind, node_id and turn."""
    able = F.forall(expr.csv_array(F.col("caps_csv")), lambda c: F.array_contains("offered", c))
    places = scheduling.online_places(workers).join(slots.where("slots > 0").select("node_id", "turn"), "node_id")
    kinds = ready.select(*KIND).distinct()
    return kinds.join(places, "queue").where(able & (F.col("preferred_worker").isNull() | (F.col("preferred_worker") == F.col("node_id")))).select(*KIND, "node_id", "turn").distinct()


def front(ready: DataFrame, depth: int) -> DataFrame:
    """The first tasks of each kind."""
    first = Window.partitionBy(*KIND).orderBy("priority", "not_before", "id")
    return ready.withColumn("place", F.row_number().over(first)).where(F.col("place") <= depth).drop("place")


def lists(pool: DataFrame, able: DataFrame, claims: DataFrame, most: int) -> DataFrame:
    """Each worker's first `most` tasks in order, without those of earlier workers: node_id, turn, n and the task."""
    same = lambda a, b: [a[k].eqNullSafe(b[f"of_{k}"]) for k in KIND]
    named = lambda df: df.select(*[F.col(k).alias(f"of_{k}") for k in KIND], *[c for c in df.columns if c not in KIND])
    pool = pool.join(claims.groupBy("id").agg(F.min("turn").alias("taken")), "id", "left")

    again = claims.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("turn"))).where("k > 1").groupBy(*KIND, "turn").agg(F.count(F.lit(1)).alias("again"))
    again = named(again).withColumnRenamed("turn", "of_turn")
    places = able.join(again, [*same(able, again), able["turn"] == again["of_turn"]], "left").select(*able.columns, F.coalesce("again", F.lit(0)).alias("again"))
    earlier = Window.partitionBy(*KIND).orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    places = named(places.withColumn("leave", F.coalesce(F.sum("again").over(earlier), F.lit(0))).drop("again"))

    open_to = pool.join(places, same(pool, places)).where(F.col("taken").isNull() | (F.col("taken") >= F.col("turn")))
    own = Window.partitionBy("node_id", *KIND).orderBy("priority", "not_before", "id")
    kept = open_to.withColumn("k", F.row_number().over(own)).where(F.col("k") > F.col("leave"))
    return scheduling.first_of_each(kept.select(*pool.drop("taken").columns, "node_id", "turn"), most)


def claim_rounds(tasks: DataFrame, workers: DataFrame, batches: DataFrame, slots: DataFrame, leases: DataFrame, as_of: dt.datetime, most: int = 200) -> DataFrame:
    """The claims of all online workers with free slots: node_id, id, slot_cost, n (the place on the worker's list) and leases.

    slots: node_id, slots, backfill_left and, if workers don't take their turn by name, turn. tasks may carry
    `resources`, a map of keys to capacities; leases (resource_key, slot, expires_at) are those held already. A task
    needs the lowest free slot of each of its resources, all or none, whichever worker holds the others.
    """
    if "turn" not in slots.columns:  # a row for each worker
        slots = slots.withColumn("turn", F.row_number().over(Window.orderBy("node_id")))
    ready = scheduling.ready_tasks(tasks, batches, as_of)
    resources = F.col("resources") if "resources" in ready.columns else F.create_map().cast("map<string,int>")
    ready = ready.select("id", *KIND, "priority", "not_before", "slot_cost", "workload", resources.alias("resources"))
    slots = cut(slots)
    able = cut(takers(ready, workers, slots))
    room = slots.join(able.select("node_id").distinct(), "node_id").agg(F.sum("slots").alias("n")).first()["n"] or 0
    pool = cut(front(ready, most + room))
    live = leases.where(F.col("expires_at") > F.lit(as_of).cast("timestamp_ntz")).select("resource_key", "slot", F.lit(None).cast("int").alias("by"))
    claims = ready.sparkSession.createDataFrame([], CLAIMS)
    before = None
    state = lambda df: df.agg(F.count(F.lit(1)), *[F.bit_xor(F.xxhash64(F.lit(i), "turn", "id", F.to_json("leases"))) for i in (1, 2)]).first()
    while True:
        rows = lists(pool, able, claims, most)
        taken = claims.select("turn", F.explode("leases").alias("l")).select(F.col("l.key").alias("resource_key"), F.col("l.slot").alias("slot"), F.col("turn").alias("by"))
        walked = scheduling.claim_greedy(rows, slots, live.unionByName(taken))
        found = walked.join(slots.select("node_id", "turn"), "node_id").join(pool.select("id", *KIND), "id").select(*claims.columns)
        new = cut(found)
        if (now := state(new)) == before:
            return new.select("node_id", "id", "slot_cost", "n", "leases")
        claims, before = new, now
