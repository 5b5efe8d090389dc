"""Claims in rounds against workers that claim one after the other."""

import datetime as dt
import random

import pytest

from feedloom.operators import rounds, scheduling

NOW = dt.datetime(2025, 1, 1)
TASK = "id long, queue string, caps_csv string, preferred_worker string, priority int, not_before timestamp_ntz, batch_id long, status string, slot_cost int, workload string, resources map<string,int>"
WORKER = "node_id string, effective_state string, caps_csv string, queues_csv string"


def one_after_the_other(tasks, workers, slots, held, most):
    """{id: (node_id, leases)} and what is left idle."""
    held, claims = {k: set(v) for k, v in held.items()}, {}
    for node, state, caps, queues in sorted(workers):
        left, quota = slots.get(node, (0, None))
        if state != "online" or left <= 0:
            continue
        can = [t for t in tasks if t[0] not in claims and t[1] in queues.split(",") and set(filter(None, t[2].split(","))) <= set(caps.split(",")) and t[3] in (None, node) and t[5] <= NOW]
        for t in sorted(can, key=lambda t: (t[4], t[5], t[0]))[:most]:
            backfill = t[9] == "backfill"
            free = {k: next((s for s in range(1, max(1, n) + 1) if s not in held.get(k, ())), None) for k, n in t[10].items()}
            if t[8] > left or backfill and quota is not None and t[8] > quota or None in free.values():
                continue
            left, quota = left - t[8], quota - t[8] if backfill and quota is not None else quota
            for k, s in free.items():
                held.setdefault(k, set()).add(s)
            claims[t[0]] = (node, free)
    return claims


def random_case(seed):
    draw = random.Random(seed)
    tasks = [(
        i, draw.choice("pq"), draw.choice(["", "x", "x,y"]), draw.choice([None, None, None, "n1", "n3", "n9"]), draw.randint(0, 3), NOW + dt.timedelta(minutes=draw.randint(-9, 1)), None, draw.choice(["pending", "retry"]),
        draw.randint(1, 3), draw.choice(["scheduled", "backfill"]), {k: draw.randint(0, 3) for k in "abcd" if draw.random() < 0.25},
    ) for i in range(150)]
    workers = [(f"n{i}", draw.choice(["online", "online", "online", "offline"]), draw.choice(["x", "x,y"]), draw.choice(["p", "q", "p,q"])) for i in range(7)]
    slots = {f"n{i}": (draw.randint(0, 9), draw.choice([None, 0, 2])) for i in range(7)}
    return tasks, workers, slots, {"a": {1}, "c": {2, 3}}


def claimed(spark, tasks, workers, slots, held, most):
    batches = spark.createDataFrame([], "id long, status string")
    leases = [(k, s, dt.datetime(2030, 1, 1)) for k, v in held.items() for s in v] + [("b", 1, dt.datetime(2020, 1, 1))]
    found = rounds.claim_rounds(
        spark.createDataFrame(tasks, TASK), spark.createDataFrame(workers, WORKER), batches, spark.createDataFrame([(n, *s) for n, s in slots.items()], "node_id string, slots int, backfill_left long"),
        spark.createDataFrame(leases, "resource_key string, slot int, expires_at timestamp_ntz"), NOW, most,
    )
    return {r.id: (r.node_id, {x.key: x.slot for x in r.leases}) for r in found.collect()}, found


@pytest.mark.parametrize(("seed", "most"), [(1, 200), (2, 6)])
def test_rounds_equal_workers_in_turn(spark, seed, most):
    case = random_case(seed)
    got, found = claimed(spark, *case, most)
    assert got == one_after_the_other(*case, most)
    taken = [(x.key, x.slot) for r in found.collect() for x in r.leases]
    assert len(taken) == len(set(taken))  # a slot has one holder


def test_equal_workers_spread_over_a_queue_in_few_rounds(spark, monkeypatch):
    made = []
    lists = rounds.lists
    monkeypatch.setattr(rounds, "lists", lambda *a: made.append(1) or lists(*a))
    tasks = [(i, "p", "", None, 0, NOW, None, "pending", 1, "scheduled", {}) for i in range(100)]
    workers = [(f"w{i:02}", "online", "x", "p") for i in range(12)]
    got, _ = claimed(spark, tasks, workers, {w[0]: (4, None) for w in workers}, {}, 200)
    assert got == {i: (f"w{i // 4:02}", {}) for i in range(48)}
    assert len(made) <= 4


def test_turns_may_be_given_and_nothing_to_claim(spark):
    tasks = spark.createDataFrame([(1, "p", "", None, 0, NOW, None, "pending", 1, "scheduled")], TASK.rpartition(", resources")[0])
    workers = spark.createDataFrame([("a", "online", "x", "p"), ("b", "online", "x", "p")], WORKER)
    slots = spark.createDataFrame([("a", 1, None, 2), ("b", 1, None, 1)], "node_id string, slots int, backfill_left long, turn int")
    none = spark.createDataFrame([], "resource_key string, slot int, expires_at timestamp_ntz")
    batches = spark.createDataFrame([], "id long, status string")
    assert [(r.node_id, r.id, r.n) for r in rounds.claim_rounds(tasks, workers, batches, slots, none, NOW).collect()] == [("b", 1, 1)]
    assert rounds.claim_rounds(tasks, workers.where("false"), batches, slots, none, NOW).count() == 0
    assert rounds.claim_rounds(tasks.where("false"), workers, batches, slots, none, NOW).count() == 0
    asked = tasks.selectExpr("'a' AS node_id", "map('k', 1) AS resources")
    assert scheduling.held_before(asked, slots, none.select("resource_key", "slot")).count() == 0
