"""The stateful processor against the batch form, however events are cut, and what is left of its state."""

import datetime as dt
import random

import pytest

from feedloom.streaming import lifecycle

START = dt.datetime(2025, 1, 1)
SCHEMA = "task_id long, ts timestamp, seq long, kind string, worker string, error_class string, retry_after double"
RULES = lifecycle.Rules(most_attempts=2, base_seconds=20)


def at(s):
    return START + dt.timedelta(seconds=s)


def random_events(seed, n):
    draw = random.Random(seed)
    rows, t = [], 0.0
    for seq in range(n):
        t += draw.choice([0, 0.001, 5, 5, 5, 40, 181])
        kind = draw.choice(["submit", "claim", "claim", "claim", "beat", "complete", "fail", "fail"])
        rows.append((draw.randint(1, 5), at(t), seq, kind, draw.choice(["a", "a", "a", "b"]), draw.choice(["timeout", "timeout", "permanent", None]), draw.choice([None, None, 3.0, -1.0])))
    return rows


def streamed(spark, rows, cuts, path):
    """The steps of a stream that gets the rows in parts, a micro-batch for each."""
    out: list = []
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        spark.createDataFrame(rows[a:b], SCHEMA).coalesce(1).write.mode("append").parquet(str(path / "in"))
        events = spark.readStream.schema(SCHEMA).parquet(str(path / "in"))
        query = lifecycle.lives(events, RULES).writeStream.foreachBatch(lambda df, _: out.extend(map(tuple, df.collect()))).option("checkpointLocation", str(path / "c"))
        query.trigger(availableNow=True).start().awaitTermination()
    return sorted(out, key=str)


@pytest.mark.parametrize(("seed", "cuts"), [(1, [40, 41, 110]), (2, [])])
def test_any_cut_gives_the_batch_answer(spark, tmp_path, seed, cuts):
    rows = random_events(seed, 150)
    want = sorted(map(tuple, lifecycle.replay(spark.createDataFrame(rows, SCHEMA), RULES).collect()), key=str)
    assert {s[2] for s in want} >= ({"submitted", "claimed", "lost", "retry", "ready", "done", "dead"} if cuts else {"lost", "dead"})
    assert streamed(spark, rows, cuts, tmp_path) == want
    left = {r.key.task_id for r in spark.read.format("statestore").option("stateVarName", "life").load(str(tmp_path / "c")).collect()}
    last = {}
    for task, _, step, *_ in sorted(want, key=lambda s: (s[1],)):
        last.setdefault(task, []).append(step)
    ended = {t for t, steps in last.items() if steps.count("submitted") == steps.count("done") + steps.count("dead")}
    assert left == set(last) - ended and ended  # no state of ended tasks


def test_steps_fall_due_at_their_own_times(spark):
    rows = [(1, at(0), 0, "submit", None, None, None), (1, at(1), 1, "claim", "a", None, None), (1, at(100), 2, "beat", "a", None, None), (1, at(280), 3, "beat", "a", None, None), (1, at(461), 4, "claim", "b", None, None), (1, at(475), 5, "claim", "b", None, None), (1, at(476), 6, "complete", "a", None, None), (1, at(477), 7, "fail", "b", "timeout", 9.0), (2, at(900), 8, "beat", "x", None, None)]
    got = [(r.t - 1735689600000, r.step, r.attempts, r.worker) for r in lifecycle.replay(spark.createDataFrame(rows, SCHEMA), lifecycle.Rules()).collect() if r.task_id == 1]
    assert sorted(got) == [(0, "submitted", 0, None), (1000, "claimed", 1, "a"), (460000, "lost", 1, "a"), (475000, "claimed", 2, "b"), (475000, "ready", 1, None), (477000, "retry", 2, "b"), (486000, "ready", 2, None)]
    assert lifecycle.replay(spark.createDataFrame([], SCHEMA)).count() == 0
