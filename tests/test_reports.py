"""What reports do to tasks, at sizes where no join is by broadcast."""

import contextlib
import datetime as dt

import duckdb
import pytest

from feedloom.operators import changes, transitions
from feedloom.plans import catalog
from feedloom.plans import changes as queries  # noqa: F401

NOW = dt.datetime(2025, 1, 1)
SF = "/root/testdata/sf0.001"
TASK = "id long, dedupe_key string, batch_id long, status string, lease_token string, attempts int, max_attempts int, locked_by string, locked_at timestamp_ntz, base_seconds int, max_seconds int, backoff string"
REPORT = "task_id long, lease_token string, status string, added int, error_class string, message string, retry_after double"


@contextlib.contextmanager
def settings(spark, **values):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture
def large(spark):
    """No broadcasts, as with large tables."""
    with settings(spark, **{"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4000", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1"}):
        yield spark


def test_released_rows_of_large_tables(large):
    duck = duckdb.connect()
    for name in ("orders", "nation", "region", "events"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    text = lambda rows: sorted(tuple(str(x) for x in r) for r in rows)
    want = duck.execute(f"SELECT what, task_id, lease FROM ({catalog.ORACLE_SQL['released_rows']})").fetchall()
    assert text(catalog.QUERIES["released_rows"](large, SF).select("what", "task_id", "lease").collect()) == text(want)


def test_released_rows_by_report(large):
    tasks = large.createDataFrame([(i, f"k{i}", None, "running", f"t{i}", 1 if i < 5 else 3, 3, "w", None, 30, 60, "fixed") for i in range(7)], TASK)
    rows = [(0, "t0", "succeeded"), (1, "t1", "failed"), (2, "t2", "failed"), (3, "old", "succeeded"), (4, "t4", None), (5, "t5", "failed"), (6, "t6", "failed"), (6, "t6", "partial"), (9, "t9", "failed")]
    reports = large.createDataFrame([(i, t, s, 0, {1: "timeout", 2: "permanent", 6: "network"}.get(i, "timeout"), None, None) for i, t, s in rows], REPORT)
    leases = large.createDataFrame([("a", 1, 0), ("a", 1, 0), ("b", 2, 1), (None, None, 5), ("c", 1, 3), ("d", 1, 4)], "resource_key string, slot int, task_id long")
    got = changes.released(tasks, reports, leases)
    again = got.groupBy("task_id").count().join(got, "task_id")  # what is read further stands by the same key
    want = [("lease", 0, "a", 1), ("lease", 0, "a", 1), ("lease", 1, "b", 2), ("lease", 5, None, None), ("task", 0, None, None), ("task", 2, None, None), ("task", 5, None, None), ("task", 6, None, None)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and again.count() == len(want)


def sorted_joins(frame):
    """The joins of reports and tasks that sort both."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "SortMergeJoin" in line and "task_id" in line]


@pytest.fixture
def told(large):
    """Tasks and their reports: twice alike, twice unlike, one key twice, in history, a key missing, a strange token, not running, failed, no such task."""
    rows = [(1, "k1"), (2, "k2"), (3, "k3"), (4, "k3"), (5, "old"), (6, None), (7, "k7"), (8, "k8"), (9, "k9"), (10, "k10")]
    tasks = large.createDataFrame([(i, k, None, "pending" if i == 8 else "running", f"t{i}", 1, 3, "w", None, 30, 60, "fixed") for i, k in rows], TASK)
    sent = [(1, "succeeded", "a"), (1, "succeeded", "a"), (2, "partial", "x" * 16_010), (2, "skipped", "b"), (3, "succeeded", "c"), (4, "succeeded", "d"), (5, "succeeded", "e"), (6, "succeeded", None), (8, "succeeded", "f"), (9, "failed", "g" * 16_010), (10, "succeeded", "h" * 16_010), (11, "failed", "i")]
    reports = large.createDataFrame([(i, f"t{i}", s, None, "timeout", m, None) for i, s, m in sent] + [(7, "other", "succeeded", 1, None, "j", None), (10, "other", "failed", 1, "timeout", "k", None)], REPORT)
    return tasks, reports, large.createDataFrame([("old",), ("older",)], "dedupe_key string")


def test_a_run_for_each_key_without_sorting_messages(told):
    tasks, reports, history = told
    runs = transitions.complete(tasks, reports, history, NOW)
    assert not sorted_joins(runs)
    got = {r.dedupe_key: r for r in runs.collect()}
    assert runs.count() == len(got) and set(got) == {"k1", "k2", "k3", None, "k10"}
    assert got["k1"].error_message == "a" and (got["k2"].final_status, got["k2"].error_message) in {("partial", "x" * 16_000), ("skipped", "b")}
    assert (got["k3"].task_id, got["k3"].error_message) in {(3, "c"), (4, "d")} and got[None].error_message is None and got["k10"].error_message == "h" * 16_000


def test_failures_without_sorting_messages(told):
    tasks, reports, _ = told
    failed = transitions.fail(tasks, reports.where("status = 'failed'"), NOW)
    assert not sorted_joins(failed)
    assert {(r.task_id, r.action, r.status, r.last_error) for r in failed.collect()} == {(9, "retry", "retry", "g" * 16_000), (10, "lease_lost", "running", None), (11, "lease_lost", None, None)}
