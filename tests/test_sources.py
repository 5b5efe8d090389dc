"""Plugins as tables, failures by class, and stored pages as a batch and as a stream that is stopped at bad moments."""

import datetime as dt
import json

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from feedloom import failures
from feedloom.sinks import versioned
from feedloom.sources import paged, registry


def test_plugins_are_judged_in_columns(spark):
    rows = [("fetcher", "rss", "1.0", "1", ["fetch"], "web"), ("fetcher", "rss", "1.1", "1", ["fetch"], "web"), ("sink", "Bad Name", "1", "1", [], None), ("other", "a", "1", "1", None, None), ("fetcher", "b", "1", "2", ["steal"], None), ("sink", "postgres", "1", "1", None, None), (None, None, None, None, None, None)]
    got = {(r.kind, r.name, r.version): (r.capability, r.error) for r in registry.checked(spark.createDataFrame(rows, registry.PLUGIN)).collect()}
    assert [got[r[:3]] for r in rows] == [("fetcher:rss:api-v1", None), (None, "taken"), (None, "name"), (None, "kind"), (None, "operation"), ("sink:postgres:api-v1", None), (None, "kind")]
    sources = spark.createDataFrame([("a", "rss", "postgres"), ("b", "atom", "postgres"), ("c", "rss", "s3")], "source_id string, fetcher string, sink string")
    found = {r.source_id: (r.capabilities, r.error) for r in registry.resolved(sources, spark.createDataFrame(rows, registry.PLUGIN)).collect()}
    assert found == {"a": (["fetcher:rss:api-v1", "sink:postgres:api-v1"], None), "b": (None, "no fetcher atom"), "c": (None, "no sink s3")}


def test_a_source_is_read_and_handed_to_its_sink(spark):
    spark.dataSource.register(registry.Daily)
    config = {"text": "t", "first": "2025-03-01", "last": "2025-04-10", "tags": ["x"]}
    sink = lambda rows, source: rows.groupBy(F.lit(source).alias("source_id"), "tags").agg(F.count(F.lit(1)).alias("n"), F.min("external_id").alias("first"))
    assert [tuple(r) for r in registry.run_source(spark, "example.daily", config, sink, "s").collect()] == [("s", ["x"], 41, "2025-03-01")]
    window = {"start": dt.datetime(2025, 3, 4), "end": dt.datetime(2025, 3, 6)}
    assert [r.n for r in registry.run_source(spark, "example.daily", config, sink, "s", **window).collect()] == [2]
    with pytest.raises(Exception, match="last missing"):
        registry.read_source(spark, "example.daily", {"text": "t", "first": "2025-03-01"}).count()


def test_failures_by_class(spark):
    runs = spark.createDataFrame([(1, "timeout"), (2, "permanent"), (3, None), (4, "odd")], "task_id int, error_class string")
    assert {r.task_id: r.retryable for r in failures.classified(runs).collect()} == {1: True, 2: False, 3: None, 4: True}
    with pytest.raises(ValueError, match="no class"):
        failures.Failed("odd", "x")
    assert failures.bad("x").kind == "configuration"


def stored(spark, path, first, end):
    rows = [(n, f"http://h/{n}", f"<p>{n}</p>" if n % 3 else None) for n in range(first, end)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2).write.mode("append").parquet(path)


def test_stored_pages_as_a_batch(spark, tmp_path):
    path = f"file://{tmp_path}/pages"
    stored(spark, path, 5, 40)
    got = paged.pages(spark, path, "page_id", pages_per_task=4)
    assert got.schema == spark.read.parquet(path).schema and sorted(got.collect()) == sorted(spark.read.parquet(path).collect())
    assert got.rdd.getNumPartitions() == 9
    with pytest.raises(Exception, match="page missing"):
        spark.read.format("stored_pages").option("path", path).load()


def test_a_stream_stopped_between_sink_and_commit(spark, tmp_path):
    """The sink replaces what a batch of its number had written; a stop after that, or in the middle of it, repeats, loses and doubles nothing."""
    path, out, state = f"file://{tmp_path}/pages", f"{tmp_path}/out", f"file://{tmp_path}/state"
    batches: list[int] = []
    stop = {"before": False, "after": False}

    def sink(rows, number):
        batches.append(number)
        if stop["before"]:
            raise RuntimeError("stopped before the sink")
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if stop["after"]:
            raise RuntimeError("stopped after the sink")

    def run():
        stream = paged.new_pages(spark, path, "page_id", pages_per_task=7, state=state)
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()

    stored(spark, path, 0, 20)
    run()
    for when in ("before", "after"):
        stored(spark, path, *{"before": (20, 35), "after": (35, 60)}[when])
        stop[when] = True
        with pytest.raises(StreamingQueryException):
            run()
        stop[when] = False
        run()
    run()  # nothing new: no batch
    assert batches == [0, 1, 1, 2, 2]
    got = spark.read.parquet(out).drop("batch")
    assert sorted(got.collect()) == sorted(spark.read.parquet(path).collect())
    offset = json.loads((tmp_path / "state" / "offset.json").read_text())
    assert offset["page"] in (35, 60)  # what is sure to be in the sink; the last batch is told with the next one


def test_sources_without_a_checkpoint(spark):
    sources = spark.createDataFrame([("a",), ("b",)], "source_id string")
    known = spark.createDataFrame([("a", '{"page": 3}', "e", None), ("z", "{}", None, None)], "source_id string, checkpoint string, etag string, last_modified string")
    assert sorted(tuple(r)[:3] for r in paged.checkpoints(sources, known).collect()) == [("a", '{"page": 3}', "e"), ("b", "{}", None)]


def test_a_source_is_written_by_the_versioned_sink(spark, tmp_path):
    spark.dataSource.register(registry.Daily)
    sink = versioned.VersionedSink(spark, f"{tmp_path}/sink")
    config = {"text": "t", "first": "2025-03-01", "last": "2025-03-03"}
    count = lambda df: {r.outcome: r.n for r in df.collect()}
    assert count(registry.run_source(spark, "example.daily", config, sink, "s")) == {"added": 3}
    assert count(registry.run_source(spark, "example.daily", {**config, "last": "2025-03-04"}, sink, "s")) == {"duplicate": 3, "added": 1}
    assert count(sink(registry.read_source(spark, "example.daily", {**config, "text": "new"}), "s")) == {"updated": 3}
    assert count(sink(registry.read_source(spark, "example.daily", {**config, "text": "new"}), "s", number=2)) == {"updated": 3}  # the same batch again
    assert sorted((r.external_id, r.content) for r in sink.current().collect()) == [("2025-03-01", "new"), ("2025-03-02", "new"), ("2025-03-03", "new"), ("2025-03-04", "t")]
    assert sink.versions().count() == 7
