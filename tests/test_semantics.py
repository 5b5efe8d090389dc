import datetime as dt

from pyspark.sql import functions as F

from feedloom.functions import expr
from feedloom.operators import scheduling, upsert
from feedloom.sources import extract
from feedloom.streaming import upsert_stream as upsert_module
from feedloom.streaming.upsert_stream import current, upsert_stream, writer


def test_versions_come_back(spark):
    rows = spark.createDataFrame([("s", "1", h, i) for i, h in enumerate("AABA")], "source_id string, external_id string, content_hash string, seq long")
    assert [r.outcome for r in upsert.outcomes(rows).orderBy("seq").collect()] == ["added", "duplicate", "updated", "updated"]
    assert upsert.version_history(rows).count() == 2
    assert upsert.current_state(rows).first().content_hash == "A"


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([("s", str(i % 5), "AB"[i // 7 % 2], i) for i in range(60)], "source_id string, external_id string, content_hash string, seq long")
    for k in range(3):
        rows.where(f"seq >= {20 * k} AND seq < {20 * k + 20}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    upsert_stream(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    state = {(r.external_id, r.content_hash, r.seq) for r in current(spark, str(tmp_path / "out"), rows.schema).collect()}
    assert state == {(r.external_id, r.content_hash, r.seq) for r in upsert.current_state(rows).collect()}
    assert len(list((tmp_path / "out" / "current" / "batch=2").glob("bucket=*"))) <= 5  # five keys: at most five buckets are rewritten
    got = spark.read.parquet(str(tmp_path / "out" / "outcomes")).groupBy("outcome").count().collect()
    assert {r["outcome"]: r["count"] for r in got} == {r["outcome"]: r["count"] for r in upsert.outcomes(rows).groupBy("outcome").count().collect()}


def test_stream_keeps_versions_and_runs_again(spark, tmp_path):
    rows = spark.createDataFrame([("s", "1", h, i) for i, h in enumerate("ABAC")], "source_id string, external_id string, content_hash string, seq long")
    path = str(tmp_path / "out")
    write = writer(path, rows.schema)
    read = lambda name: sorted((r.content_hash, r.seq, r.batch) for r in spark.read.parquet(f"{path}/{name}").collect())
    for number in (0, 1, 2, 2, 3, 3):
        write(rows.where(f"seq = {number}"), number)
    assert read("versions") == [("A", 0, 0), ("B", 1, 1), ("C", 3, 3)]
    assert read("current") == [("A", 2, 2), ("B", 1, 1), ("C", 3, 3)]  # those of the last three manifests
    assert [(r.content_hash, r.seq) for r in current(spark, path, rows.schema).collect()] == [("C", 3)]
    assert [r.outcome for r in spark.read.parquet(f"{path}/outcomes").orderBy("seq").collect()] == ["added", "updated", "updated", "updated"]


def test_stream_reads_few_segments_however_many_batches(spark, tmp_path, monkeypatch):
    """Versions of one key, a batch each, some run twice: what a batch opens is bounded, all versions stay, what isn't named is deleted."""
    monkeypatch.setattr(upsert_module, "FAN", 2)
    hashes = [f"h{i % 5}" for i in range(9)]
    rows = spark.createDataFrame([("s", "1", h, i) for i, h in enumerate(hashes)], "source_id string, external_id string, content_hash string, seq long")
    path, opened, of = str(tmp_path / "out"), [], upsert_module.of_segments
    monkeypatch.setattr(upsert_module, "of_segments", lambda spark, path, schema, segments: opened.append(len(list(segments))) or of(spark, path, schema, segments))
    write = writer(path, rows.schema)
    for number in range(9):
        for _ in range(2 if number in (3, 4) else 1):
            write(rows.where(f"seq = {number}"), number)
    assert max(opened) <= 4
    assert sorted((r.content_hash, r.seq) for r in upsert_module.versions(spark, path, rows.schema).collect()) == [(f"h{i}", i) for i in range(5)]
    assert [(r.content_hash, r.seq) for r in current(spark, path, rows.schema).collect()] == [("h3", 8)]
    got = [r.outcome for r in spark.read.parquet(f"{path}/outcomes").orderBy("seq").collect()]
    assert got == [r.outcome for r in upsert.outcomes(rows).orderBy("seq").collect()]
    assert len(list((tmp_path / "out" / "current").glob("batch=*/bucket=*"))) == 3


def test_backfill_windows(spark):
    one = spark.createDataFrame([(dt.datetime(2026, 7, 1), dt.datetime(2026, 7, 4))], "range_start timestamp_ntz, range_end timestamp_ntz")
    assert scheduling.backfill_windows(one, 86_400).count() == 3


def test_rss_item(spark):
    feed = "<rss><channel><title>t</title><item><guid>n/77</guid><title>Harbour</title><link>https://port.example/77</link><description>Tides</description><pubDate>Mon, 3 Feb 2025 10:20:30 +0100</pubDate></item></channel></rss>"
    row = extract.rss_items(spark.createDataFrame([(feed,), ("<rss><chan",)], "payload string")).collect()
    assert [(r.external_id, r.content) for r in row] == [("n/77", "Tides")]


def test_private_addresses_and_links(spark):
    rows = spark.createDataFrame([("127.0.0.1", "https://a.example/x/y", "../z"), ("example.com", "https://a.example/x/", "//b.example/q")], "host string, base string, ref string")
    got = rows.select(expr.private_address(F.col("host")).alias("p"), expr.join_url(F.col("base"), F.col("ref")).alias("u")).collect()
    assert [(r.p, r.u) for r in got] == [(True, "https://a.example/z"), (False, "https://b.example/q")]


def test_malformed_json_has_no_rows(spark):
    rows = spark.createDataFrame([(1, '{"data":[{"k":1},{}]}'), (2, '{"data":'), (3, None)], "id int, payload string")
    assert sorted((r.id, r.k or "") for r in extract.json_records(rows, "payload", "$.data", {"k": "$.k"}).collect()) == [(1, ""), (1, "1")]
