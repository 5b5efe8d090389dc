"""The catalogue file, stores, selectors, claims, and streams with state."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from feedloom.failures import Failed
from feedloom.functions import expr
from feedloom.operators import scheduling, seen, transitions
from feedloom.sinks.assets import FolderStore
from feedloom.sources import catalogue, crawl, extract, html
from feedloom.streaming import keyed, ticks


def test_catalogue(spark, tmp_path):
    path = tmp_path / "sources.yaml"
    path.write_text("sources:\n- {id: news, fetcher: rss, schedule: {type: interval, seconds: 900}, routing: {queue: web}}\n- {id: lists, fetcher: web_list, enabled: false, schedule: {type: cron, cron: '5 4 * * 1'}, priority: 7}\n")
    rows, version = catalogue.load(spark, str(path))
    assert {r.source_id: (r.queue, r.priority, r.max_attempts, r.enabled) for r in rows.collect()} == {"news": ("web", 20, 3, True), "lists": ("default", 7, 3, False)}
    assert len(version) == 16
    good = {"id": "a", "schedule": {"type": "interval", "seconds": 60}}
    for bad in ({"id": "-a"}, {"schedule": {"type": "cron"}}, {"schedule": {"type": "interval", "seconds": 9}}, {"priority": 1000}, {"routing": {"slot_cost": 0}}, {"retry": {"max_attempts": 101}}):
        with pytest.raises(Failed):
            catalogue.checked({**good, **bad})
    path.write_text("sources:\n- {id: a, schedule: {type: once, at: 2025-01-01}}\n- {id: a, schedule: {type: once, at: 2025-01-01}}\n")
    with pytest.raises(Failed, match="twice"):
        catalogue.load(spark, str(path))


def test_asset_store(spark, tmp_path):
    rows = spark.createDataFrame([("s/1", "r..", "k", bytearray(b"abc")), ("s/1", "r..", "", bytearray(b"")), ("s", "r", "none", None)], "source_id string, external_id string, asset_key string, content binary")
    got = {r.asset_key: r for r in FolderStore(f"file://{tmp_path}").store(rows).collect()}
    assert (tmp_path / "s_1" / "r" / "k").read_bytes() == b"abc" and got["k"].size_bytes == 3 and got["none"].uri is None
    assert len(list(tmp_path.rglob("*"))) == 4 and got[""].uri.rpartition("/")[2] == "e3b0c44298fc1c149afb"


def test_selectors():
    page = "<div class='a b'><p>one<p id=x>two</div><script>no</script><div><p data-k='v'>three<br>four</p></div><ul><li><ul><li>in</li></ul>out</li></ul>"
    assert html.select(page, "div.a p") == ["one", "two"]
    assert html.select(page, "#x") == ["two"] and html.select(page, "p[data-k=v]") == ["three\nfour"] and html.select(page, "p[data-k]", "data-k") == ["v"]
    for bad in ("p:first-child", "a + b", "> p", "p,,q"):
        with pytest.raises(Failed):
            html.parsed(bad)
    assert html.select(page, "script") == [None] and html.select(page, "ul > li > ul > li") == ["in"] and html.select(page, "ul li ul li, #x") == ["two", "in"]


def test_end_tags_may_be_left_out():
    assert html.select("<ul><li>a<li>b<ul><li>c</ul>d</li><li>e</ul>", "li") == ["a", "b\nc\nd", "c", "e"]
    assert html.select("<p>one<p>two<div>three</div>four</p>", "p") == ["one", "two"] and html.select("<div><p>x<span>y</div>z", "p") == ["x\ny"]
    assert html.select("<table><tr><td>1<td>2<tr><td>3<table><tr><td>in</table>out</table>", "td") == ["1", "2", "3\nin\nout", "in"]
    assert html.select("<table><thead><tr><th>h<tbody><tr><td>1</table>", "tbody td") == ["1"] and html.select("<table><tr><td>1<tr><td>2</table>", "table > tr") == ["1", "2"]
    assert html.select("<dl><dt>t<dd>d<dt>u</dl>", "dd") == ["d"] and html.select("<select><option>1<option selected>2</select>", "option") == ["1", "2"]
    assert html.select("<div></li></div><b>x", "b") == ["x"] and html.select("<head><title>t</title><body><p>x", "body p") == ["x"]
    assert html.select("<ul><li><div><ul><li>x</li></ul></li><li>y</ul>", "li") == ["x", "x", "y"]
    deep = "<span>" * 20_000 + "x" + "<b>y</b>" * 20_000
    assert html.select(deep, "b")[:1] == ["y"]  # time doesn't grow with depth times length


def test_a_page_is_parsed_once_for_all_selectors(spark):
    rows = spark.createDataFrame([("<h1 lang=x>T</h1><p class='a b'>one<p>two",), (None,), ("",)], "html string")
    got = [r.f for r in rows.select(html.firsts(F.col("html"), title=("h1", None), lang=("h1", "lang"), second=("p.a", None), none=("i", None), no=(None, None)).alias("f")).collect()]
    assert [tuple(f) for f in got] == [("T", "x", "one", None, None), (None,) * 5, (None,) * 5]
    assert [len(r[0]) for r in rows.select(html.selected(F.col("html"), "p")).collect()] == [2, 0, 0]


def test_crawl_ends_on_cycles(spark):
    pages = spark.createDataFrame([(f"http://h/{i}", f"<a rel=next href='/{(i + 1) % 3}'>n</a><p><a href='/d'>d</a></p>") for i in range(3)], "url string, html string")
    starts = spark.createDataFrame([(1, "http://h/0")], "crawl int, url string")
    lists = crawl.list_pages(pages, starts, "a[rel=next]", max_pages=9)
    assert sorted(r.round for r in lists.collect()) == [0, 1, 2]
    assert [(r.url, r.round) for r in crawl.list_items(lists, "p").collect()] == [("http://h/d", 0)]


def test_full_text_wins_when_longer(spark):
    items = spark.createDataFrame([("u", "short"), ("v", "a long summary"), ("w", None)], "url string, content string")
    pages = spark.createDataFrame([("u", "<article>much longer</article>"), ("u", "<article>x</article>"), ("v", "<main>tiny</main>"), ("w", "<main>m</main>")], "url string, html string")
    assert {r.url: r.content for r in extract.enriched(items, pages, ["article", "main"]).collect()} == {"u": "much longer", "v": "a long summary", "w": "m"}


def emulated(candidates, slots, quota, held):
    """The walk over one worker's candidates, row by row."""
    got, held = [], {k: set(v) for k, v in held.items()}
    for c in candidates:
        if c["cost"] > slots or (c["backfill"] and quota is not None and c["cost"] > quota):
            continue
        free = {k: next((s for s in range(1, max(1, n) + 1) if s not in held.get(k, ())), None) for k, n in sorted(c["need"].items())}
        if None in free.values():
            continue
        for k, s in free.items():
            held.setdefault(k, set()).add(s)
        slots -= c["cost"]
        quota = quota - c["cost"] if c["backfill"] and quota is not None else quota
        got.append((c["id"], free))
    return got


def test_claims_equal_a_walk(spark):
    import random

    draw = random.Random(3)
    rows, want = [], {}
    held = {"a": [2], "c": [1, 2]}
    for node in ("n1", "n2", "n3"):
        own = [{"id": draw.randrange(10**6), "cost": draw.randint(1, 4), "backfill": draw.random() < 0.4, "need": {k: draw.randint(1, 3) for k in "abc" if draw.random() < 0.3}} for _ in range(40)]
        rows += [(node, i, c["id"], c["cost"], "backfill" if c["backfill"] else "scheduled", c["need"]) for i, c in enumerate(own, 1)]
        want[node] = emulated(own, 20, None if node == "n3" else 3, held)
    candidates = spark.createDataFrame(rows, "node_id string, n int, id long, slot_cost int, workload string, resources map<string,int>")
    slots = spark.createDataFrame([("n1", 20, 3), ("n2", 20, 3), ("n3", 20, None)], "node_id string, slots int, backfill_left long")
    leases = spark.createDataFrame([(k, s, dt.datetime(2030, 1, 1)) for k, v in held.items() for s in v] + [("b", 1, dt.datetime(2020, 1, 1))], "resource_key string, slot int, expires_at timestamp_ntz")
    got: dict = {}
    claims = scheduling.claim_greedy(candidates, slots, scheduling.held_slots(leases, dt.datetime(2025, 1, 1)))
    for r in claims.orderBy("node_id", "n").collect():
        got.setdefault(r.node_id, []).append((r.id, {x.key: x.slot for x in r.leases}))
    assert got == want
    assert scheduling.lease_rows(claims, dt.datetime(2025, 1, 1)).first().expires_at == dt.datetime(2025, 1, 1, 0, 5)


def test_offers_are_disjoint(spark):
    tasks = spark.createDataFrame([(i, "q", "", None, i % 3, dt.datetime(2024, 1, 1), None, "pending") for i in range(100)] + [(200, "q", "", "b", 0, dt.datetime(2024, 1, 1), None, "retry"), (201, "q", "", "z", 0, dt.datetime(2024, 1, 1), None, "retry")], "id long, queue string, caps_csv string, preferred_worker string, priority int, not_before timestamp_ntz, batch_id long, status string")
    workers = spark.createDataFrame([(w, "online", "x", "q") for w in "abc"], "node_id string, effective_state string, caps_csv string, queues_csv string")
    batches = spark.createDataFrame([], "id long, status string")
    got = scheduling.offers(tasks, workers, batches, dt.datetime(2025, 1, 1)).collect()
    assert len(got) == len({r.id for r in got}) == 101 and {r.node_id for r in got if r.id == 200} == {"b"} and {r.node_id for r in got} == {"a", "b", "c"}
    slots = spark.createDataFrame([("a", 3), ("b", 0)], "node_id string, slots int")
    assert {r.node_id for r in scheduling.offers(tasks, workers, batches, dt.datetime(2025, 1, 1), slots=slots).collect()} == {"a"}


def test_spread_and_retirement(spark):
    config = spark.createDataFrame([("new", "s", True, "interval", 45, None), ("old", "s", True, "interval", 45, None)], "source_id string, spec string, enabled boolean, schedule_type string, seconds int, first_run_at timestamp_ntz")
    sources = spark.createDataFrame([("old", "config", True, "x"), ("gone", "config", True, "x"), ("api", "api", True, "x")], "source_id string, managed_by string, enabled boolean, config_hash string")
    schedules = spark.createDataFrame([("old", True, dt.datetime(2025, 5, 5)), ("gone", True, dt.datetime(2025, 5, 5)), ("api", True, dt.datetime(2025, 6, 6))], "source_id string, enabled boolean, next_run_at timestamp_ntz")
    now = dt.datetime(2025, 1, 1)
    got = {r.source_id: r for r in transitions.reconcile(config, sources, schedules, now).collect()}
    assert {k: (r.action, r.enabled) for k, r in got.items()} == {"new": ("insert", True), "old": ("update", True), "gone": ("retire", False), "api": ("keep", True)}
    assert got["old"].next_run_at == dt.datetime(2025, 5, 5) and got["gone"].next_run_at is None and got["api"].next_run_at == dt.datetime(2025, 6, 6)
    import hashlib

    assert (got["new"].next_run_at - now).total_seconds() == int(hashlib.sha256(b"new").hexdigest(), 16) % 45


def stream_of(spark, rows, schema, path, parts):
    for k in range(parts):
        spark.createDataFrame(rows[k::parts] if parts == 1 else [r for r in rows if r[-1] == k], schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_keys_expire(spark, tmp_path):
    at = lambda s: dt.datetime(2025, 1, 1) + dt.timedelta(seconds=s)
    rows = [("a", at(0), 0), ("b", at(10), 0), ("a", at(50), 1), ("c", at(200), 2), ("c", at(205), 3), ("d", at(900), 4)]
    beats = stream_of(spark, rows, "key string, ts timestamp, part int", tmp_path / "in", 5)
    keyed.expiring(beats, 60).writeStream.format("memory").queryName("expiry").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = {(r.key, r.state, r.at) for r in spark.table("expiry").collect()}
    assert got >= {("a", "live", at(0)), ("b", "live", at(10)), ("b", "expired", at(70)), ("a", "expired", at(110)), ("c", "live", at(200)), ("c", "expired", at(265)), ("d", "live", at(900))}
    assert not [x for x in got if x[:2] == ("d", "expired")]


def test_ticks_register_what_is_due_once(spark, tmp_path):
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    ago = lambda s: now - dt.timedelta(seconds=s)
    rows = [("source:a", "a", True, ago(3600), None), ("source:b", "b", True, ago(60), 7), ("source:c", "c", True, now + dt.timedelta(days=1), None), ("source:d", "d", True, ago(60), None), ("source:e", "e", False, ago(60), None)]
    schedules = spark.createDataFrame(rows, "schedule_id string, source_id string, enabled boolean, next_run_at timestamp_ntz, active_task_id long")
    sources = spark.createDataFrame([(s, s != "d") for s in "abcde"], "source_id string, enabled boolean")
    out = f"{tmp_path}/tasks"
    query = ticks.ticking(spark, lambda: (schedules, sources), seen.SeenKeys(spark, f"file://{tmp_path}/index", buckets=2), lambda df, n: df.write.mode("overwrite").parquet(f"{out}/tick={n}"), f"{tmp_path}/c", seconds=1)
    for _ in range(120):
        if len(list((tmp_path / "tasks").glob("tick=*"))) >= 3:
            break
        query.awaitTermination(1)
    keyed.drain(query)
    assert not query.isActive
    got = spark.read.schema("dedupe_key string, schedule_id string, source_id string, scheduled_for timestamp_ntz").parquet(out).collect()
    assert [(r.source_id, r.scheduled_for) for r in got] == [("a", ago(3600))] and got[0].dedupe_key == f"schedule:source:a:{ago(3600).isoformat()}+00:00"


def test_cron_lines(spark):
    rows = spark.createDataFrame([("cron", "30 6 1 * *", "Europe/Berlin"), ("cron", "0 0 * * 0", "UTC"), ("once", None, "UTC"), ("interval", None, None)], "kind string, cron string, zone string")
    after = F.expr("TIMESTAMP_NTZ '2025-10-15 12:00:00'")
    got = rows.select("kind", scheduling.next_run(F.col("kind"), F.lit(90), F.lit(None).cast("timestamp_ntz"), F.col("cron"), F.col("zone"), after).alias("t")).collect()
    assert [r.t for r in got] == [dt.datetime(2025, 11, 1, 5, 30), dt.datetime(2025, 10, 19), None, dt.datetime(2025, 10, 15, 12, 1, 30)]


def test_canonical_forms(spark):
    row = spark.createDataFrame([("{\"b\": 1, \"a\" : [1, {\"z\":null}]}", dt.datetime(2025, 1, 2, 3, 4, 5, 60))], "j string, t timestamp_ntz")
    got = row.select(expr.canonical_json(F.col("j")).alias("j"), expr.iso_utc(F.col("t")).alias("t")).first()
    assert (got.j, got.t) == ('{"a":[1,{"z":null}],"b":1}', "2025-01-02T03:04:05.000060+00:00")
