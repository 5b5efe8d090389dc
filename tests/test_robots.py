"""Rules of hosts, and URLs judged by them, against a plain reading."""

import re

from feedloom.sources import robots

PAYLOAD = """﻿User-agent: a
User-agent: Loom
Disallow: /x
Allow: /x/y*z$   # remark
Sitemap: http://h/s.xml

User-agent: *
Disallow: /

User-agent: loom
Disallow: /p.q
Disallow:
Allow: /x/$open
nonsense
"""


def test_groups_wildcards_and_longest_patterns(spark):
    payloads = spark.createDataFrame([("H", PAYLOAD), ("only-all", "User-agent: *\r\nDisallow: /a\rAllow: /a"), ("empty", None), ("rules-first", "Disallow: /\nUser-agent: *\nDisallow: /b")], "host string, payload string")
    got = {(r.host, r.allow, r.pattern) for r in robots.rules(payloads, "Loom/2.1").collect()}
    assert got == {("h", False, "/x"), ("h", True, "/x/y*z$"), ("h", False, "/p.q"), ("h", True, "/x/$open"), ("only-all", False, "/a"), ("only-all", True, "/a"), ("rules-first", False, "/b")}
    urls = ["http://h/x", "http://h/x/y/1/z", "http://h/x/y/1/z?", "https://H/p.q", "http://h/pxq", "http://h", "http://h/x/$open", "http://only-all/a/b", "http://rules-first/b?c#d", "http://rules-first/", "http://empty/x", "http://unknown/x", None, "nothing"]
    df = spark.createDataFrame([(u, "clash", 1) for u in urls], "url string, rule string, __n int")
    rows = robots.judged(df, robots.rules(payloads, "Loom/2.1"))
    assert rows.columns == ["url", "__n", "rule", "may_fetch"]
    assert {r.url: (r.rule, r.may_fetch) for r in rows.collect()} == {
        "http://h/x": ("/x", False), "http://h/x/y/1/z": ("/x/y*z$", True), "http://h/x/y/1/z?": ("/x", False), "https://H/p.q": ("/p.q", False), "http://h/pxq": (None, True), "http://h": (None, True),
        "http://h/x/$open": ("/x/$open", True), "http://only-all/a/b": ("/a", True), "http://rules-first/b?c#d": ("/b", False), "http://rules-first/": (None, True), "http://empty/x": (None, True),
        "http://unknown/x": (None, True), None: (None, True), "nothing": (None, True),
    }
    assert {r.pattern for r in robots.rules(payloads, "other").collect() if r.host == "h"} == {"/"}


def test_patterns_are_read_as_they_stand(spark):
    import random

    draw = random.Random(2)
    signs = "/ab.*$?+("
    patterns = ["/" + "".join(draw.choice(signs) for _ in range(draw.randint(0, 5))) for _ in range(60)]
    paths = ["/" + "".join(draw.choice("/ab.?+($") for _ in range(draw.randint(0, 6))) for _ in range(80)]
    payloads = spark.createDataFrame([(f"h{i}", f"User-agent: *\nDisallow: {p}") for i, p in enumerate(patterns)], "host string, payload string")
    urls = spark.createDataFrame([(f"http://h{i}{path}",) for i in range(len(patterns)) for path in paths], "url string")
    got = {r.url: r.may_fetch for r in robots.judged(urls, robots.rules(payloads, "x")).collect()}
    for i, p in enumerate(patterns):
        body, end = (p[:-1], r"\Z") if p.endswith("$") else (p, "")
        plain = re.compile(".*".join(re.escape(x) for x in re.split(r"\*+", body)) + end)
        for path in paths:
            assert got[f"http://h{i}{path}"] == (plain.match(path) is None), (p, path)
