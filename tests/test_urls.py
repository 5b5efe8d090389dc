"""References resolved as the standard library does it."""

import random
from urllib.parse import urljoin

from pyspark.sql import functions as F

from feedloom.functions import expr

BASES = ["http://h.example/a/b/c?q=1#f", "https://u:p@h.example:81/x;y", "http://h", "http://h/", "http://h/a/", "HTTP://H/a//b/../c", "http:///nohost/x", "http://h?only=query", "http://h/a/b;p?q"]
REFERENCES = [
    "g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "g;x", "g;x?y#s", "", ".", "./", "..", "../", "../g", "../..", "../../", "../../g", "../../../g", "/./g", "/../g", "g.", ".g", "g..", "..g", "./../g", "./g/.", "g/./h", "g/../h",
    "g;x=1/./y", "http:g", "http:/g", "http://Z/", "HTTP://Z/../q", "https:g", "mailto:a@b", "javascript:void(0)", "///x", "//h2", "//h2?q", "a//b", "/a//b", "a//../b", " lead", "\tx\ny", "?", "#", "g?", "g#", "a b", "é/ü", "x:y", "1:2", ":x", "a;b/c;d", "g;", "../;x", "..;x",
]


def test_as_the_standard_library_resolves(spark):
    draw = random.Random(3)
    pairs = [(b, r) for b in BASES for r in REFERENCES]
    pairs += [(draw.choice(BASES), "".join(draw.choice(["/", ".", "..", "a", "b", ";", "?", "#", "//", ":", " "]) for _ in range(draw.randint(1, 7)))) for _ in range(400)]
    pairs += [("", "g"), ("mailto:a@b", "g"), (None, "g"), ("http://h/", None)]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, base string, reference string")
    for r in rows.withColumn("url", expr.join_url(F.col("base"), F.col("reference"))).collect():
        assert r.url == (None if r.base is None or r.reference is None else urljoin(r.base, r.reference)), (r.base, r.reference)


def test_numbers_that_are_0_are_empty_in_ids(spark):
    row = spark.createDataFrame([(0, 0.0, "0", False, None, 7)], "a int, b double, c string, d boolean, e string, f long")
    import hashlib

    got = row.select(expr.stable_id(*[F.col(c) for c in "abcdef"]).alias("h")).first().h
    assert got == hashlib.sha256(b"||0|||7").hexdigest()


def test_json_that_cannot_be_read_is_told_apart(spark):
    rows = spark.createDataFrame([('{"b":1,"a":2}',), ('{"a": 2, "b": 1}',), ('{"a":1,"a":2}',), ('{"a":1,"a":3}',), ("{",), (None,)], "j string")
    got = [r.j for r in rows.select(expr.hashed_json(F.col("j")).alias("j")).collect()]
    assert got == ['{"a":2,"b":1}', '{"a":2,"b":1}', '{"a":1,"a":2}', '{"a":1,"a":3}', "{", None]
