"""Places and redaction where texts are long, spans overlap, and columns clash."""

import re
import time

import pytest
from pyspark.sql import functions as F

from feedloom.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_places_beyond_chunks_and_blocks(spark):
    """More matches than chunks of chunks hold, gaps across the pieces of a text, characters of two code units."""
    texts = ["é\U0001f600 " + "mail a@b.cd, " * 5000, ("x" * 700 + " a@b.co ") * 40, "\U0001f600" * 2000 + " a@b.co", "a@b.co" + " " * 1500 + "c@d.ef"]
    got = by_id(pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    for i, t in enumerate(texts):
        assert [(s.start, s.end) for s in got[i].spans if s.kind == "email"] == [m.span() for m in EMAIL.finditer(t)]
    red = by_id(pii.redact(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    for i, t in enumerate(texts):
        assert red[i].text == EMAIL.sub("[EMAIL]", t)


def test_time_grows_with_matches(spark):
    took = {}
    for n in (8_000, 80_000, 8_000, 80_000):
        df = spark.createDataFrame([(1, "mail a@b.cd, " * n)], "doc_id long, text string")
        start = time.perf_counter()
        assert pii.find_pii(df).select(F.size("spans")).first()[0] == n
        took[n] = time.perf_counter() - start
    assert took[80_000] < 15 * max(took[8_000], 1)


def test_context_words_are_read_across_blocks(spark):
    texts = ["y" * (pii.BLOCK - 6) + " card 4111 1111 1111 1111 " + "z" * 3000, "y" * (pii.BLOCK - 30) + " 4111 1111 1111 1111 placeholder", "ssn " + "q" * 40 + " 123-45-6789", "ssn " + "q" * 30 + " 123-45-6789"]
    got = by_id(pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [[(s.kind, s.score) for s in got[i].spans] for i in range(4)] == [[("card", 1.0)], [("card", 0.5)], [], [("ssn", 0.7)]]


@pytest.mark.parametrize("n", [1, 200])
def test_redaction_of_overlapping_spans(spark, n):
    rows = [(1, "0123456789" * n, [("a", 10 * i + a, 10 * i + b, 1.0) for i in range(n) for a, b in ((2, 5), (4, 7), (7, 8))]), (2, None, None), (3, "", []), (4, "abc", [("b", 0, 3, 1.0), ("a", 0, 2, 1.0)])]
    df = spark.createDataFrame(rows, f"doc_id int, text string, __spans {pii.SPAN}")
    got = by_id(df.withColumn("text", F.expr(pii.redacted("`text`", "__spans"))))
    assert got[1].text == "01[A][A]89" * n and got[2].text is None and got[3].text == "" and got[4].text == "[A]"


def test_clashing_columns_and_null_texts(spark):
    df = spark.createDataFrame([(1, None, "x", "kept", 1), (2, "a@b.co", "x", "kept", 1), (2, "a@b.co", "x", "kept", 1)], "doc_id long, text string, spans string, held string, found int")
    got = pii.find_pii(df)
    assert got.columns == df.columns and sorted(len(r.spans) for r in got.collect()) == [0, 1, 1]
    red = pii.redact(df)
    assert red.columns == df.columns and sorted((r.text or "", r.spans, r.held, r.found) for r in red.collect()) == [("", "x", "kept", 1), ("[EMAIL]", "x", "kept", 1), ("[EMAIL]", "x", "kept", 1)]
