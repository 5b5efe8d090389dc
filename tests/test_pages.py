"""Queries of pages against their SQL, on pages that share a URL and hold other entities than &amp;."""

import duckdb
import pytest

from feedloom.plans import catalog, flows  # noqa: F401
from feedloom.sources import extract

PAGE = "<html lang=\"en\"><body><nav><ul><li><a href=\"/a{0}\">A&amp;{0}</a></li><li><a href=\"/b\">b</a></li></ul></nav><article><h1>{1}</h1></article></body></html>"


@pytest.fixture
def both(spark, tmp_path):
    rows = [(0, "http://h.example/x", PAGE.format(0, "one")), (1, "http://h.example/x", PAGE.format(1, "two")), (2, "http://g.example/y?z", PAGE.format(2, "c"))]
    rows += [(i, f"http://g.example/{i}", PAGE.format(i, title)) for i, title in enumerate(("&quot;q&quot; &amp; r", "a &amp", "&amp;quot; &#39; &eacute;&lt;", "x&y"), 3)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")

    def rows_of(name):
        ours = catalog.QUERIES[name](spark, str(tmp_path))
        theirs = duck.execute(f"SELECT {', '.join(ours.columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
        return sorted(map(tuple, ours.collect())), sorted(theirs)

    return rows_of


def test_assets_of_pages_that_share_a_url(both):
    ours, theirs = both("page_asset_urls")
    assert ours == theirs and len(ours) == 14


def test_records_of_pages_that_share_a_url_and_entities(both, spark):
    ours, theirs = both("page_select")
    assert ours == theirs and len(ours) == 7
    pages = spark.createDataFrame([("u", "<h1 id=i>&quot;a&quot; &eacute;</h1>")], "url string, html string")  # the operator itself decodes them all
    row = extract.page_records(pages, extract.PageConfig(title="h1", attributes={"id": ("h1", "id"), "no": ("h1", "no")})).first()
    assert (row.title, row.attributes) == ('"a" é', {"id": "i"})
