"""Crawls over tables of fetched documents (url and payload), a round of joins for each step: lists with next links, sitemap indexes, paged JSON.

They follow what a fetch has stored. Rounds are bounded by the caps below, URLs are visited once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions import expr
from feedloom.operators.lineage import cut
from feedloom.sources import extract
from feedloom.sources import html as pages_html


def rounds(starts: DataFrame, step, most: int) -> DataFrame:
    """(crawl, url, round) of all URLs reached from the starts (crawl, url); `step` maps a frontier to the URLs after it. Each is visited once."""
    frontier = cut(starts.select("crawl", "url").distinct().withColumn("round", F.lit(0)))
    seen = [frontier]
    for n in range(1, most):
        found = step(frontier.select("crawl", "url")).where("url <> ''").select("crawl", "url").distinct()
        frontier = cut(found.join(reduce(DataFrame.unionByName, seen), ["crawl", "url"], "left_anti").withColumn("round", F.lit(n)))
        if frontier.isEmpty():
            break
        seen.append(frontier)
    return reduce(DataFrame.unionByName, seen)


def list_pages(pages: DataFrame, starts: DataFrame, next_selector: str | None, next_attribute: str = "href", max_pages: int = 10) -> DataFrame:
    """(crawl, url, round, html) of the list pages reached over next links, the first `max_pages` of a crawl."""

    def step(frontier: DataFrame) -> DataFrame:
        here = frontier.join(pages.select("url", "html"), "url")
        return here.select("crawl", expr.join_url(F.col("url"), pages_html.first(F.col("html"), next_selector, next_attribute)).alias("url"))

    reached = rounds(starts, step, max_pages) if next_selector else rounds(starts, lambda f: f.limit(0), 1)
    return capped(reached.join(pages.select("url", "html"), "url"), max_pages)


def capped(rows: DataFrame, most: int) -> DataFrame:
    """The first rows of each crawl by round and URL."""
    place = F.row_number().over(Window.partitionBy("crawl").orderBy("round", "url"))
    return rows.withColumn("__place", place).where(F.col("__place") <= most).drop("__place")


def list_items(lists: DataFrame, item_selector: str, link_selector: str = "a", attribute: str = "href", max_items: int = 500) -> DataFrame:
    """(crawl, round, list_url, pos, url): the details' URLs in order of place, each once per crawl, at most `max_items` of a crawl."""
    both = ",".join(f"{i} {k}" for i in item_selector.split(",") for k in link_selector.split(","))
    found = (
        lists
            .select(
                "crawl", "round", F.col("url").alias("list_url"),
                F.posexplode(pages_html.selected(F.col("html"), both, attribute)).alias("pos", "raw")
            )
            .where("raw <> ''")
    )
    whole = found.withColumn("url", expr.join_url(F.col("list_url"), F.col("raw")))
    order = ["round", "list_url", "pos"]
    once = whole.withColumn("__n", F.row_number().over(Window.partitionBy("crawl", "url").orderBy(*order))).where("__n = 1")
    return once.withColumn("__n", F.row_number().over(Window.partitionBy("crawl").orderBy(*order))).where(F.col("__n") <= max_items).drop("__n", "raw")


def list_records(items: DataFrame, pages: DataFrame, config: extract.PageConfig) -> DataFrame:
    """The details' records; items whose page isn't there have none."""
    return extract.page_records(items.select("url").distinct().join(pages.select("url", "html"), "url"), config)


def sitemap_pages(documents: DataFrame, starts: DataFrame, max_urls: int = 1000, max_rounds: int = 10) -> DataFrame:
    """(crawl, url): the pages named by the sitemaps reached from the starts over indexes; documents: url, payload. At most `max_urls` of a crawl.

    A page named twice is listed twice, as the sink is idempotent."""

    def locs(frontier: DataFrame) -> DataFrame:
        return extract.sitemap_locs(frontier.join(documents.select("url", "payload"), "url"))

    reached = rounds(starts, lambda f: locs(f).where("is_index").select("crawl", F.col("loc").alias("url")), max_rounds)
    named = locs(reached).where("NOT is_index")
    return capped(named.select("crawl", "round", F.col("loc").alias("url")), max_urls).select("crawl", "url")


def numbered_pages(responses: DataFrame, starts: DataFrame, items: str, parameter: str, first: int = 1, most: int = 10) -> DataFrame:
    """(crawl, page, url, payload) of the pages with numbers from `first`, up to the first one that is missing or has no items; responses: url, payload."""
    numbers = starts.select("crawl", F.col("url").alias("base"), F.explode(F.sequence(F.lit(first), F.lit(first + most - 1))).alias("page"))
    asked = numbers.withColumn("url", expr.with_parameter(F.col("base"), parameter, F.col("page"))).join(responses.select("url", "payload"), "url", "left")
    n = F.expr(f"json_array_length(to_json(try_variant_get(try_parse_json(payload), '{items}', 'variant')))")
    ends = asked.where(F.coalesce(n, F.lit(0)) == 0).groupBy("crawl").agg(F.min("page").alias("end"))
    return asked.join(ends, "crawl", "left").where(F.col("end").isNull() | (F.col("page") < F.col("end"))).select("crawl", "page", "url", "payload")


def linked_pages(responses: DataFrame, starts: DataFrame, next_path: str, most: int = 10) -> DataFrame:
    """(crawl, url, round, payload) of the pages reached over the link at `next_path` of each."""

    def step(frontier: DataFrame) -> DataFrame:
        following = F.expr(f"try_variant_get(try_parse_json(payload), '{next_path}', 'string')")
        return frontier.join(responses.select("url", "payload"), "url").select("crawl", expr.join_url(F.col("url"), following).alias("url"))

    return rounds(starts, step, most).join(responses.select("url", "payload"), "url")
