"""Payload tables to records: feeds, pages, lists of links, JSON and sitemaps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions import expr
from feedloom.sources import html as pages_html

#: Fields of a record that a mapping may fill; others become attributes.
KNOWN = ("external_id", "url", "title", "content", "content_type", "language", "published_at")
ITEM = "guid:string,link:string,title:string,description:string,`content:encoded`:string,pubDate:string,author:string,`dc:creator`:string,enclosure:array<struct<_url:string,_type:string>>"
ENTRY = "id:string,title:string,link:array<struct<_href:string,_rel:string,_type:string>>,summary:string,content:string,published:string,updated:string,author:struct<name:string>"
FEED = f"channel struct<title:string,item:array<struct<{ITEM}>>>, title string, entry array<struct<{ENTRY}>>"


def element_text(html: Column, tag: str) -> Column:
    """The text in the first element of a tag, inner tags, scripts and styles dropped; null if there is none or it is blank.

    For elements that don't contain others of their own tag; `sources.html` has none of these limits."""
    shown = F.regexp_replace(html, r"(?s)<(script|style)\b[^>]*>.*?</\1>", "")
    inner = F.regexp_extract(shown, rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)
    return expr.blank_to_null(F.regexp_replace(inner, "<[^>]*>", ""))


def pages_to_records(pages: DataFrame) -> DataFrame:
    """One record per page: the title from h1 or title, the content from article or body."""
    title = F.coalesce(element_text(F.col("html"), "h1"), element_text(F.col("html"), "title"))
    content = F.coalesce(element_text(F.col("html"), "article"), element_text(F.col("html"), "body"))
    return pages.select(F.col("page_id").cast("string").alias("external_id"), "url", title.alias("title"), content.alias("content"))


@dataclass(frozen=True)
class PageConfig:
    """Where a page's record comes from; selectors as in `sources.html`."""

    title: str | None = "title"
    content: str = "body"
    published: str | None = None
    external_id: str | None = None
    external_id_attribute: str | None = None
    attributes: Mapping[str, str | tuple[str, str]] = field(default_factory=dict)  # a selector, or one with an element's attribute
    asset: str | None = None
    asset_attribute: str = "href"
    kind: str = "web_page"


def page_records(pages: DataFrame, config: PageConfig) -> DataFrame:
    """A record per page (url, html): the id falls back to the URL, attributes that aren't found are left out."""
    names = {f"a{i}": name for i, name in enumerate(config.attributes)}
    asked = {k: (want, None) if isinstance(want, str) else want for k, want in zip(names, config.attributes.values())}
    wants = {"id": (config.external_id, config.external_id_attribute), "title": (config.title, None), "content": (config.content, None), "time": (config.published, None)}
    once = pages.withColumn("__found", pages_html.firsts(F.col("html"), **wants, **asked))
    f = lambda name: F.col("__found")[name]
    held = [x for k, name in names.items() for x in (F.lit(name), f(k))]
    attributes = F.map_filter(F.create_map(*held), lambda k, v: v.isNotNull()) if held else F.create_map().cast("map<string,string>")
    return once.select(
        F.coalesce(f("id"), F.col("url")).alias("external_id"), F.lit(config.kind).alias("kind"), "url", f("title").alias("title"), f("content").alias("content"), F.lit("text/plain").alias("content_type"),
        expr.parse_time(f("time")).alias("published_at"), attributes.alias("attributes"),
    )


def page_assets(pages: DataFrame, config: PageConfig) -> DataFrame:
    """asset_key and asset_url, beside the page's own columns, of each element that the asset selector finds and that has the attribute; keys carry its place."""
    rest = [c for c in pages.columns if c != "html"]
    raw = pages.select(*rest, F.posexplode(pages_html.selected(F.col("html"), config.asset, config.asset_attribute)).alias("pos", "raw")).where("raw <> ''")
    whole = raw.withColumn("asset_url", expr.join_url(F.col("url"), F.col("raw")))
    return whole.select(*rest, F.format_string("asset-%d-%s", "pos", F.left(expr.stable_id(F.col("asset_url")), F.lit(12))).alias("asset_key"), "asset_url")


def links(pages: DataFrame, most: int | None = None) -> DataFrame:
    """(page_id, pos, href): a page's distinct links in order of first place, at most so many."""
    found = pages.select("page_id", F.posexplode(F.array_distinct(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1)))).alias("pos", "href"))
    return found if most is None else found.where(F.col("pos") < most)


def feed_entries(feeds: DataFrame, payload: str = "payload", most: int = 200) -> DataFrame:
    """A row per RSS item or Atom entry, the first `most` of each feed: pos and `e` in one shape for both."""
    parsed = feeds.withColumn("__feed", F.from_xml(F.col(payload), FEED)).drop(payload)
    rss = F.transform("__feed.channel.item", lambda i: F.struct(
        i["guid"].alias("id"), i["link"].alias("link"), i["title"].alias("title"), i["content:encoded"].alias("full"), i["description"].alias("summary"), i["pubDate"].alias("time"),
        F.coalesce(i["author"], i["dc:creator"]).alias("author"), F.transform(i["enclosure"], lambda x: F.struct(x["_url"].alias("url"), x["_type"].alias("type"))).alias("enclosures"),
    ))
    plain = lambda e: F.filter(e["link"], lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    atom = F.transform("__feed.entry", lambda e: F.struct(
        e["id"].alias("id"), F.try_element_at(plain(e), F.lit(1))["_href"].alias("link"), e["title"].alias("title"), e["content"].alias("full"), e["summary"].alias("summary"), F.coalesce(e["published"], e["updated"]).alias("time"),
        e["author"]["name"].alias("author"), F.transform(F.filter(e["link"], lambda x: x["_rel"] == "enclosure"), lambda x: F.struct(x["_href"].alias("url"), x["_type"].alias("type"))).alias("enclosures"),
    ))
    rest = [c for c in feeds.columns if c != payload]
    title = F.coalesce("__feed.channel.title", "__feed.title").alias("feed_title")
    rows = parsed.select(*rest, title, F.posexplode(F.slice(F.coalesce(rss, atom), 1, most)).alias("pos", "e"))
    fallback = expr.stable_id(F.to_json("e"))
    return rows.withColumn("external_id", expr.first_filled(F.col("e.id"), F.col("e.link"), F.trim("e.title"), fallback))


def rss_items(feeds: DataFrame, payload: str = "payload", most: int = 200) -> DataFrame:
    """A record per entry of RSS and Atom feeds. The id falls back over id, link, title and a hash of the entry; the content over the full text, the
    summary and the title. Malformed feeds have none."""
    rows = feed_entries(feeds, payload, most)
    rest = [c for c in feeds.columns if c != payload]
    return rows.select(
        *rest, "pos", "external_id", expr.blank_to_null(F.col("e.title")).alias("title"), F.nullif("e.link", F.lit("")).alias("url"),
        expr.first_filled(F.col("e.full"), F.col("e.summary"), F.trim("e.title")).alias("content"), expr.parse_time(F.col("e.time")).alias("published_at"),
        F.nullif("e.author", F.lit("")).alias("author"), "feed_title",
    )


def feed_enclosures(feeds: DataFrame, payload: str = "payload", most: int = 200) -> DataFrame:
    """An asset per enclosure with a URL."""
    rest = [c for c in feeds.columns if c != payload]
    each = feed_entries(feeds, payload, most).select(*rest, "external_id", F.explode("e.enclosures").alias("x")).where("x.url <> ''")
    return (
        each
            .select(
                *rest, "external_id", F.left(expr.stable_id(F.col("x.url")), F.lit(24)).alias("asset_key"), F.col("x.url").alias("url"),
                F.col("x.type").alias("media_type")
            )
    )


def feed_status(feeds: DataFrame, payload: str = "payload") -> DataFrame:
    """ok, empty, or malformed (neither well-formed nor any entry, an error of configuration) for each feed."""
    parsed = F.from_xml(F.col(payload), FEED)
    n = F.greatest(F.size(parsed["channel"]["item"]), F.size(parsed["entry"]))
    known = parsed["channel"].isNotNull() | parsed["title"].isNotNull() | parsed["entry"].isNotNull()
    return feeds.withColumn("status", F.when(n > 0, "ok").when(F.coalesce(known, F.lit(False)), "empty").otherwise("malformed")).drop(payload)


def sitemap_locs(maps: DataFrame, payload: str = "payload") -> DataFrame:
    """A row per loc, trimmed, blank ones dropped; is_index tells a sitemap index from a set of pages."""
    locs = F.expr(f"xpath({payload}, \"//*[local-name()='loc']/text()\")")
    rows = maps.select("*", F.contains(payload, F.lit("<sitemapindex")).alias("is_index"), F.explode(locs).alias("loc")).drop(payload)
    return rows.withColumn("loc", F.trim("loc")).where("loc <> ''")


def json_records(rows: DataFrame, payload: str, items: str, fields: Mapping[str, str]) -> DataFrame:
    """A row per element of the array at path `items`, with each field as a string; fields that are missing are null, malformed payloads have no rows."""
    own = [F.expr(f"try_variant_get(value, '{path}', 'string')").alias(name) for name, path in fields.items()]
    return json_items(rows, payload, items).select(*[c for c in rows.columns if c != payload], *own)


def json_items(rows: DataFrame, payload: str, items: str) -> DataFrame:
    """The elements of the array at path `items`, as a variant `value`."""
    name = "{rows}"
    return (
        rows.sparkSession.sql(
            f"SELECT * EXCEPT ({payload}, pos, key) FROM {name}, LATERAL variant_explode(try_variant_get(try_parse_json({payload}), '{items}', 'variant'))",
            rows=rows
        )
    )


def json_api_records(rows: DataFrame, payload: str, items: str, fields: Mapping[str, str], id_field: str = "external_id") -> DataFrame:
    """A record per element: known fields as columns, the other mapped ones as attributes, the id from its field or else a hash of the element."""
    base = [c for c in rows.columns if c != payload]
    each = json_items(rows, payload, items)
    value = lambda name: F.expr(f"try_variant_get(value, '{fields[name]}', 'string')") if name in fields else F.lit(None).cast("string")
    extra = [x for name in fields if name not in KNOWN for x in (F.lit(name), value(name))]
    attributes = F.create_map(*extra) if extra else F.create_map().cast("map<string,string>")
    return each.select(
        *base, F.coalesce(value(id_field), expr.stable_id(F.to_json("value"))).alias("external_id"), value("url").alias("url"), value("title").alias("title"), value("content").alias("content"),
        F.coalesce(F.nullif(value("content_type"), F.lit("")), F.lit("application/json")).alias("content_type"), F.nullif(value("language"), F.lit("")).alias("language"),
        expr.parse_time(value("published_at")).alias("published_at"), attributes.alias("attributes"),
    )


def enriched(items: DataFrame, pages: DataFrame, selectors: Sequence[str] = ()) -> DataFrame:
    """items (url, content) with the page's full text where it is longer: what the first fitting selector gives of `html`, or `content`.

    A URL on several pages counts once, with its longest text."""
    if selectors:
        wanted = {f"s{i}": (s, None) for i, s in enumerate(selectors)}
        pages = pages.select("url", pages_html.firsts(F.col("html"), **wanted).alias("f")).select("url", F.coalesce(*[F.col("f")[k] for k in wanted]).alias("content"))
    full = pages.groupBy("url").agg(F.max_by("content", F.struct(F.length("content"), "content")).alias("__full"))
    both = items.join(full, "url", "left")
    return (
        both
            .withColumn(
                "content", F.when(F.length("__full") > F.length(F.coalesce("content", F.lit(""))), F.col("__full")).otherwise(F.col("content"))
            ).drop("__full")
    )


def micro_batches(records: DataFrame, size: int = 100, key: str = "source_id", order: str = "seq", width: int = 1_000_000) -> DataFrame:
    """Adds the flush (from 0) in which a record of a source is written.

    A source's records are counted by stretches of `order` (a long) first: running sums of these counts say where a
    stretch starts, and only a stretch is numbered in one task, however many records a source has."""
    part = F.floor(F.col(order) / width)
    rows = records.withColumn("__part", part)
    counts = rows.groupBy(key, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.withColumn("__start", F.coalesce(before, F.lit(0))).drop("__n")
    place = F.col("__start") + F.row_number().over(Window.partitionBy(key, "__part").orderBy(order)) - 1
    return rows.join(starts, [key, "__part"]).withColumn("flush", F.floor(place / size).cast("int")).drop("__part", "__start")
