"""Queries of what may be fetched, and of what a write has seen."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from feedloom.operators import counters, lineage
from feedloom.plans.catalog import View, query
from feedloom.sources import robots

# each host's payload: groups for all and for one agent, patterns with wildcards and ends, a rule without a pattern
PAYLOAD = "\n".join(["# rules", "User-agent: other", "Disallow: /", "", "User-agent: *", "Disallow:", "Disallow: /", "", "User-Agent: Feedloom", "User-agent: another", "Disallow: /en/1", "allow: /en/1*?", "Disallow: /*page=", "Allow: /*page=2$", "Disallow: /de/*5$", "Crawl-delay: 5"])
OTHER = "\n".join(["User-agent: *", "Disallow: /fr", "Allow: /fr/*1 # a remark"])
HOST = "regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)"
# (pattern, like, allow): SQL's own reading of the rules, by LIKE; a path ends where the URL does
RULES = (("/en/1", "/en/1%", 0), ("/en/1*?", "/en/1%?%", 1), ("/*page=", "/%page=%", 0), ("/*page=2$", "/%page=2", 1), ("/de/*5$", "/de/%5", 0)), (("/fr", "/fr%", 0), ("/fr/*1", "/fr/%1%", 1))


@query(
    "robots_rules",
    f"""WITH p AS (SELECT page_id, url, {HOST} AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^#]*)', 1) AS path FROM pages),
r AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{p}', '{like}', {allow})" for i, group in enumerate(RULES) for p, like, allow in group)}) AS t(kind, pattern, form, allow)),
hit AS (SELECT page_id, pattern, allow, row_number() OVER (PARTITION BY page_id ORDER BY length(pattern) DESC, allow DESC, pattern) AS k FROM p JOIN r ON kind = length(host) % 2 AND path LIKE form)
SELECT p.page_id, pattern AS rule, COALESCE(allow = 1, true) AS may_fetch FROM p LEFT JOIN hit ON hit.page_id = p.page_id AND k = 1""",
)
def _(v: View):
    """Hosts with names of an even length have the first payload, others the second."""
    hosts = v("pages").select(F.lower(F.try_parse_url("url", F.lit("HOST"))).alias("host")).distinct()
    payloads = hosts.withColumn("payload", F.when(F.length("host") % 2 == 0, PAYLOAD).otherwise(OTHER))
    return robots.judged(v("pages").select("page_id", "url"), robots.rules(payloads, "feedloom/1.0")).select("page_id", "rule", "may_fetch")


# each document of a record's source with an even number has its two first words as assets
@query(
    "write_counters",
    """SELECT count(*) AS seen, CAST(sum(CASE WHEN seq % 2 = 0 THEN len(string_split(title, ' ')[1:2]) ELSE 0 END) AS BIGINT) AS assets, CAST(sum(length(content)) AS BIGINT) AS characters, CAST(sum(strlen(content)) AS BIGINT) AS bytes FROM records_v""",
)
def _(v: View):
    """Counted while the records are written to the shared folder."""
    rows = v("records_v").withColumn("assets", F.when(F.col("seq") % 2 == 0, F.slice(F.split("title", " "), 1, 2)))
    spark = rows.sparkSession
    path = f"{lineage.shared_folder(spark)}/records-{uuid.uuid4().hex}"
    counted = counters.written(rows, lambda df: df.write.parquet(path))
    return spark.createDataFrame([tuple(counted[n] for n in counters.NAMES)], ", ".join(f"{n} long" for n in counters.NAMES))
