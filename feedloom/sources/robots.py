"""robots.txt on tables: payloads of hosts become rules, and URLs are judged by a join with them.

A host's rules for an agent are those of all its groups that name the agent, or
else of those for `*`. The longest pattern that matches a path decides, and of
equally long ones one that allows. `*` stands for anything, `$` for the end; a
rule without a pattern says nothing, and what no rule matches is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a payload that are read, and rules of a host that are kept: the longest ones come first in judging.
MOST_BYTES = 500_000


def entries(payloads: DataFrame) -> DataFrame:
    """(host, n, key, value) of the lines that name agents or give rules; payloads: host, payload."""
    lines = payloads.select(F.lower("host").alias("host"), F.posexplode(F.split(F.left(F.coalesce("payload", F.lit("")), F.lit(MOST_BYTES)), "\r\n|\r|\n")).alias("n", "line"))
    bare = F.trim(F.regexp_replace(F.regexp_replace("line", "^﻿", ""), "#.*$", ""))
    key, value = F.lower(F.trim(F.regexp_extract(bare, "^([^:]*):", 1))), F.trim(F.regexp_extract(bare, "^[^:]*:(.*)$", 1))
    return lines.select("host", "n", key.alias("key"), value.alias("value")).where(F.col("key").isin("user-agent", "allow", "disallow"))


def rules(payloads: DataFrame, agent: str) -> DataFrame:
    """(host, allow, pattern, regex, length): what each host says to the agent. Payloads of a host that stand twice are read one after the other."""
    token = agent.split("/")[0].strip().lower()
    order = Window.partitionBy("host").orderBy("n", "key", "value")  # a payload's lines, at most MOST_BYTES of them
    before = F.lag("key").over(order)
    starts = ((F.col("key") == "user-agent") & (before.isNull() | (before != "user-agent"))).cast("int")
    grouped = entries(payloads).withColumn("start", starts).withColumn("group", F.sum("start").over(order)).where("group > 0")
    agents = grouped.where("key = 'user-agent'").select("host", "group", F.lower("value").alias("agent"))
    rank = F.when(F.col("agent") == token, 2).when(F.col("agent") == "*", 1)
    named = agents.withColumn("rank", rank).where("rank IS NOT NULL").groupBy("host", "group").agg(F.max("rank").alias("rank"))
    best = named.withColumn("best", F.max("rank").over(Window.partitionBy("host"))).where("rank = best").select("host", "group")
    chosen = grouped.where("key <> 'user-agent' AND value <> ''").join(best, ["host", "group"])
    quoted = F.regexp_replace("value", r"([.\\+?^{}()|\[\]])", r"\\$1")
    regex = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.regexp_replace(quoted, r"\*+", ".*"), r"\$$", "\\\\z"), r"\$", r"\\\$"))
    return chosen.select("host", (F.col("key") == "allow").alias("allow"), F.col("value").alias("pattern"), regex.alias("regex"), F.length("value").alias("length")).distinct()


def path_of(url: Column) -> Column:
    """Path and query, `/` for none."""
    path = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    return F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path))


def judged(urls: DataFrame, ruled: DataFrame, url: str = "url") -> DataFrame:
    """urls with `rule`, the pattern that decides (null: none does), and `may_fetch`. A host's rules, longest first, go to each of its URLs."""
    one = F.struct((-F.col("length")).alias("length"), (~F.col("allow")).alias("deny"), "pattern", "regex")
    of_host = ruled.groupBy(F.col("host").alias("__host")).agg(F.array_sort(F.collect_list(one)).alias("__rules"))
    rows = urls.drop("rule", "may_fetch").withColumn("__host", F.lower(F.try_parse_url(F.col(url), F.lit("HOST")))).withColumn("__path", path_of(F.col(url)))
    first = F.get(F.filter("__rules", lambda r: F.regexp_like(F.col("__path"), r["regex"])), F.lit(0))
    found = rows.join(of_host, "__host", "left").withColumn("__rule", first)
    kept = [c for c in urls.columns if c not in ("rule", "may_fetch")]
    return found.select(*kept, F.col("__rule.pattern").alias("rule"), F.coalesce(~F.col("__rule.deny"), F.lit(True)).alias("may_fetch"))
