"""Sharding by a hierarchical weighted hash tree.

A document descends region, rack and shard. At each node every child draws
``-ln(u) / weight`` from a hash of the document's key and the child's name, and
the smallest draw wins: children get rows in proportion to their weights, and
a changed weight moves rows only into or out of the subtree below it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table, with_rank

LEVELS = ("region", "rack", "shard")


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def topology(n: int, planned: int = 16, racks: int = 2, shards: int = 4) -> list[Leaf]:
    """The tree of n shards. The planned ones fill racks and regions; each one added beyond them is a region of its own,
    so that no weight inside the older regions changes and it takes rows only into itself. That law holds from `planned` on."""
    tree = [Leaf(f"r{s // (racks * shards)}", f"r{s // (racks * shards)}/k{s // shards % racks}", s) for s in range(min(n, planned))]
    return tree + [Leaf(f"x{s}", f"x{s}/k0", s) for s in range(planned, n)]


def children(tree: Sequence[Leaf]) -> list[tuple[str, str, float]]:
    """(parent, child, weight) of all levels; a node weighs what its shards weigh together."""
    weights: dict[tuple[str, str], float] = {}
    for leaf in tree:
        for edge in (("", leaf.region), (leaf.region, leaf.rack), (leaf.rack, f"{leaf.rack}/{leaf.shard}")):
            weights[edge] = weights.get(edge, 0) + leaf.weight
    return [(a, b, w) for (a, b), w in sorted(weights.items()) if w > 0]


def draw(key: Column, child: Column, weight: Column) -> Column:
    """52 bits of MD5 as a number in (0, 1), then an exponential draw."""
    bits = F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(":"), child).cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.ln((bits + 0.5) / F.lit(float(2**52))) / weight


def descend(key: Column, tree: Sequence[Leaf]) -> Column:
    """The shard (int) of a key, null for a null key."""
    of: dict[str, list[Column]] = {}
    for parent, child, weight in children(tree):
        of.setdefault(parent, []).append(F.struct(F.lit(child).alias("child"), F.lit(weight).alias("weight")))
    nodes = F.create_map(*[x for parent, below in of.items() for x in (F.lit(parent), F.array(*below))])
    at: Column = F.lit("")
    for _ in LEVELS:
        at = F.array_min(F.transform(F.element_at(nodes, at), lambda c: F.struct(draw(key, c["child"], c["weight"]).alias("draw"), c["child"].alias("child"))))["child"]
    return F.when(key.isNotNull(), F.element_at(F.split(at, "/"), -1).cast("int"))


def shard(docs: DataFrame, tree: Sequence[Leaf], grown: Sequence[Leaf] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and, given a grown tree, the shard there.

    The id alone decides the shard, so repeated rows share one; text and other
    columns don't matter. A null id goes to the shard of the key "null"; a null
    text has size 1 and the CRC of no bytes; an empty table gives no rows.
    Slots number a shard's rows from 0 in the order of id, text CRC and size.
    """
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
    )

    def placed(rows: DataFrame) -> DataFrame:
        key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
        there = descend(key, grown) if grown else F.lit(None).cast("int")
        return rows.withColumn("law", F.lit("key")).withColumn("shard", descend(key, tree)).withColumn("grown_shard", there)

    ranked = with_rank(base, ["shard"], ["doc_id", "text_crc32", "size"], "slot", then=placed)
    return ranked.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op5_weighted_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), topology(16), topology(17))


QUERIES = {"op5_weighted_tree": op5_weighted_tree}


def _level_sql(name: str, source: str, tree: str, parent: str) -> str:
    u = f"(CAST('0x' || substr(md5(concat(d.doc_id, ':', t.child)), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0"
    return f"{name} AS (SELECT d.doc_id, arg_min(t.child, -ln({u}) / t.weight) AS at FROM {source} d JOIN {tree} t ON t.parent = {parent} GROUP BY d.doc_id)"


def oracle() -> str:
    """DuckDB SQL of op5 but for text_crc32, which DuckDB has no function for; the tests compare the other columns with it."""
    parts = []
    for tree, n in (("base", 16), ("grown", 17)):
        rows = ", ".join(f"('{a}', '{b}', {w})" for a, b, w in children(topology(n)))
        parts += [f"{tree} AS (SELECT * FROM (VALUES {rows}) v(parent, child, weight))", _level_sql(f"{tree}1", "documents", tree, "''"), _level_sql(f"{tree}2", f"{tree}1", tree, "d.at"), _level_sql(f"{tree}3", f"{tree}2", tree, "d.at")]
    leaf = "CAST(string_split({0}.at, '/')[3] AS INT)"
    return f"""WITH {', '.join(parts)}
SELECT doc_id, COALESCE(octet_length(encode(d.text)), 0) + 1 AS size, 'key' AS law, {leaf.format('base3')} AS shard,
       row_number() OVER (PARTITION BY base3.at ORDER BY doc_id) - 1 AS slot, {leaf.format('grown3')} AS grown_shard
FROM documents d JOIN base3 USING (doc_id) JOIN grown3 USING (doc_id)"""
