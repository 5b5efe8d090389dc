"""Connected components of a graph in a table, by least labels and shortcuts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import save

Keep = Callable[[DataFrame, str], DataFrame]


def components(edges: DataFrame, keep: Keep = save) -> DataFrame:
    """(node, label): for every node of the undirected edges (a, b) the least node it reaches. Null ends and loops link nothing.

    Each round takes the least label of the neighbours and then the label's own
    label; rounds are about the logarithm of the longest path. Labels are
    written with `keep` each round and never come to the driver.
    """
    pairs = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    both = keep(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        heard = both.join(labels, both["a"] == labels["node"]).groupBy("b").agg(F.min("label").alias("heard"))
        near = labels.join(heard, labels["node"] == heard["b"]).select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        near = keep(near, "labels")
        jump = near.select(F.col("node").alias("at"), F.col("label").alias("far"))
        new = keep(near.join(jump, near["label"] == jump["at"]).select("node", "old", F.least("label", "far").alias("label")), "labels")
        if new.where("label <> old").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def merged(groups: DataFrame, links: DataFrame, keep: Keep = save) -> DataFrame:
    """The components (node, label) after more links (a, b): only the labels that they join are worked on again."""
    label = lambda end: groups.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label"))
    ends = links.join(label("a"), "a", "left").join(label("b"), "b", "left")
    joined = components(ends.select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")), keep)
    old = joined.select(F.col("node").alias("label"), F.col("label").alias("new"))
    moved = groups.join(old, "label", "left").select("node", F.coalesce("new", "label").alias("label"))
    return keep(moved.unionByName(joined.join(groups, "node", "left_anti").select("node", "label")), "groups")
