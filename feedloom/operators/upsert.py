"""Idempotent versioned upsert of records: outcomes, current rows and version history, in arrival order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ("source_id", "external_id")


def outcomes(arrivals: DataFrame, current: DataFrame | None = None, key: Sequence[str] = KEY, digest: str = "content_hash", order: str = "seq") -> DataFrame:
    """Adds outcome: added, updated or duplicate, against the version before it; a key's first arrival against the stored row, if there is one."""
    before = F.lag(digest).over(Window.partitionBy(*key).orderBy(order))
    rows = arrivals.withColumn("__before", before)
    if current is not None:
        stored = current.select(*key, F.col(digest).alias("__stored"))
        rows = rows.join(stored, list(key), "left").withColumn("__before", F.coalesce("__before", "__stored")).drop("__stored")
    change = F.when(F.col("__before").isNull(), "added").when(F.col("__before") != F.col(digest), "updated").otherwise("duplicate")
    return rows.withColumn("outcome", change).drop("__before")


def current_state(arrivals: DataFrame, key: Sequence[str] = KEY, order: str = "seq") -> DataFrame:
    """The last arrival of each key; event times don't matter."""
    rest = [c for c in arrivals.columns if c not in key]
    last = arrivals.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("__last"))
    return last.select(*key, *[F.col(f"__last.{c}").alias(c) for c in rest])


def version_history(arrivals: DataFrame, stored: DataFrame | None = None, key: Sequence[str] = KEY, digest: str = "content_hash", order: str = "seq") -> DataFrame:
    """The first arrival of each key and hash that isn't stored: A, B, A are two versions."""
    rest = [c for c in arrivals.columns if c not in {*key, digest}]
    first = arrivals.groupBy(*key, digest).agg(F.min_by(F.struct(*rest), order).alias("__first"))
    rows = first.select(*key, digest, *[F.col(f"__first.{c}").alias(c) for c in rest])
    return rows if stored is None else rows.join(stored, [*key, digest], "left_anti")


def merge_checkpoints(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """The fresh checkpoint of each source; its validators, or those stored where it has none."""
    f = fresh.select("source_id", F.lit(True).alias("__fresh"), *[F.col(c).alias(f"new_{c}") for c in ("checkpoint", "etag", "last_modified")])
    both = stored.join(f, "source_id", "full")
    return (
        both
            .select(
                "source_id", F.when(F.col("__fresh"), F.col("new_checkpoint")).otherwise(F.col("checkpoint")).alias("checkpoint"),
                F.coalesce("new_etag", "etag").alias("etag"), F.coalesce("new_last_modified", "last_modified").alias("last_modified")
            )
    )
