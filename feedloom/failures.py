"""Failures: a table of their classes for queries to join, and one exception that names a class of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Each class that runs and reports carry, whether such a task is tried again, and what has happened.
CLASSES = (
    ("transient", True, "the other side failed and may recover"),
    ("rate_limited", True, "the other side asks to wait"),
    ("timeout", True, "it took too long"),
    ("network", True, "no connection, or a broken one"),
    ("unknown", True, "nothing is known of it"),
    ("authentication", False, "the credentials don't do"),
    ("configuration", False, "the source isn't set up as it must be"),
    ("permanent", False, "the same would come of another try"),
    ("fetcher_error", False, "the fetcher failed by itself"),
)


class Failed(Exception):
    """What ends a task; `kind` is one of the classes."""

    def __init__(self, kind: str, what: str):
        if kind not in {c for c, _, _ in CLASSES}:
            raise ValueError(f"no class of failures: {kind}")
        super().__init__(what)
        self.kind = kind


def bad(what: str) -> Failed:
    """A fault of the configuration."""
    return Failed("configuration", what)


def classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CLASSES, "error_class string, retryable boolean, meaning string")


def classified(runs: DataFrame) -> DataFrame:
    """Runs or reports with retryable and meaning of their error_class; one that isn't in the table counts as unknown, none has neither."""
    known = F.broadcast(classes(runs.sparkSession))  # the rows above
    named = F.when(F.col("error_class").isin(*[c for c, _, _ in CLASSES]), F.col("error_class")).when(F.col("error_class").isNotNull(), "unknown")
    base = runs.drop("retryable", "meaning")
    return base.withColumn("__class", named).join(known.withColumnRenamed("error_class", "__class"), "__class", "left").drop("__class")
