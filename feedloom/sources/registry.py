"""Fetchers, sinks and asset stores as rows of a table. A fetcher is a Spark data source that its row names.

What a plugin may be called and do is judged in columns, sources find their
plugins by a join, and a source is read with `spark.read.format(name)`. Code
comes in with `spark.dataSource.register` or from an installed package.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from feedloom.failures import bad

PLUGIN = "kind string, name string, version string, api_version string, operations array<string>, queue string"
#: Kinds of plugins, what fetchers do, and the form of a name.
KINDS, OPERATIONS, NAME = ("fetcher", "sink", "asset_store"), ("fetch", "backfill"), "^[a-z0-9][a-z0-9_.-]{0,190}$"
RECORD = "external_id string, content string, tags array<string>, published_at timestamp"


def capability(kind: Column, name: Column, api_version: Column) -> Column:
    """What a worker that has the plugin offers."""
    return F.concat(kind, F.lit(":"), name, F.lit(":api-v"), api_version)


def checked(plugins: DataFrame) -> DataFrame:
    """Plugins with their capability, or an error: an unknown kind, a bad name, an unknown operation, a name taken before (by version)."""
    place = F.row_number().over(Window.partitionBy("kind", "name").orderBy("version", "api_version"))
    bad_operation = ~F.forall(F.coalesce("operations", F.array().cast("array<string>")), lambda o: o.isin(*OPERATIONS))
    error = (
        F.when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "kind").when(~F.coalesce(F.col("name").rlike(NAME), F.lit(False)), "name")
        .when(bad_operation, "operation").when(place > 1, "taken")
    )
    return plugins.withColumn("error", error).withColumn("capability", F.when(F.col("error").isNull(), capability(F.col("kind"), F.col("name"), F.col("api_version"))))


def resolved(sources: DataFrame, plugins: DataFrame) -> DataFrame:
    """Sources (source_id, fetcher, sink, ...) with the capabilities that their tasks need, or what is missing."""
    good = checked(plugins).where("error IS NULL")
    of = lambda kind: good.where(F.col("kind") == kind).select(F.col("name").alias(kind), F.col("capability").alias(f"__{kind}"))
    rows = sources.join(of("fetcher"), "fetcher", "left").join(of("sink"), "sink", "left")
    missing = F.when(F.col("__fetcher").isNull(), F.concat(F.lit("no fetcher "), F.col("fetcher"))).when(F.col("__sink").isNull(), F.concat(F.lit("no sink "), F.col("sink")))
    needs = F.when(missing.isNull(), F.array_sort(F.array_distinct(F.array("__fetcher", "__sink"))))
    return rows.withColumn("error", missing).withColumn("capabilities", needs).select(*sources.columns, "capabilities", "error")


def window_of(records: DataFrame, start: dt.datetime | None, end: dt.datetime | None) -> DataFrame:
    """The records published from start on and before end; those without a time stay."""
    time, given = F.col("published_at"), lambda t: F.lit(t).cast("timestamp")
    inside = (F.lit(True) if start is None else time >= given(start)) & (F.lit(True) if end is None else time < given(end))
    return records.where(time.isNull() | inside)


def read_source(spark: SparkSession, fetcher: str, config: Mapping[str, object], start: dt.datetime | None = None, end: dt.datetime | None = None) -> DataFrame:
    """A source's records, cut to the window of a backfill if one is given. The configuration goes to the data source as options, as JSON."""
    options = {k: v if isinstance(v, str) else json.dumps(v) for k, v in config.items()}
    return window_of(spark.read.format(fetcher).options(**options).load(), start, end)


def run_source(spark: SparkSession, fetcher: str, config: Mapping[str, object], sink: Callable[[DataFrame, str], DataFrame], source_id: str, **window: dt.datetime | None) -> DataFrame:
    """Reads a source and hands its records on; what the sink tells of them."""
    return sink(read_source(spark, fetcher, config, **window), source_id)


class Day(InputPartition):
    def __init__(self, days: int):
        super().__init__(days)


class Daily(DataSource):
    """An example: a record for each day from `first` to `last`, with the configured `text` and `tags`; a month is a task."""

    @classmethod
    def name(cls) -> str:
        return "example.daily"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema: object) -> DataSourceReader:
        missing = [k for k in ("text", "first", "last") if not self.options.get(k)]
        if missing:
            raise bad(f"{self.name()}: {', '.join(missing)} missing")
        return DailyReader(dict(self.options))


class DailyReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.text, self.tags = options["text"], json.loads(options.get("tags", "[]"))
        self.first, self.last = (dt.date.fromisoformat(options[k]) for k in ("first", "last"))

    def partitions(self) -> list[Day]:
        return [Day(n) for n in range(0, max((self.last - self.first).days + 1, 0), 31)] or [Day(0)]

    def read(self, partition: Day) -> Iterator[tuple]:
        for n in range(partition.value, partition.value + 31):
            day = self.first + dt.timedelta(days=n)
            if day <= self.last:
                yield day.isoformat(), self.text, self.tags, dt.datetime.combine(day, dt.time(), dt.timezone.utc)
