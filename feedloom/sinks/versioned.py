"""The built-in sink: records go through the versioned upsert into a folder, and come back as outcomes and how many had each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions import expr
from feedloom.streaming import upsert_stream

#: The sink's plugin, a row of `sources.registry`.
PLUGIN = ("sink", "versioned", "1.0.0", "1", [], "default")
RECORD = "source_id string, external_id string, kind string, url string, title string, content string, content_type string, language string, published_at timestamp, attributes string, tags array<string>, content_hash string, seq long"


class VersionedSink:
    """Writes batches of records one after the other; one writer at a time. A batch that is given the number of an earlier one replaces it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = spark.createDataFrame([], RECORD).schema
        self.write = upsert_stream.writer(self.path, self.schema)

    def prepared(self, records: DataFrame, source_id: str) -> DataFrame:
        """Records in the sink's shape: fields that are missing are null, the hash is over those that count, order is that of the rows."""
        had = records.withColumns({"content_hash": expr.record_hash([c for c in records.columns if c in expr.HASHED]), "seq": F.monotonically_increasing_id(), "source_id": F.lit(source_id)})
        return had.select(*[(F.col(f.name) if f.name in had.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema])

    def __call__(self, records: DataFrame, source_id: str, number: int | None = None) -> DataFrame:
        """source_id, outcome (added, updated or duplicate) and n of one batch of a source's records."""
        numbers = upsert_stream.manifests(self.spark, self.path).numbers()
        number = (numbers[-1] + 1 if numbers else 0) if number is None else number
        self.write(self.prepared(records, source_id), number)
        outcomes = self.spark.read.parquet(f"{self.path}/outcomes/batch={number}")
        return outcomes.groupBy(F.lit(source_id).alias("source_id"), "outcome").agg(F.count(F.lit(1)).alias("n"))

    def current(self) -> DataFrame:
        return upsert_stream.current(self.spark, self.path, self.schema)

    def versions(self) -> DataFrame:
        return upsert_stream.versions(self.spark, self.path, self.schema)
