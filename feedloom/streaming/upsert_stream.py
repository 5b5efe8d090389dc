"""The versioned upsert as a stream: one writer, a micro-batch at a time, offsets committed after the tables.

Keys stand in buckets. A bucket's current rows are one segment, rewritten by each
batch that touches it; its versions are segments that batches add, merged by
levels when FAN of one have come together. A manifest says which segments hold
after a batch. So a batch reads one manifest and, of the buckets that its keys are
in, one segment of current rows and a few of versions, however many batches there
were; segments that no kept manifest names are deleted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from feedloom.operators import upsert
from feedloom.operators.manifests import Manifests, placed

#: The state is kept in so many buckets of keys; so many segments of versions of a level are merged.
BUCKETS, FAN = 64, 4
MANIFEST = "kind string, bucket int, segment string, level int"
Row = tuple[str, int, str, int]


def bucket_of(key: tuple[str, ...] = upsert.KEY) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int")


def located(path: str) -> str:
    return path if "://" in path else f"file://{path}"


def manifests(spark: SparkSession, path: str) -> Manifests:
    return Manifests(spark, f"{located(path)}/manifest", MANIFEST)


def of_segments(spark: SparkSession, path: str, schema: StructType, rows: Iterable[Row]) -> DataFrame:
    paths = [f"{path}/{kind}/batch={segment}/bucket={bucket}" for kind, bucket, segment, _ in rows]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def held(spark: SparkSession, path: str, schema: StructType, kind: str) -> DataFrame:
    return of_segments(spark, path, schema, [tuple(r) for r in manifests(spark, path).read().collect() if r["kind"] == kind])


def current(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The state after the last finished batch."""
    return held(spark, path, schema, "current")


def versions(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The first arrival of each key and hash, after the last finished batch."""
    return held(spark, path, schema, "versions")


def upsert_stream(arrivals: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Runs over what is there. arrivals: source_id, external_id, content_hash, seq and more.

    Each batch writes its outcomes, the new versions and the current rows of the buckets that it touches under its own
    number, and its manifest last. It builds on the batches below its own number, so one that runs again, wherever it was
    stopped, replaces what it had written and counts nothing twice.
    """
    return arrivals.writeStream.foreachBatch(writer(path, arrivals.schema)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def writer(path: str, schema: StructType) -> Callable[[DataFrame, int], None]:
    """What is done with a batch and its number."""

    def save(rows: DataFrame, kind: str, segment: str) -> list[int]:
        """Writes a segment; the buckets that it has rows of."""
        rows = rows.withColumn("bucket", bucket_of())
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{kind}/batch={segment}")
        system, place = placed(f"{located(path)}/{kind}/batch={segment}")
        return sorted(int(f.base_name.partition("=")[2]) for f in system.get_file_info(pafs.FileSelector(place)) if f.type == pafs.FileType.Directory)

    def merged(spark: SparkSession, rows: list[Row], number: int) -> tuple[list[Row], list[Row]]:
        """The rows once no bucket has FAN segments of versions of one level; and those that this batch itself made and merged."""
        level, passed = 0, []
        while level <= max((r[3] for r in rows), default=0):
            own = [r for r in rows if r[0] == "versions" and r[3] == level]
            full = {b for b in {r[1] for r in own} if sum(r[1] == b for r in own) >= FAN}
            due = [r for r in own if r[1] in full]
            if due:
                name = f"{number}-{level + 1}"
                buckets = save(of_segments(spark, path, schema, due), "versions", name)
                rows = [r for r in rows if r not in due] + [("versions", b, name, level + 1) for b in buckets]
                passed += [r for r in due if r[2].split("-")[0] == str(number)]
            level += 1
        return rows, passed

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            touched = {r["bucket"] for r in batch.select(bucket_of().alias("bucket")).distinct().collect()}  # one row for each bucket at most
            before: list[Row] = [tuple(r) for r in manifests(spark, path).read(number).collect()]
            mine = [r for r in before if r[1] in touched]
            stored = of_segments(spark, path, schema, [r for r in mine if r[0] == "current"])
            known = of_segments(spark, path, schema, [r for r in mine if r[0] == "versions"])
            upsert.outcomes(batch, stored).write.mode("overwrite").parquet(f"{path}/outcomes/batch={number}")
            added = save(upsert.version_history(batch, known).select(*batch.columns), "versions", str(number))
            last = upsert.current_state(batch).select(*batch.columns)
            changed = save(last.unionByName(stored.join(last, list(upsert.KEY), "left_anti").select(*batch.columns)), "current", str(number))
            rows = [r for r in before if r[0] != "current" or r[1] not in touched]
            rows += [("current", b, str(number), 0) for b in changed] + [("versions", b, str(number), 0) for b in added]
            left, passed = merged(spark, rows, number)
            for kind, bucket, segment, _ in [*manifests(spark, path).write(number, left), *passed]:
                system, place = placed(f"{located(path)}/{kind}/batch={segment}/bucket={bucket}")
                if system.get_file_info(place).type == pafs.FileType.Directory:
                    system.delete_dir(place)
        finally:
            batch.unpersist()

    return write
