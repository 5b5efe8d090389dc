"""Which keys were ever seen: an index in files that answers for a batch without reading all keys.

Keys stand in buckets by their hash. What a batch adds to a bucket is a segment:
its keys, and a Bloom filter of them. Whether a key was seen is asked of the
filters of its bucket; only where one says maybe, that segment's keys are read,
so the answer is exact. Segments of one level are merged into one of the next
when FAN of them have come together: a bucket has a few for each power of FAN of
batches, however long the index grows.

A batch has a number. It builds on the manifest of the last number below its own
and writes its own manifest at the end, so one that runs again, wherever it was
stopped, replaces what it had written and counts nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from feedloom.failures import bad
from feedloom.operators.manifests import Manifests, placed

#: Buckets, segments of a level that are merged, bits of a filter for each key and how many of them a key sets.
BUCKETS, FAN, BITS, HASHES = 64, 4, 12, 6
MANIFEST = "bucket int, segment string, level int, keys long"


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits, of a power of two of them, that each key sets."""
    wide = hashes.astype(np.uint64)
    step = (wide * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(7)) | np.uint64(1)
    return ((wide[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) & np.uint64(bits - 1)).astype(np.int64)


def filter_of(hashes: np.ndarray, bits_per_key: int) -> bytes:
    bits = 64
    while bits < bits_per_key * len(hashes):
        bits *= 2
    flags = np.zeros(bits, bool)
    flags[positions(hashes, bits).ravel()] = True
    return np.packbits(flags).tobytes()


def may_hold(raw: bytes, hashes: np.ndarray) -> np.ndarray:
    flags = np.unpackbits(np.frombuffer(raw, np.uint8)).view(bool)
    return flags[positions(hashes, len(flags))].all(1)


class SeenKeys:
    """The index in a folder. Keys are strings; null is no key."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, fan: int = FAN, bits: int = BITS):
        self.spark, self.path, self.buckets, self.fan, self.bits = spark, path.rstrip("/"), buckets, fan, bits
        self.manifests = Manifests(spark, f"{self.path}/manifest", MANIFEST)
        if buckets < 1 or fan < 2 or bits < 1:
            raise bad("an index of keys has one bucket, merges two segments and takes one bit a key at least")

    def placed(self, keys: DataFrame) -> DataFrame:
        """hash and bucket of each key."""
        return keys.withColumn("hash", F.xxhash64("key")).withColumn("bucket", F.pmod(F.xxhash64(F.lit(1), "key"), F.lit(self.buckets)).cast("int"))

    def manifest(self, below: int | None = None) -> DataFrame:
        """The segments: bucket, segment, level and keys; a few rows for each bucket."""
        return self.manifests.read(below)

    def of(self, kind: str, places: list[tuple[int, str]], schema: str) -> DataFrame:
        """The keys or filters of some buckets' segments."""
        if not places:
            return self.spark.createDataFrame([], f"{schema}, bucket int, segment string")
        paths = [f"{self.path}/{kind}/segment={s}/bucket={b}" for b, s in places]
        rows = self.spark.read.schema(f"{schema}, segment string, bucket int").option("basePath", f"{self.path}/{kind}").parquet(*paths)
        return rows.select(*[c.split()[0] for c in schema.split(", ")], "bucket", "segment")

    def maybe(self, keys: DataFrame, places: list[tuple[int, str]]) -> DataFrame:
        """key, bucket and segment wherever a filter lets a key through."""
        schema = pa.schema([("key", pa.string()), ("bucket", pa.int32()), ("segment", pa.string())])

        def ask(asked: pa.Table, filters: pa.Table) -> pa.Table:
            hashes, out = asked.column("hash").to_numpy(), []
            for segment, raw in zip(filters.column("segment").to_pylist(), filters.column("bits").to_pylist(), strict=True):
                found = asked.column("key").filter(pa.array(may_hold(raw, hashes))).combine_chunks()
                out.append(pa.table({"key": found, "bucket": pa.array([asked.column("bucket")[0].as_py()] * len(found), pa.int32()), "segment": pa.array([segment] * len(found), pa.string())}, schema=schema))
            return pa.concat_tables(out) if out and asked.num_rows else schema.empty_table()

        filters = self.of("filters", places, "bits binary")
        return keys.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(ask, "key string, bucket int, segment string")

    def unseen(self, keys: DataFrame, number: int | None = None) -> DataFrame:
        """The distinct keys (key, hash, bucket) that no batch below this number has added. keys: a column `key`."""
        asked = self.placed(keys.select("key").where("key IS NOT NULL").distinct()).persist()
        try:
            touched = {r["bucket"] for r in asked.select("bucket").distinct().collect()}  # at most one row for each bucket
            places = [(r["bucket"], r["segment"]) for r in self.manifest(number).collect() if r["bucket"] in touched]
            through = self.maybe(asked, places).persist()
            try:
                opened = sorted((r["bucket"], r["segment"]) for r in through.select("bucket", "segment").distinct().collect())
                held = through.join(self.of("keys", opened, "key string"), ["key", "bucket", "segment"], "left_semi").select("key").distinct()
                new = asked.join(held, "key", "left_anti")
                return stored(new, f"{self.path}/asked/{number if number is not None else 'once'}")
            finally:
                through.unpersist()
        finally:
            asked.unpersist()

    def write_segment(self, keys: DataFrame, name: str) -> dict[int, int]:
        """Writes keys (key, hash, bucket) and filters of a segment; how many keys each bucket has."""
        keys.select("key", "hash", "bucket").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/keys/segment={name}")
        bits = self.bits
        schema = pa.schema([("bucket", pa.int32()), ("bits", pa.binary()), ("n", pa.int64())])

        def build(rows: pa.Table) -> pa.Table:
            hashes = rows.column("hash").to_numpy()
            return pa.table({"bucket": rows.column("bucket").slice(0, 1), "bits": pa.array([filter_of(hashes, bits)], pa.binary()), "n": pa.array([len(hashes)], pa.int64())}, schema=schema)

        back = self.spark.read.schema("key string, hash long, bucket int").parquet(f"{self.path}/keys/segment={name}")
        filters = back.groupBy("bucket").applyInArrow(build, "bucket int, bits binary, n long").persist()
        try:
            filters.select("bits", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/filters/segment={name}")
            return {r["bucket"]: r["n"] for r in filters.select("bucket", "n").collect()}
        finally:
            filters.unpersist()

    def add(self, keys: DataFrame, number: int) -> None:
        """Adds the distinct, unseen keys (key, hash, bucket) of a batch and merges the segments that are due."""
        rows = [(r["bucket"], r["segment"], r["level"], r["keys"]) for r in self.manifest(number).collect()]
        if not keys.isEmpty():
            rows += [(b, f"{number}", 0, n) for b, n in self.write_segment(keys, f"{number}").items()]
        made = set(rows)
        level = 0
        while True:
            due = {b: own for b in {r[0] for r in rows} if len(own := [r for r in rows if r[0] == b and r[2] == level]) >= self.fan}
            if due:
                name = f"{number}-{level + 1}"
                merged = self.placed(self.of("keys", sorted((r[0], r[1]) for own in due.values() for r in own), "key string").select("key"))
                gone = {r for own in due.values() for r in own}
                rows = [r for r in rows if r not in gone] + [(b, name, level + 1, n) for b, n in self.write_segment(merged, name).items()]
                made |= set(rows)
            level += 1
            if level > max((r[2] for r in rows), default=0):
                break
        passed = {r for r in made - set(rows) if r[1].split("-")[0] == f"{number}"}  # made and merged by this batch
        for bucket, segment, _, _ in [*self.manifests.write(number, rows), *passed]:
            for kind in ("keys", "filters"):
                system, path = placed(f"{self.path}/{kind}/segment={segment}/bucket={bucket}")
                if system.get_file_info(path).type == pafs.FileType.Directory:
                    system.delete_dir(path)


def stored(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def first_of_keys(rows: DataFrame, key: str) -> DataFrame:
    """One row for each key, the least of them, whatever their order."""
    return rows.groupBy(key).agg(F.min(F.struct(*[c for c in rows.columns if c != key])).alias("__row")).select(key, "__row.*").select(*rows.columns) if len(rows.columns) > 1 else rows.distinct()


def registering(requests: DataFrame, index: SeenKeys, hand_on: Callable[[DataFrame, int], None], checkpoint: str, key: str = "dedupe_key") -> StreamingQuery:
    """Hands on each micro-batch's requests, one for each key, whose key was never seen before, with the batch's number: a batch may be handed on
    again, with the same rows, if it was stopped before it was done."""

    def batch(rows: DataFrame, number: int) -> None:
        new = index.unseen(rows.select(F.col(key).alias("key")), number)
        hand_on(first_of_keys(rows.join(new.select(F.col("key").alias(key)), key, "left_semi"), key), number)
        index.add(new, number)

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
