"""What the operators of this subpackage share: tables, the shared folder, text batches and distributed ranks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder that the driver and all executors see.

    The cluster names the place in ``spark.checkpoint.dir``. Only a local
    master may do without; it then gets a temporary folder.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage is cut and lost executors cost no recomputation."""
    return stored(df, shared_dir(df.sparkSession, name))


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A `save` whose tables are removed at the end; what is to outlast it must be saved elsewhere before."""
    folder = shared_dir(spark, name)
    try:
        yield lambda df, step: stored(df, f"{folder}/{step}-{uuid.uuid4().hex}")
    finally:
        system, path = pafs.FileSystem.from_uri(folder)
        if system.get_file_info(path).type == pafs.FileType.Directory:
            system.delete_dir(path)


Keep = Callable[[DataFrame, str], DataFrame]


def text_batches(batches: Iterator[pa.RecordBatch], text: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Splits Arrow batches so that each holds about `most` bytes of text (or one row): bounds a task's arrays."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i in range(n):
            if held and held + lengths[i] > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(lengths[i])
        yield batch.slice(start, n - start)


def hash_sample(rows: DataFrame, columns: Sequence[str], most: int) -> DataFrame:
    """About `most` rows, the same ones in each run: those whose columns' hash is small. Of rows that repeat so often that one hash
    would exceed it, no more than twice `most` are taken."""
    share = most / max(rows.count(), most)
    return rows.where(F.pmod(F.xxhash64(*columns), F.lit(1_000_000)) < share * 1_000_000).limit(2 * most)


def with_rank(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str, ordered: bool = True, then: Callable[[DataFrame], DataFrame] | None = None, keep: Callable[[DataFrame, str], DataFrame] = save) -> DataFrame:
    """Adds the rank (long, from 0) of each row among those of its group, by `order`, without a task per group.

    Rows are dealt by ranges of `order`, or where any numbers do (not ordered)
    by its hash; each part counts its rows by group, running sums of these few
    counts give where a part starts, and rows are numbered inside their part.
    A group of any size spreads over the parts. What `then` adds, which may be
    the group, is computed once, after rows are dealt.
    """
    part = "__part"
    if ordered:
        dealt = df.repartitionByRange(*order).withColumn(part, F.spark_partition_id())
    else:
        dealt = df.withColumn(part, F.pmod(F.xxhash64(*order), F.lit(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))).cast("int"))
    ranged = keep(then(dealt) if then else dealt, "ranges")
    counts = ranged.groupBy(part, *group).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    names = {c: f"__{i}" for i, c in enumerate((part, *group))}
    starts = counts.select(*[F.col(c).alias(n) for c, n in names.items()], F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    joined = ranged.join(starts, same, "left").drop(*names.values())
    here = Window.partitionBy(part, *group).orderBy(*order)
    return joined.withColumn(out, F.col("__start") + F.row_number().over(here) - 1).drop(part, "__start")
