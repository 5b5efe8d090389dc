"""Binary files in the shared folder, written by tasks and listed in a manifest.

A task may run twice. Every attempt writes files of its own names, and Spark
commits the manifest rows of one attempt only: readers follow the manifest and
never see what a lost attempt left.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .shared import save


def open_for_write(folder: str, suffix: str) -> tuple[str, pa.NativeFile]:
    """A new file's URI and its stream."""
    context = TaskContext.get()
    uri = f"{folder}/part-{context.partitionId() if context else 0:06d}-{uuid.uuid4().hex}{suffix}"
    system, path = pafs.FileSystem.from_uri(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return uri, system.open_output_stream(path, compression=None)


def open_for_read(uri: str) -> pa.NativeFile:
    system, path = pafs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def partition_id() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def written(df: DataFrame, write: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, name: str) -> DataFrame:
    """Runs the writer over df's partitions; the manifest, kept in the shared folder."""
    return save(df.mapInArrow(write, schema), name)


def one_task_each(manifest: DataFrame) -> DataFrame:
    """Deals the files out, a few to each task, however small the manifest is."""
    return manifest.repartition(max(1, min(10_000, manifest.count())))
