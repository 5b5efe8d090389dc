"""Stored responses, page after page, as a data source for batches and streams.

`spark.read.format("stored_pages")` reads all pages of a folder of parquet files
(option `path`), `spark.readStream` those whose number (option `page`, a column
of whole numbers) it hasn't seen. An offset is the next page's number and the
validator of the folder it was found in: while that is the same, nothing is read,
not even the files' footers. Spark logs offsets before a batch and commits them
after the sink has written, so a batch that was stopped between the two runs
again over the same pages; the place up to which sinks have written is then kept
for others to read (option `state`).

New pages have higher numbers than those before them; files may be added, not
changed. Files are opened with `pyarrow.fs`, so the path's scheme must be one
that it reads.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from feedloom.failures import bad

#: Numbers of pages that one task reads.
PAGES = 5000


class Pages(InputPartition):
    """The pages with numbers from first on and before end."""

    def __init__(self, first: int, end: int):
        super().__init__((first, end))
        self.first, self.end = first, end


class Folder:
    """Parquet files of pages and where their numbers stand."""

    def __init__(self, options: dict[str, str]):
        missing = [k for k in ("path", "page") if not options.get(k)]
        if missing:
            raise bad(f"stored_pages: {', '.join(missing)} missing")
        self.path, self.page, self.step = options["path"], options["page"], max(1, int(options.get("pages_per_task", PAGES)))

    def files(self) -> tuple[pafs.FileSystem, list[pafs.FileInfo]]:
        system, path = pafs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("/") else (pafs.LocalFileSystem(), self.path)
        if system.get_file_info(path).type == pafs.FileType.File:
            return system, [system.get_file_info(path)]
        found = system.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True))
        return system, sorted((f for f in found if f.type == pafs.FileType.File and f.base_name.endswith(".parquet") and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)

    def dataset(self) -> pads.Dataset:
        system, files = self.files()
        return pads.dataset([f.path for f in files], filesystem=system, format="parquet")

    def validator(self) -> str:
        """Another one if files come or change."""
        _, files = self.files()
        return hashlib.sha256("\n".join(f"{f.path}:{f.size}:{f.mtime_ns}" for f in files).encode()).hexdigest()[:16]

    def range(self) -> tuple[int, int]:
        """The least number and the one after the greatest, from the files' footers; (0, 0) without pages."""
        system, files = self.files()
        low, high = [], []
        for file in files:
            with system.open_input_file(file.path) as stream:
                meta = pq.ParquetFile(stream).metadata
            at = meta.schema.to_arrow_schema().get_field_index(self.page)
            for group in (meta.row_group(i) for i in range(meta.num_row_groups)):
                stats = group.column(at).statistics
                if group.num_rows and (stats is None or not stats.has_min_max):
                    raise bad(f"{file.path}: no statistics of {self.page}")
                if group.num_rows:
                    low.append(stats.min)
                    high.append(stats.max)
        return (min(low), max(high) + 1) if low else (0, 0)

    def dealt(self, first: int, end: int) -> list[Pages]:
        return [Pages(n, min(n + self.step, end)) for n in range(first, end, self.step)]

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        page = pads.field(self.page)
        yield from self.dataset().to_batches(filter=(page >= partition.first) & (page < partition.end), batch_size=1000)


class StoredPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stored_pages"

    def schema(self) -> StructType:
        return from_arrow_schema(Folder(dict(self.options)).dataset().schema)

    def reader(self, schema: StructType) -> DataSourceReader:
        return BatchPages(dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return StreamPages(dict(self.options))


class BatchPages(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = Folder(options)

    def partitions(self) -> list[Pages]:
        return self.folder.dealt(*self.folder.range()) or [Pages(0, 0)]

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        if partition.end > partition.first:
            yield from self.folder.read(partition)


class StreamPages(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.state = Folder(options), options.get("state")
        self.last: dict[str, object] = {}

    def initialOffset(self) -> dict[str, object]:
        low, _ = self.folder.range()
        return {"page": low, "validator": ""}

    def latestOffset(self) -> dict[str, object]:
        validator = self.folder.validator()
        if self.last.get("validator") != validator:
            self.last = {"page": self.folder.range()[1], "validator": validator}
        return self.last

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        return self.folder.dealt(int(start["page"]), int(end["page"]))

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        yield from self.folder.read(partition)

    def commit(self, end: dict) -> None:
        """Called once the sink has the pages before this offset."""
        if not self.state:
            return
        system, path = pafs.FileSystem.from_uri(self.state)
        system.create_dir(path, recursive=True)
        part = f"{path}/.{uuid.uuid4().hex}"
        with system.open_output_stream(part) as out:
            out.write(json.dumps(end).encode())
        system.move(part, f"{path}/offset.json")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(StoredPages)


def pages(spark: SparkSession, path: str, page: str, **options: object) -> DataFrame:
    """All stored pages."""
    register(spark)
    return spark.read.format("stored_pages").options(path=path, page=page, **options).load()


def new_pages(spark: SparkSession, path: str, page: str, **options: object) -> DataFrame:
    """A stream of the stored pages."""
    register(spark)
    return spark.readStream.format("stored_pages").options(path=path, page=page, **options).load()


def checkpoints(sources: DataFrame, stored: DataFrame) -> DataFrame:
    """source_id, checkpoint, etag and last_modified of each source; one that has none stored has an empty checkpoint, `{}`."""
    rows = sources.select("source_id").distinct().join(stored.select("source_id", "checkpoint", "etag", "last_modified"), "source_id", "left")
    return rows.withColumn("checkpoint", F.coalesce("checkpoint", F.lit("{}")))
