"""What a table of segments consists of after each batch: a manifest for each, of which the last few are kept."""

from __future__ import annotations

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: Manifests that are kept: the running batch's, its predecessor's and one more.
KEPT = 3


def placed(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


class Manifests:
    """Tables of a few rows, one for each batch number, in a folder. A batch builds on the last one below its own number and writes its own when
    all else is written, so one that runs again replaces what it had done."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def numbers(self) -> list[int]:
        """The batches whose manifests are there and whole."""
        system, path = placed(self.path)
        found = system.get_file_info(pafs.FileSelector(path, allow_not_found=True))
        done = [f.base_name for f in found if f.type == pafs.FileType.Directory and system.get_file_info(f"{f.path}/_SUCCESS").type == pafs.FileType.File]
        return sorted(int(n) for n in done)

    def read(self, below: int | None = None) -> DataFrame:
        """The last manifest, or the last one below a number; no rows if there is none."""
        numbers = [n for n in self.numbers() if below is None or n < below]
        if not numbers:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{numbers[-1]}")

    def write(self, number: int, rows: list[tuple]) -> list[tuple]:
        """Writes a batch's manifest and lets the oldest go; the rows that only these had."""
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{number}")
        numbers = [n for n in self.numbers() if n <= number]
        gone: set[tuple] = set()
        for old in numbers[:-KEPT]:
            gone |= {tuple(r) for r in self.spark.read.schema(self.schema).parquet(f"{self.path}/{old}").collect()}
        if gone:
            for kept in numbers[-KEPT:]:
                gone -= {tuple(r) for r in self.spark.read.schema(self.schema).parquet(f"{self.path}/{kept}").collect()}
        system, path = placed(self.path)
        for old in numbers[:-KEPT]:
            system.delete_dir(f"{path}/{old}")
        return sorted(gone)
