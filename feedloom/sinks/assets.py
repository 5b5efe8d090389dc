"""Asset stores: a folder of any file system that pyarrow reads (local, s3, hdfs), one file per asset."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.functions import expr
from feedloom.operators.lineage import cut


class FolderStore:
    """root/source/record/key, each a safe path segment. A file is written beside its place and then moved there, so that a
    task that runs twice leaves the same file and a lost one leaves none that is cut off. Null content is kept without a file."""

    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def store(self, assets: DataFrame) -> DataFrame:
        root = self.root
        path = F.concat_ws("/", F.lit(root), *[expr.path_segment(F.col(c)) for c in ("source_id", "external_id", "asset_key")])
        rows = assets.select("source_id", "external_id", "asset_key", path.alias("uri"), "content")

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            system = folder = None
            for batch in batches:
                sizes, sums = [], []
                for uri, content in zip(batch.column("uri").to_pylist(), batch.column("content"), strict=True):
                    raw = content.as_py()
                    sizes.append(None if raw is None else len(raw))
                    sums.append(None if raw is None else hashlib.sha256(raw).hexdigest())
                    if raw is None:
                        continue
                    if system is None:
                        system, folder = pafs.FileSystem.from_uri(root)
                    place = folder + uri[len(root) :]
                    system.create_dir(place.rpartition("/")[0], recursive=True)
                    part = f"{place}.{uuid.uuid4().hex}"
                    with system.open_output_stream(part, compression=None) as out:
                        out.write(raw)
                    system.move(part, place)
                kept = [batch.column(c) for c in ("source_id", "external_id", "asset_key", "uri")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(sizes, pa.int64()), pa.array(sums, pa.string())], names=["source_id", "external_id", "asset_key", "uri", "size_bytes", "sha256"])

        kinds = "source_id string, external_id string, asset_key string, uri string, size_bytes long, sha256 string"
        return cut(rows.mapInArrow(write, kinds)).withColumn("uri", F.when(F.col("size_bytes").isNotNull(), F.col("uri")))
