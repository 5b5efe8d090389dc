"""Token-id files: each document its own Zstandard frame under one shared dictionary, with an offset index.

A file is: ``TOKZ1\\n``, the SHA-256 of the dictionary, the frames in ascending
id order, the index (ids, null flags, offsets, frame lengths, token counts as
little-endian arrays), and a trailer of the index's place, the number of
documents and ``TOKZ1\\n``. The dictionary lies beside the files. An open
file's index (29 bytes a document) is in memory; a document is one short read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import one_task_each, open_for_read, open_for_write, partition_id, written
from .shared import hash_sample, shared_dir, table, text_batches
from .tokens import encoder
from .warc import as_dictionary, compressor, train

MAGIC = b"TOKZ1\n"
TRAILER = struct.Struct("<QQ6s")
#: The dictionary is trained on about this many documents, chosen by a hash, and on this many characters of each.
DICTIONARY_DOCUMENTS, DICTIONARY_CHARS, DICTIONARY_BYTES = 500, 20_000, 65_536
FILE_BYTES = 256_000_000
MANIFEST = "part int, seq int, path string, dictionary string, documents long, tokens long"
END_ID = 2


class TokenFileError(ValueError):
    """A token file that isn't as it must be."""


class Writer:
    """Writes one file of the format."""

    def __init__(self, folder: str, dictionary: bytes):
        self.path, self.out = open_for_write(folder, ".tokz")
        self.pack, self.size, self.tokens = compressor(dictionary), 0, 0
        self.rows: list[tuple[int, int, int, int, int]] = []
        self._put(MAGIC + hashlib.sha256(dictionary).digest())

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.size += len(raw)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self.pack.compress(ids)
        self.rows.append((doc_id or 0, doc_id is None, self.size, len(frame), len(ids) // 4))
        self.tokens += len(ids) // 4
        self._put(frame)

    def close(self) -> None:
        at, columns = self.size, list(zip(*self.rows, strict=True)) or [()] * 5
        for column, kind in zip(columns, ("<i8", "u1", "<u8", "<u4", "<u8"), strict=True):
            self._put(np.array(column, kind).tobytes())
        self._put(TRAILER.pack(at, len(self.rows), MAGIC))
        self.out.close()


class Reader:
    """Random and sequential access to one file."""

    def __init__(self, path: str, dictionary: bytes):
        self.stream = open_for_read(path)
        if self.stream.read(len(MAGIC)) != MAGIC or self.stream.read(32) != hashlib.sha256(dictionary).digest():
            raise TokenFileError(f"{path}: another format or dictionary")
        self.stream.seek(self.stream.size() - TRAILER.size)
        at, n, magic = TRAILER.unpack(self.stream.read(TRAILER.size))
        if magic != MAGIC:
            raise TokenFileError(f"{path}: cut off")
        self.stream.seek(at)
        self.ids, nulls, self.offsets, self.lengths, self.counts = (np.frombuffer(self.stream.read(n * np.dtype(kind).itemsize), kind) for kind in ("<i8", "u1", "<u8", "<u4", "<u8"))
        self.nulls = nulls.astype(bool)
        self.decoder = zstandard.ZstdDecompressor(dict_data=as_dictionary(dictionary))

    def raw(self, i: int) -> bytes:
        """The ids of the i-th document as little-endian unsigned 32-bit integers."""
        self.stream.seek(int(self.offsets[i]))
        raw = self.decoder.decompress(self.stream.read(int(self.lengths[i])))
        if len(raw) != 4 * self.counts[i]:
            raise TokenFileError(f"document {i}: {len(raw)} bytes for {self.counts[i]} ids")
        return raw

    def document(self, doc_id: int) -> np.ndarray:
        """The ids of a document, found by bisection."""
        first = int(self.nulls.sum())
        i = first + int(np.searchsorted(self.ids[first:], doc_id))
        if i >= len(self.ids) or self.ids[i] != doc_id:
            raise KeyError(doc_id)
        return np.frombuffer(self.raw(i), "<u4")


def write_tokens(docs: DataFrame, vocabulary: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> tuple[DataFrame, bytes]:
    """Encodes every text, appends end_id and writes the files in ascending id order; the manifest and the dictionary.

    A null text has the end id alone. Null ids come first; repeated ids follow
    each other in text order. An empty table gives no files.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    end = struct.pack("<I", end_id)
    sample = [r["text"] for r in hash_sample(rows, ["doc_id", "text"], DICTIONARY_DOCUMENTS).select(F.substring("text", 1, DICTIONARY_CHARS).alias("text")).collect()]
    dictionary = train([ids + end for ids in encoder(vocabulary).encode(sample)], DICTIONARY_BYTES)
    folder, digest = shared_dir(spark, "tokens"), hashlib.sha256(dictionary).hexdigest()
    system, path = pafs.FileSystem.from_uri(f"{folder}/dictionary.zdict")
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path, compression=None) as out:
        out.write(dictionary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[Writer] = []
        now: Writer | None = None
        for batch in text_batches(batches, "text"):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder(vocabulary).encode(batch.column("text").to_pylist()), strict=True):
                now = now or Writer(folder, dictionary)
                now.add(doc_id, ids + end)
                if now.size >= file_bytes:
                    now.close()
                    now = done.append(now)
        if now:
            now.close()
            done.append(now)
        kinds = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("dictionary", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64())])
        yield pa.RecordBatch.from_pylist([{"part": partition_id(), "seq": i, "path": w.path, "dictionary": digest, "documents": len(w.rows), "tokens": w.tokens} for i, w in enumerate(done)], kinds)

    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    return written(ordered, write, MANIFEST, "tokens-manifest"), dictionary


def read_tokens(manifest: DataFrame, dictionary: bytes, ids: bool = True, batch_rows: int = 2000) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, the ids as an array."""
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    placed = manifest.withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0))).select("path", "before", "documents")
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))]
    schema = pa.schema(kinds if ids else kinds[:4])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            file = Reader(row["path"], dictionary)
            if len(file.ids) != row["documents"]:
                raise TokenFileError(f"{row['path']}: {len(file.ids)} documents instead of {row['documents']}")
            starts = row["before"] + np.concatenate(([0], np.cumsum(file.counts)[:-1])).astype(np.int64)
            for a in range(0, len(file.ids), batch_rows):
                raws = [file.raw(i) for i in range(a, min(a + batch_rows, len(file.ids)))]
                here = slice(a, a + len(raws))
                columns = [pa.array(file.ids[here], mask=file.nulls[here]), pa.array(starts[here]), pa.array(file.counts[here].astype(np.int64)), pa.array([zlib.crc32(r) for r in raws], pa.int64())]
                if ids:
                    offsets = np.concatenate(([0], np.cumsum(file.counts[here]))).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raws), "<u4").astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return one_task_each(placed).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest, dictionary = write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(manifest, dictionary, ids=False)


QUERIES = {"op6_token_files": op6_token_files}
