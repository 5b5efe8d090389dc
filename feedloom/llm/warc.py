"""WARC archives, one Zstandard frame per record, the dictionary in a leading skippable frame.

A file is: a skippable frame (magic 0x184D2A5D) that holds the dictionary,
then one frame per record. The reader takes the dictionary from that frame,
decodes record by record in bounded memory and checks version, headers,
lengths and digests; what doesn't hold raises ``WarcError``.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator, Sequence
from typing import Any, BinaryIO, NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import one_task_each, open_for_read, open_for_write, written
from .shared import hash_sample, save, shared_dir, table, text_batches

#: The dictionary is trained on about this many pages, chosen by a hash, and on this many characters of each.
DICTIONARY_PAGES, DICTIONARY_CHARS, DICTIONARY_BYTES = 500, 20_000, 65_536
FILE_BYTES = 128_000_000
#: Up to so many bytes of repeated digests (about GROUP_BYTES each) go to all tasks.
SENT_BYTES, GROUP_BYTES = 32_000_000, 150
MAGIC = 0x184D2A5D
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, records long"


class WarcError(ValueError):
    """An archive that isn't as it must be."""


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]


def train(samples: Sequence[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A Zstandard dictionary of the samples; too few of them serve as raw content."""
    try:
        return zstandard.train_dictionary(size, list(samples)).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def as_dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def compressor(raw: bytes, level: int = 3) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level, dict_data=as_dictionary(raw), write_checksum=True, write_content_size=True)


def page_urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    block = HTTP if revisit else HTTP + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {page_urn(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {re.sub(r'[\r\n]', '%0A', url)}")
    if revisit:
        lines += [f"WARC-Refers-To: {page_urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> Record:
    head, found, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    if not found or not first.startswith("WARC/1."):
        raise WarcError(f"no WARC version: {first[:40]!r}")
    headers: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"no header: {line[:80]!r}")
        headers[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise WarcError(f"{name} is missing")
    if not headers["content-length"].isdigit() or len(rest) != (n := int(headers["content-length"])) + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"the record has {len(rest) - 4} bytes and says {headers['content-length']}")
    record = Record(headers, rest[:n])
    if headers["warc-type"] == "response":
        if headers.get("warc-payload-digest") != f"sha1:{base32_sha1(record.payload)}":
            raise WarcError("the payload's digest differs")
        if headers.get("x-payload-length", str(len(record.payload))) != str(len(record.payload)):
            raise WarcError("the payload's length differs")
    elif headers["warc-type"] == "revisit" and not {"warc-refers-to", "warc-profile"} <= headers.keys():
        raise WarcError("a revisit without what it refers to")
    return record


def read_archive(stream: BinaryIO, chunk: int = 32_768) -> Iterator[Record]:
    """The records of one file. Without a leading dictionary frame, frames are decoded without one."""
    head = stream.read(8)
    raw, data = b"", head
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == MAGIC:
        size = struct.unpack("<I", head[4:])[0]
        raw, data = stream.read(size), b""
        if len(raw) != size:
            raise WarcError("the dictionary frame is cut off")
        if raw[:4] == b"\x28\xb5\x2f\xfd":
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    decoder = zstandard.ZstdDecompressor(dict_data=as_dictionary(raw))
    while data or (data := stream.read(chunk)):
        frame, parts = decoder.decompressobj(), []
        while not frame.eof:
            if not data and not (data := stream.read(chunk)):
                raise WarcError("the last record is cut off")
            try:
                parts.append(frame.decompress(data))
            except zstandard.ZstdError as e:
                raise WarcError(f"no frame: {e}") from e
            data = frame.unused_data if frame.eof else b""
        yield parse_record(b"".join(parts))


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a record per page; the manifest (path, records).

    Of pages with equal payloads of `least` bytes or more, each row with the
    smallest id is a response and the others revisit it. A null html is the
    empty payload, a null url leaves its header out, a null id is no group's
    smallest unless all are null. An empty table gives no archives.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    sample = hash_sample(rows, ["page_id", "html"], DICTIONARY_PAGES).select(F.substring("html", 1, DICTIONARY_CHARS).alias("html")).collect()
    raw, folder = train([r["html"].encode() for r in sample]), shared_dir(spark, "warc")
    keyed = rows.withColumn("digest", F.when(F.octet_length("html") >= least, F.sha1(F.col("html").cast("binary"))))
    groups = keyed.where("digest IS NOT NULL").groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = save(groups.where("n > 1 AND first IS NOT NULL").select("digest", "first"), "payloads")
    if GROUP_BYTES * groups.count() <= SENT_BYTES:
        marked = keyed.join(F.broadcast(groups), "digest", "left")
    else:  # a payload on many pages meets its group without the html, which then moves by page
        firsts = keyed.select("page_id", "digest").join(groups, "digest").distinct().select(F.col("page_id").alias("id"), F.col("digest").alias("same"), "first")
        marked = keyed.join(firsts, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("same")), "left")
    marked = marked.select("page_id", "url", "html", "first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[str, int]] = []
        path, out, records, size, pack = "", None, 0, 0, compressor(raw)
        for batch in text_batches(batches, "html"):
            for row in batch.to_pylist():
                if out is None:
                    path, out = open_for_write(folder, ".warc.zst")
                    out.write(struct.pack("<II", MAGIC, len(raw)) + raw)
                    records = size = 0
                revisit = row["first"] is not None and row["page_id"] != row["first"]
                frame = pack.compress(record_bytes(row["page_id"], row["url"], row["html"].encode(), row["first"], revisit))
                out.write(frame)
                records, size = records + 1, size + len(frame)
                if size >= file_bytes:
                    out.close()
                    done, out = [*done, (path, records)], None
        if out is not None:
            out.close()
            done.append((path, records))
        yield pa.RecordBatch.from_pydict({"path": [p for p, _ in done], "records": [n for _, n in done]}, pa.schema([("path", pa.string()), ("records", pa.int64())]))

    return written(marked, write, MANIFEST, "warc-manifest")


RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def _row(record: Record, payload: bool) -> dict[str, Any]:
    number = lambda urn: None if urn is None or urn.endswith(":null>") else int(urn.rpartition(":")[2].rstrip(">"))
    h = record.headers
    return {
        "page_id": number(h["warc-record-id"]), "url": h.get("warc-target-uri"), "record_type": h["warc-type"], "refers_to": number(h.get("warc-refers-to")),
        "payload_bytes": int(h["x-payload-length"]), "payload_digest": h["warc-payload-digest"].removeprefix("sha1:"), "payload": record.payload if payload and h["warc-type"] == "response" else None,
    }


def read_archives(manifest: DataFrame, payload: bool = True, batch_bytes: int = 8_000_000) -> DataFrame:
    """A row per record: page_id, url, record_type, refers_to, payload_bytes, payload_digest and, if asked for, the payload of responses.
    A file with fewer or more records than its manifest row says raises ``WarcError``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, records in ((p, n) for b in batches for p, n in zip(b.column("path").to_pylist(), b.column("records").to_pylist(), strict=True)):
            rows, held, seen = [], 0, 0
            with open_for_read(path) as stream:
                for record in read_archive(stream):
                    rows.append(_row(record, payload))
                    held, seen = held + len(record.block) * payload + 200, seen + 1
                    if held >= batch_bytes:
                        yield pa.RecordBatch.from_pylist(rows, RECORD)
                        rows, held = [], 0
            if seen != records:
                raise WarcError(f"{path}: {seen} records instead of {records}")
            if rows:
                yield pa.RecordBatch.from_pylist(rows, RECORD)

    return one_task_each(manifest).mapInArrow(read, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def op4_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "pages"))
    return read_archives(manifest, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op4_warc_zstd": op4_warc_zstd}
