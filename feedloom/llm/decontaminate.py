"""Benchmark decontamination with a stored positional inverted index that is distributed by documents.

The index is a set of files. A file is a row of segments, each the postings of
a few MB of texts: the documents' keys and where their words begin, the sorted
term hashes, how many postings each term has, and all positions, delta-coded
list by list. Benchmark windows are looked up in the index, not in the texts:
of each window the rarest term's list (by its count over all documents) is
taken first, less the term's offset, and intersected with the other terms'
offset-adjusted lists from rare to common until exact phrases are left. Places
of the rarest term that aren't part of a phrase but have the next rare terms
close by are proximity matches. Documents are never shuffled: the benchmark
goes to the segments, in blocks of a bounded size.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import one_task_each, open_for_read, open_for_write, written
from .shared import save, shared_dir, table, text_batches
from .words import ALNUM, words_of

WINDOW = 10
#: Rare terms that must stand within SLOP words of the rarest for a proximity match.
RARE, SLOP = 3, 20
#: A block of the benchmark: what is sent to the segments at once.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 4_000_000
FILE_BYTES = 128_000_000
#: A segment: this mark, documents, words, terms, and the bytes of each section.
MARK, HEAD, SECTIONS = b"PIDX1\n", struct.Struct("<6sQQQ5Q"), 5
MANIFEST = "path string, segments long"
PLACE = np.uint64(32)


class PostingsError(ValueError):
    """An index file that isn't as it must be."""


@dataclass
class Segment:
    """Postings of some documents. A posting is term << 32 | position in `postings`, which is sorted; positions count the words of all documents."""

    keys: np.ndarray  # documents x (doc_id, is null, two text hashes)
    bounds: np.ndarray  # words of document i: bounds[i] to bounds[i + 1]
    terms: np.ndarray
    counts: np.ndarray
    postings: np.ndarray

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Each hash's term number, -1 if no document has it."""
        if not len(self.terms):
            return np.full(hashes.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def holds(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Whether each term has a posting at that position."""
        wanted = (term.astype(np.uint64) << PLACE) | position.astype(np.uint64)
        at = np.searchsorted(self.postings, wanted)
        return self.postings[np.minimum(at, len(self.postings) - 1)] == wanted

    def close(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether each term has a posting from `low` to before `high`."""
        base = term.astype(np.uint64) << PLACE
        at = np.searchsorted(self.postings, base | low.astype(np.uint64))
        return (at < len(self.postings)) & (self.postings[np.minimum(at, len(self.postings) - 1)] < (base | high.astype(np.uint64)))


def inverted(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted terms, their counts and the positions, list by list."""
    place = np.arange(len(hashes), dtype=np.uint64)
    if len(hashes) < 1 << 24:  # the hash's high bits and the place in one number sort much faster
        mixed = np.sort((hashes & ~np.uint64(0xFFFFFF)) | place)
        place = mixed & np.uint64(0xFFFFFF)
    ordered = hashes[place.astype(np.int64)]
    if len(hashes) >= 1 << 24 or (ordered[1:] < ordered[:-1]).any() or (np.diff(ordered >> np.uint64(24)) == 0)[ordered[1:] != ordered[:-1]].any():
        place = np.argsort(hashes, kind="stable").astype(np.uint64)
        ordered = hashes[place.astype(np.int64)]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
    return ordered[first], np.diff(np.append(first, len(ordered))).astype(np.uint32), place.astype(np.int64)


def segment_bytes(keys: np.ndarray, bounds: np.ndarray, hashes: np.ndarray, pack: zstandard.ZstdCompressor) -> bytes:
    terms, counts, places = inverted(hashes)
    steps = np.diff(places, prepend=0)
    starts = np.cumsum(counts) - counts
    steps[starts] = places[starts]  # a list begins with a position, steps follow
    sections = [pack.compress(x.tobytes()) for x in (keys.astype("<i8"), bounds.astype("<u4"), terms.astype("<u8"), counts.astype("<u4"), steps.astype("<u4"))]
    return HEAD.pack(MARK, len(keys), len(hashes), len(terms), *map(len, sections)) + b"".join(sections)


def segments(stream: Any, postings: bool = True) -> Iterator[Segment]:
    """The segments of one file; without `postings` the positions are skipped."""
    unpack = zstandard.ZstdDecompressor()
    while head := stream.read(HEAD.size):
        if len(head) != HEAD.size or head[: len(MARK)] != MARK:
            raise PostingsError("no segment")
        _, documents, words, terms, *sizes = HEAD.unpack(head)
        raws = [stream.read(n) for n in sizes[:-1]]
        keys, bounds, names, counts = (np.frombuffer(unpack.decompress(r), kind) for r, kind in zip(raws, ("<i8", "<u4", "<u8", "<u4"), strict=True))
        found = np.zeros(0, np.uint64)
        if postings:
            steps = np.frombuffer(unpack.decompress(stream.read(sizes[-1])), "<u4").astype(np.int64)
            if len(steps) != words or len(names) != terms:
                raise PostingsError("a segment without all its postings")
            sums = np.cumsum(steps)
            starts = np.cumsum(counts, dtype=np.int64) - counts
            places = sums - np.repeat(sums[starts] - steps[starts], counts)
            found = (np.repeat(np.arange(terms, dtype=np.uint64), counts) << PLACE) | places.astype(np.uint64)
        else:
            stream.seek(sizes[-1], 1)
        yield Segment(keys.reshape(documents, 4), bounds.astype(np.int64), names, counts.astype(np.int64), found)


def text_keys(text: Column) -> list[Column]:
    """128 bits that name a text."""
    return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the index of all documents; the manifest (path, segments). A null text has no words but is a document."""
    folder = shared_dir(docs.sparkSession, "index")
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *[k.alias(f"key{i}") for i, k in enumerate(text_keys(text))])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1, write_content_size=True)
        done: list[tuple[str, int]] = []
        path, out, n, size = "", None, 0, 0
        for batch in text_batches(batches, "text"):
            words = words_of(batch.column("text").to_pylist(), ALNUM)
            ids = batch.column("doc_id")
            keys = np.stack([ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64), batch.column("key0").to_numpy(), batch.column("key1").to_numpy()], axis=1)
            if out is None:
                path, out = open_for_write(folder, ".pidx")
                n = size = 0
            raw = segment_bytes(keys, words.bounds, words.hashes, pack)
            out.write(raw)
            n, size = n + 1, size + len(raw)
            if size >= file_bytes:
                out.close()
                done, out = [*done, (path, n)], None
        if out is not None:
            out.close()
            done.append((path, n))
        yield pa.RecordBatch.from_pydict({"path": [p for p, _ in done], "segments": [k for _, k in done]}, pa.schema([("path", pa.string()), ("segments", pa.int64())]))

    return written(rows, write, MANIFEST, "index-manifest")


def each_segment(batches: Iterator[pa.RecordBatch], postings: bool = True) -> Iterator[tuple[str, int, Segment]]:
    for path, n in ((p, k) for b in batches for p, k in zip(b.column("path").to_pylist(), b.column("segments").to_pylist(), strict=True)):
        seen = 0
        with open_for_read(path) as stream:
            for segment in segments(stream, postings):
                yield path, seen, segment
                seen += 1
        if seen != n:
            raise PostingsError(f"{path}: {seen} segments instead of {n}")


@dataclass
class Block:
    """The distinct windows of some items: terms in text order (rows padded with zeros), and how the terms rank from rare to common."""

    items: list[str]
    terms: np.ndarray  # windows x WINDOW
    sizes: np.ndarray
    first: np.ndarray  # items of window i: owners[first[i]:first[i + 1]]
    owners: np.ndarray
    order: np.ndarray | None = None  # windows x WINDOW: offsets from rare to common

    def inside(self) -> np.ndarray:
        return np.arange(WINDOW) < self.sizes[:, None]

    @property
    def vocabulary(self) -> np.ndarray:
        return np.unique(self.terms[self.inside()])

    def rank(self, vocabulary: np.ndarray, counts: np.ndarray) -> None:
        n = counts[np.minimum(np.searchsorted(vocabulary, self.terms), max(len(vocabulary) - 1, 0))] if len(vocabulary) else np.zeros_like(self.terms, np.int64)
        self.order = np.argsort(np.where(self.inside(), n, np.iinfo(np.int64).max), axis=1, kind="stable").astype(np.int8)


def windows_of(ids: Sequence[Any], texts: Sequence[str | None]) -> Block:
    """Ten words in a row each; an item of fewer, but not none, is one window. Equal windows are one, with all their items."""
    words = words_of(texts, ALNUM)
    owner, terms, sizes = [np.zeros(0, np.int64)], [np.zeros((0, WINDOW), np.uint64)], [np.zeros(0, np.int64)]
    for i in range(len(texts)):
        own = words.hashes[words.bounds[i] : words.bounds[i + 1]]
        if len(own):
            width = min(WINDOW, len(own))
            found = np.lib.stride_tricks.sliding_window_view(own, width)
            terms.append(np.pad(found, ((0, 0), (0, WINDOW - width))))
            sizes.append(np.full(len(found), width))
            owner.append(np.full(len(found), i))
    every = pd.DataFrame(np.hstack([np.concatenate(terms), np.concatenate(sizes)[:, None].astype(np.uint64)]))
    window = every.groupby(list(every.columns), sort=False).ngroup().to_numpy() if len(every) else np.zeros(0, np.int64)
    one = every.drop_duplicates().to_numpy(np.uint64).reshape(-1, WINDOW + 1)
    pairs = pd.DataFrame({"window": window, "owner": np.concatenate(owner)}).drop_duplicates().sort_values("window", kind="stable")
    first = np.searchsorted(pairs["window"].to_numpy(), np.arange(len(one) + 1))
    return Block(["null" if x is None else str(x) for x in ids], one[:, :WINDOW], one[:, WINDOW].astype(np.int64), first, pairs["owner"].to_numpy())


def blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Block]:
    """The benchmark's items, a bounded number at a time; the driver holds one block."""
    ids: list[Any] = []
    texts: list[str | None] = []
    held, sent = 0, False
    for row in benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        ids.append(row["i"])
        texts.append(row["t"])
        held += len(row["t"] or "")
        if len(ids) >= BLOCK_ITEMS or held >= BLOCK_CHARS:
            yield windows_of(ids, texts)
            ids, texts, held, sent = [], [], 0, True
    if ids or not sent:
        yield windows_of(ids, texts)


def term_counts(index: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """How often each term occurs in all documents."""
    sent = index.sparkSession.sparkContext.broadcast(vocabulary)
    schema = pa.schema([("term", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        total = np.zeros(len(known), np.int64)
        for _, _, segment in each_segment(batches, postings=False):
            at = segment.numbers(known)
            total += np.where(at >= 0, segment.counts[at] if len(segment.counts) else 0, 0)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], schema=schema)

    counts = np.zeros(len(vocabulary), np.int64)
    if len(vocabulary):
        found = one_task_each(index).mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
        for row in found.collect():  # at most a row for each term of the block
            counts[row["term"]] = row["n"]
    return counts


def matches(segment: Segment, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(window, start) of the exact phrases and (window, position of its rarest term) of the proximity matches."""
    ranked = np.take_along_axis(block.terms, block.order.astype(np.int64), axis=1)  # rare to common, zeros last
    number = segment.numbers(ranked)
    need = np.minimum(block.sizes, RARE)
    use = np.flatnonzero(((number >= 0) | (np.arange(WINDOW) >= need[:, None])).all(1) & (block.sizes > 0))
    anchor = number[use, 0]
    first = np.append(0, np.cumsum(segment.counts))
    each = segment.counts[anchor] if len(use) else np.zeros(0, np.int64)
    inner = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
    window = np.repeat(use, each)
    posting = segment.postings[np.repeat(first[anchor], each) + inner] if len(window) else np.zeros(0, np.uint64)
    position = (posting & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = position - block.order[window, 0]
    text = np.searchsorted(segment.bounds, position, side="right") - 1
    low, high = segment.bounds[text], segment.bounds[text + 1]
    alive = (start >= low) & (start + block.sizes[window] <= high)
    for place in range(1, WINDOW):
        at = np.flatnonzero(alive & (place < block.sizes[window]))
        term = number[window[at], place]
        alive[at] = (term >= 0) & segment.holds(np.maximum(term, 0), start[at] + block.order[window[at], place])
    near = ~alive & (block.sizes[window] >= WINDOW)
    for place in range(1, RARE):
        at = np.flatnonzero(near)
        near[at] = segment.close(number[window[at], place], np.maximum(position[at] - SLOP, low[at]), np.minimum(position[at] + SLOP + 1, high[at]))
    return window[alive], start[alive], window[near], position[near]


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
FOUND = pa.schema([
    ("path", pa.string()), ("segment", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("key0", pa.int64()), ("key1", pa.int64()), ("n_words", pa.int64()),
    ("spans", SPANS), ("items", pa.list_(pa.string())), ("near", pa.list_(pa.string())),
])
FOUND_DDL = "path string, segment long, row long, doc_id long, key0 long, key1 long, n_words long, spans array<struct<start:long,end:long>>, items array<string>, near array<string>"


def united(spans: Sequence[tuple[int, int]]) -> list[dict[str, int]]:
    out: list[dict[str, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], end)
        else:
            out.append({"start": start, "end": end})
    return out


def judged(segment: Segment, block: Block) -> tuple[dict[int, list[dict[str, int]]], dict[int, set[str]], dict[int, set[str]]]:
    """By document: its spans, the items with windows in it, and those near."""
    window, start, near_window, near_at = matches(segment, block)

    def by_text(text: np.ndarray, window: np.ndarray) -> dict[int, set[str]]:
        out: dict[int, set[str]] = {}
        for t, w in set(zip(text.tolist(), window.tolist(), strict=True)):
            out.setdefault(t, set()).update(block.items[i] for i in block.owners[block.first[w] : block.first[w + 1]].tolist())
        return out

    text = np.searchsorted(segment.bounds, start, side="right") - 1
    spans: dict[int, set[tuple[int, int]]] = {}
    for t, a, n in zip(text.tolist(), (start - segment.bounds[text]).tolist(), block.sizes[window].tolist(), strict=True):
        spans.setdefault(t, set()).add((a, a + n))
    items, near = by_text(text, window), by_text(np.searchsorted(segment.bounds, near_at, side="right") - 1, near_window)
    return {t: united(list(s)) for t, s in spans.items()}, items, {t: x - items.get(t, set()) for t, x in near.items()}


def search(index: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row per indexed document: doc_id, its text's keys, n_words, spans (word positions that items' windows cover, united), items (ids as
    sorted strings) and near (items with a proximity match only).

    An empty benchmark hits nothing, repeated items are judged alone, a null item id counts as "null".
    """
    found: list[DataFrame] = []
    for block in blocks(benchmark, item_col, item_text_col):
        vocabulary = block.vocabulary
        block.rank(vocabulary, term_counts(index, vocabulary))
        found.append(one_task_each(index).mapInArrow(searcher(index.sparkSession.sparkContext.broadcast(block)), FOUND_DDL))
    if len(found) == 1:
        return found[0]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    flat = lambda c: F.flatten(F.collect_list(c))
    rows = every.groupBy("path", "segment", "row").agg(*[F.first(c).alias(c) for c in ("doc_id", "key0", "key1", "n_words")], flat("spans").alias("spans"), flat("items").alias("items"), flat("near").alias("near"))
    one = F.array().cast("array<struct<start:long,end:long>>")

    def join(a: Column, s: Column) -> Column:
        last = F.element_at(a, -1)
        longer = F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(a) > 0) & (s["start"] <= F.try_element_at(a, F.lit(-1))["end"]), longer).otherwise(F.array_append(a, s))

    rows = rows.withColumn("spans", F.aggregate(F.array_sort("spans"), one, join)).withColumn("items", F.array_sort(F.array_distinct("items")))
    return rows.withColumn("near", F.array_sort(F.array_except("near", "items")))


def searcher(sent: Any) -> Any:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = sent.value
        for path, n, segment in each_segment(batches):
            spans, items, near = judged(segment, block)
            rows = range(len(segment.keys))
            yield pa.RecordBatch.from_arrays([
                pa.array([path] * len(rows)), pa.array([n] * len(rows), pa.int64()), pa.array(rows, pa.int64()), pa.array(segment.keys[:, 0], mask=segment.keys[:, 1] == 1),
                pa.array(segment.keys[:, 2]), pa.array(segment.keys[:, 3]), pa.array(np.diff(segment.bounds)), pa.array([spans.get(i, []) for i in rows], SPANS),
                pa.array([sorted(items.get(i, ())) for i in rows], pa.list_(pa.string())), pa.array([sorted(near.get(i, ())) for i in rows], pa.list_(pa.string())),
            ], schema=FOUND)

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Adds to docs: n_words, spans, items and near as `search` has them; replaces columns of these names.

    A null text has no words; what is found depends on the text alone, so equal texts share it.
    """
    names = ["n_words", "spans", "items", "near"]
    texts = docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = save(search(build_index(texts), benchmark, item_col, item_text_col), "found").dropDuplicates(["key0", "key1"])
    keys = text_keys(F.col(text_col))
    same = (keys[0] == found["key0"]) & (keys[1] == found["key1"])
    base = docs.drop(*names)
    return base.join(found.select("key0", "key1", *names), same, "left").select(*base.columns, *names)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents without a window of a benchmark item."""
    texts = docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    hit = search(build_index(texts), benchmark).where(F.size("spans") > 0).select("key0", "key1").distinct()
    keys = text_keys(F.col(text_col))
    return docs.join(hit, (keys[0] == hit["key0"]) & (keys[1] == hit["key1"]), "left_anti")


def op9_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


QUERIES = {"op9_positional_index": op9_positional_index}


def oracle() -> str:
    """DuckDB SQL of op9: a plain join of ten-word windows."""
    words = "regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""WITH d AS (SELECT doc_id, {words} AS w FROM documents), b AS (SELECT item_id, {words} AS w FROM benchmark),
items AS (SELECT item_id, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: w[i:i + 9])) AS win FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT len(win) AS n FROM items),
places AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, sizes WHERE len(w) >= n),
hits AS (SELECT doc_id, i, n, item_id FROM (SELECT doc_id, i, n, w[i:i + n - 1] AS win FROM places) p JOIN items USING (win)),
spots AS (SELECT doc_id, count(DISTINCT s) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS s FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items, sha256(COALESCE(ids, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN found USING (doc_id)"""


ORACLE_SQL = {"op9_positional_index": oracle()}
