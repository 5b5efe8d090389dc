"""Ranked lexical search: a stored index of impacts and Fagin's threshold algorithm over it.

An index is files of segments. A segment holds some documents twice: a forward
index (each document's terms with their impacts) and, for each term, the list
of its postings from the highest impact to the lowest. A posting's impact, a
number that depends on how often the term occurs and how long the document is,
has the corpus' average length in it, so the corpus is counted first.

A search goes round-robin down the lists of an item's terms, looks every new
document up in the forward index for its whole score, and stops when the
threshold, the score that the next entries of all lists would give together,
is strictly below the k-th score: nothing unseen can then reach it, not even as
a tie. A task carries an item's k best from one segment to the next, and the
k-th of them ends later searches sooner. Each task's k best are the candidates
of which the k best of all are taken.
"""

from __future__ import annotations

import io
import math
import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .files import open_for_read, open_for_write
from .shared import save, scratch, shared_dir, stored, table, text_batches
from .words import ALNUM, sizes_of, words_of

TOP = 10
#: Fixed values of the score: the weight's scale, the impact's scale and saturation, the share of a document's length in it.
WEIGHT, SCALE, ONE, SATURATION, BASE, LENGTH = 1000, 1_000_000_000, 1000, 8, 25, 75
#: Text of a segment, segments' bytes of a file, items and terms of a block, entries that the first round takes from each list.
SEGMENT_BYTES, FILE_BYTES, BLOCK_ITEMS, BLOCK_TERMS, STEP = 24_000_000, 256_000_000, 512, 200_000, 8
MARK = b"LXI1\n\0"
HEAD = struct.Struct("<6sQQQ7Q")
KINDS = ("<i8", "u1", "<u8", "<u4", "<u4", "<u4", "<u4")


class LexicalIndexError(ValueError):
    """A file that isn't what the manifest says."""


class Index(NamedTuple):
    """The files (path, segments), N documents with terms, and L terms in them."""

    manifest: DataFrame
    documents: int
    words: int


@dataclass
class Segment:
    ids: np.ndarray
    nulls: np.ndarray
    names: np.ndarray  # hashes of the terms, ascending
    held: np.ndarray  # how many distinct terms each document has
    terms: np.ndarray  # of each posting, document after document
    impacts: np.ndarray
    ranked: np.ndarray  # postings, term after term, each term's from the highest impact
    df: np.ndarray  # documents of each term


def weight(documents: int, df: int) -> int:
    return math.floor(WEIGHT * math.log((2 * documents + 2) / (2 * df + 1)))


def lengths(sizes: np.ndarray, documents: int, words: int) -> np.ndarray:
    """Each document's m: 25 and 75 times its length by the average one, rounded down."""
    if not len(sizes) or not words:
        return np.full(len(sizes), BASE, np.int64)
    if LENGTH * int(sizes.max()) * documents < 2**63:
        return BASE + (LENGTH * sizes.astype(np.int64) * documents) // words
    return np.array([BASE + LENGTH * int(n) * documents // words for n in sizes], np.int64)


def segment_of(ids: np.ndarray, nulls: np.ndarray, texts: Sequence[str | None], documents: int, words: int) -> Segment:
    found = words_of(texts, ALNUM)
    sizes = np.diff(found.bounds)
    names, number = np.unique(found.hashes, return_inverse=True)
    key, times = np.unique((np.repeat(np.arange(len(texts), dtype=np.uint64), sizes) << np.uint64(32)) | number.astype(np.uint64), return_counts=True)
    doc, terms = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    impacts = (SCALE * times) // (ONE * times + SATURATION * lengths(sizes, documents, words)[doc])
    down = np.uint64(SCALE // ONE) - impacts.astype(np.uint64)
    ranked = np.argsort((terms.astype(np.uint64) << np.uint64(32)) | down, kind="stable")
    return Segment(ids, nulls, names, np.bincount(doc, minlength=len(texts)).astype(np.uint32), terms, impacts.astype(np.uint32), ranked.astype(np.uint32), np.bincount(terms, minlength=len(names)).astype(np.uint32))


def segment_bytes(s: Segment, pack: zstandard.ZstdCompressor) -> bytes:
    arrays = (s.ids, s.nulls, s.names, s.df, s.held, s.terms, s.impacts, s.ranked)
    raws = [pack.compress(np.ascontiguousarray(a, kind).tobytes()) for a, kind in zip(arrays[:4], KINDS[:4], strict=True)]
    raws += [pack.compress(np.ascontiguousarray(a, "<u4").tobytes()) for a in (s.held, s.terms)]
    raws.append(pack.compress(np.concatenate([s.impacts, s.ranked]).astype("<u4").tobytes()))
    return HEAD.pack(MARK, len(s.ids), len(s.names), len(s.terms), *map(len, raws)) + b"".join(raws)


def segments(path: str, n: int, postings: bool = True) -> Iterator[Segment]:
    """The segments of a file; without `postings` only the terms and how many documents hold them."""
    unpack = zstandard.ZstdDecompressor()
    seen = 0
    with open_for_read(path) as stream:
        while head := stream.read(HEAD.size):
            if len(head) != HEAD.size or head[: len(MARK)] != MARK:
                raise LexicalIndexError(f"{path}: no segment")
            _, documents, terms, total, *sizes = HEAD.unpack(head)
            read = lambda i, kind: np.frombuffer(unpack.decompress(stream.read(sizes[i])), kind)  # noqa: E731, B023
            none = np.zeros(0, np.uint32)
            if postings:
                ids, nulls, names, df, held, of, both = (read(i, kind) for i, kind in enumerate(KINDS))
                if len(ids) != documents or len(of) != total or len(both) != 2 * total:
                    raise LexicalIndexError(f"{path}: a segment without all its postings")
                yield Segment(ids, nulls.astype(bool), names, held, of, both[:total], both[total:], df)
            else:
                stream.seek(sizes[0] + sizes[1], 1)
                names, df = read(2, "<u8"), read(3, "<u4")
                stream.seek(sum(sizes[4:]), 1)
                yield Segment(none, none, names, none, none, none, none, df)
            if len(names) != terms:
                raise LexicalIndexError(f"{path}: a segment without all its terms")
            seen += 1
    if seen != n:
        raise LexicalIndexError(f"{path}: {seen} segments instead of {n}")


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[str | None]]]:
    """Ids, whether they are null, and texts, of about `most` bytes of text (or one row)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in text_batches(batches, "text", most):
        if held and size + batch.nbytes > most:
            yield _rows(held)
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield _rows(held)


def _rows(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, list[str | None]]:
    whole = pa.Table.from_batches(held)
    ids = whole.column("doc_id").combine_chunks()
    return ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), whole.column("text").to_pylist()


def build_index(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Counts the corpus and writes the index into the folder (a new shared one).

    A null text has no terms. Repeated and null ids are documents of their own;
    other columns play no part. A very long text is one segment: its postings
    are in memory, its words in slices.
    """
    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "lexical")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = words = 0
        for batch in text_batches(batches, "text"):
            sizes = sizes_of(batch.column("text").to_pylist(), ALNUM)
            n, words = n + int((sizes > 0).sum()), words + int(sizes.sum())
        yield pa.RecordBatch.from_pydict({"n": [n], "words": [words]})

    total = rows.select("text").mapInArrow(count, "n long, words long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first()
    documents, words = int(total["n"]), int(total["words"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        done: list[tuple[str, int]] = []
        path, out, n, size = "", None, 0, 0
        for ids, nulls, texts in gathered(batches, SEGMENT_BYTES):
            if out is None:
                path, out = open_for_write(f"{folder}/files", ".lxi")
                n = size = 0
            raw = segment_bytes(segment_of(ids, nulls, texts, documents, words), pack)
            out.write(raw)
            n, size = n + 1, size + len(raw)
            if size >= FILE_BYTES:
                out.close()
                done, out = [*done, (path, n)], None
        if out is not None:
            out.close()
            done.append((path, n))
        yield pa.RecordBatch.from_pydict({"path": [p for p, _ in done], "segments": [k for _, k in done]}, pa.schema([("path", pa.string()), ("segments", pa.int64())]))

    manifest = stored(rows.mapInArrow(write, "path string, segments long"), f"{folder}/manifest-{uuid.uuid4().hex}")
    return Index(manifest, documents, words)


@dataclass
class Block:
    """Items: the vocabulary's numbers of item i's distinct terms, and how often each occurs in it, are terms[first[i]:first[i + 1]], times[...]."""

    vocabulary: np.ndarray
    first: np.ndarray
    terms: np.ndarray
    times: np.ndarray


def saved_arrays(folder: str, suffix: str, **arrays: np.ndarray) -> str:
    held = io.BytesIO()
    np.savez(held, **arrays)
    path, out = open_for_write(folder, suffix)
    with out:
        out.write(held.getvalue())
    return path


def loaded_arrays(path: str) -> dict[str, np.ndarray]:
    with open_for_read(path) as stream:
        return dict(np.load(io.BytesIO(stream.read())))


def write_blocks(items: DataFrame, folder: str, item_col: str, text_col: str) -> DataFrame:
    """Writes the items, a bounded number to a block; a row for each: block (its path), number (in it) and item_id."""
    kind = items.schema[item_col].dataType
    schema = pa.schema([("block", pa.string()), ("number", pa.int32()), ("item_id", to_arrow_type(kind))])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "text"):
            words = words_of(batch.column("text").to_pylist(), ALNUM)
            start = 0
            while start < batch.num_rows:
                stop = start + 1
                while stop < min(batch.num_rows, start + BLOCK_ITEMS) and words.bounds[stop + 1] - words.bounds[start] <= BLOCK_TERMS:
                    stop += 1
                here = words.bounds[start : stop + 1]
                vocabulary, number = np.unique(words.hashes[here[0] : here[-1]], return_inverse=True)
                key = (np.repeat(np.arange(stop - start), np.diff(here)).astype(np.uint64) << np.uint64(32)) | number.astype(np.uint64)
                key, times = np.unique(key, return_counts=True)
                first = np.searchsorted(key >> np.uint64(32), np.arange(stop - start + 1, dtype=np.uint64))
                path = saved_arrays(f"{folder}/blocks", ".npz", vocabulary=vocabulary, first=first, terms=(key & np.uint64(0xFFFFFFFF)).astype(np.int64), times=times.astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([path] * (stop - start)), pa.array(range(stop - start), pa.int32()), batch.column("item_id").slice(start, stop - start).cast(schema[2].type)], schema=schema)
                start = stop

    rows = items.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text"))
    few = max(1, -(-rows.count() // BLOCK_ITEMS))
    return stored(rows.repartition(few).mapInArrow(write, f"block string, number int, item_id {kind.simpleString()}"), f"{folder}/items-{uuid.uuid4().hex}")


def frequencies(pairs: DataFrame, folder: str) -> DataFrame:
    """block and the file with the documents that hold each of its terms; pairs are (block, path, segments)."""
    schema = pa.schema([("block", pa.string()), ("term", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, vocabulary, total = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def found() -> Iterator[pa.RecordBatch]:
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(total[used])], schema=schema)

        for row in (r for b in batches for r in b.to_pylist()):
            if row["block"] != block:
                yield from found()
                block = row["block"]
                vocabulary = loaded_arrays(block)["vocabulary"]
                total = np.zeros(len(vocabulary), np.int64)
            for segment in segments(row["path"], row["segments"], postings=False):
                at = places(segment.names, vocabulary)
                total += np.where(at >= 0, segment.df[at] if len(segment.df) else 0, 0)
        yield from found()

    def write(key: tuple[Any, ...], rows: pa.Table) -> pa.Table:
        path = saved_arrays(f"{folder}/df", ".npz", term=rows.column("term").to_numpy(), n=rows.column("n").to_numpy())
        return pa.table({"block": pa.array([key[0].as_py()], pa.string()), "df": pa.array([path], pa.string())})

    counted = pairs.mapInArrow(count, "block string, term int, n long").groupBy("block", "term").agg(F.sum("n").alias("n"))
    return stored(counted.groupBy("block").applyInArrow(write, "block string, df string"), f"{folder}/frequencies-{uuid.uuid4().hex}")  # a row for each of a block's terms


def places(names: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted value stands in the ascending names, or -1."""
    if not len(names):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
    return np.where(names[at] == wanted, at, -1)


class Lists:
    """A segment's postings of a block's vocabulary, terms by the vocabulary's numbers."""

    def __init__(self, segment: Segment, vocabulary: np.ndarray):
        at = places(segment.names, vocabulary)
        number = np.full(len(segment.names), -1, np.int64)
        number[at[at >= 0]] = np.flatnonzero(at >= 0)
        of = number[segment.terms]
        kept = of >= 0
        doc = np.repeat(np.arange(len(segment.ids)), segment.held)
        self.terms, self.impacts, self.doc = of[kept], segment.impacts[kept].astype(np.int64), doc[kept]
        self.row = np.searchsorted(self.doc, np.arange(len(segment.ids) + 1))  # the forward index: document i's postings
        ranked = segment.ranked[kept[segment.ranked]]
        self.ranked = (np.cumsum(kept) - 1)[ranked]
        self.first = np.zeros(len(vocabulary), np.int64)  # the lists, in the order of the vocabulary, as hashes ascend in both
        self.df = np.where(at >= 0, segment.df[at].astype(np.int64) if len(segment.df) else 0, 0)
        self.first[:] = np.cumsum(self.df) - self.df
        self.weight = np.zeros(len(vocabulary), np.int64)
        self.ids, self.nulls, self.seen = segment.ids, segment.nulls, np.zeros(len(segment.ids), bool)

    def scores(self, docs: np.ndarray) -> np.ndarray:
        """Whole scores by random access to the forward index."""
        sizes = self.row[docs + 1] - self.row[docs]  # never empty: each of these documents holds one of the terms
        ends = np.cumsum(sizes)
        at = np.arange(int(ends[-1])) - np.repeat(ends - sizes - self.row[docs], sizes)
        return np.add.reduceat(self.weight[self.terms[at]] * self.impacts[at], ends - sizes)

    def best(self, terms: np.ndarray, weights: np.ndarray, best: Best, k: int) -> tuple[Best, int]:
        """The k best of those before and this segment's documents, and how many of these were looked up."""
        here = np.flatnonzero((self.df[terms] > 0) & (weights > 0))
        terms, weights = terms[here], weights[here]
        if not len(terms):
            return best, 0
        self.weight[terms] = weights
        self.seen[:] = False
        at, end, step, looked = self.first[terms].copy(), self.first[terms] + self.df[terms], STEP, 0
        while True:
            sizes = np.minimum(end - at, step)
            stops = np.cumsum(sizes)
            took = np.arange(int(stops[-1])) - np.repeat(stops - sizes - at, sizes)
            docs = self.doc[self.ranked[took]]
            docs = np.unique(docs[~self.seen[docs]])
            if len(docs):
                self.seen[docs] = True
                looked += len(docs)
                best = better(best, self.scores(docs), self.ids[docs], self.nulls[docs], k)
            at += sizes
            open_lists = at < end
            threshold = int((weights[open_lists] * self.impacts[self.ranked[at[open_lists]]]).sum())
            if not threshold or len(best.scores) == k and threshold < best.scores[-1]:
                break
            step *= 2
        self.weight[terms] = 0
        return best, looked


class Best(NamedTuple):
    scores: np.ndarray
    ids: np.ndarray
    nulls: np.ndarray


def none_yet() -> Best:
    return Best(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))


def better(best: Best, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray, k: int) -> Best:
    """The k best of both: the highest scores above 0, then the smallest ids, null last."""
    if len(best.scores) == k:
        may = scores >= best.scores[-1]
        scores, ids, nulls = scores[may], ids[may], nulls[may]
    scores, ids, nulls = np.concatenate([best.scores, scores]), np.concatenate([best.ids, ids]), np.concatenate([best.nulls, nulls])
    order = np.lexsort((ids, nulls, -scores))[:k]
    order = order[scores[order] > 0]
    return Best(scores[order], ids[order], nulls[order])


def search(index: Index, items: DataFrame, k: int = TOP, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id and score: each item's k best documents with a score above 0, ties to the smaller id (null last).

    An item's repeated terms count as often as they stand there. A null or
    empty item finds nothing, repeated items are ranked each alone, with no
    items or documents there are no rows. Terms are compared by 64-bit hashes.
    """
    spark = items.sparkSession
    documents = index.documents
    with scratch(spark, "lexical-search") as keep:
        folder = shared_dir(spark, "lexical-search/blocks")
        known = write_blocks(items, folder, item_col, text_col)
        pairs = keep(index.manifest.crossJoin(known.select("block").distinct()), "pairs")  # each file meets each block of items
        dealt = pairs.repartition(max(1, min(10_000, pairs.count()))).sortWithinPartitions("block")
        df = frequencies(dealt, folder)
        schema = pa.schema([("block", pa.string()), ("number", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, held, weights = None, None, np.zeros(0, np.int64)
            tops: list[Best] = []

            def found() -> Iterator[pa.RecordBatch]:
                number = np.repeat(np.arange(len(tops)), [len(t.scores) for t in tops])
                if len(number):
                    ids = pa.array(np.concatenate([t.ids for t in tops]), mask=np.concatenate([t.nulls for t in tops]))
                    yield pa.RecordBatch.from_arrays([pa.array([block] * len(number)), pa.array(number.astype(np.int32)), ids, pa.array(np.concatenate([t.scores for t in tops]))], schema=schema)

            for row in (r for b in batches for r in b.to_pylist()):
                if row["block"] != block:
                    yield from found()
                    block, held, counts = row["block"], Block(**loaded_arrays(row["block"])), loaded_arrays(row["df"])
                    weights = np.zeros(len(held.vocabulary), np.int64)
                    weights[counts["term"]] = [weight(documents, int(n)) for n in counts["n"]]
                    tops = [none_yet() for _ in range(len(held.first) - 1)]
                for segment in segments(row["path"], row["segments"]):
                    lists = Lists(segment, held.vocabulary)
                    for i in range(len(tops)):
                        own = slice(held.first[i], held.first[i + 1])
                        tops[i], _ = lists.best(held.terms[own], held.times[own] * weights[held.terms[own]], tops[i], k)
            yield from found()

        ready = pairs.join(df, "block").repartition(max(1, min(10_000, pairs.count()))).sortWithinPartitions("block")
        near = ready.mapInArrow(run, "block string, number int, doc_id long, score long")
        best = Window.partitionBy("block", "number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        out = save(known.join(ranked, ["block", "number"]).select("item_id", "rank", "doc_id", "score"), "ranked")
    drop(folder)
    return out


def drop(folder: str) -> None:
    system, path = pafs.FileSystem.from_uri(folder)
    if system.get_file_info(path).type == pafs.FileType.Directory:
        system.delete_dir(path)


def op12_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "lexical")
    try:
        return search(build_index(table(spark, sf_dir, "documents"), folder), table(spark, sf_dir, "benchmark"))
    finally:
        drop(folder)


QUERIES = {"op12_threshold_search": op12_threshold_search}


def oracle() -> str:
    """DuckDB SQL of op12: every document's score for every item."""
    words = "regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""WITH d AS (SELECT doc_id, {words} AS w FROM documents), s AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS words FROM d WHERE len(w) > 0),
tf AS (SELECT doc_id, term, n, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, CAST(floor(1000 * ln((2 * (SELECT docs FROM s) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf GROUP BY term),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({words}) AS term FROM benchmark) GROUP BY ALL),
found AS (SELECT item_id, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words)))) AS BIGINT) AS score
FROM q JOIN df USING (term) JOIN tf USING (term), s GROUP BY item_id, doc_id),
best AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM found WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM best WHERE rank <= 10"""


ORACLE_SQL = {"op12_threshold_search": oracle()}
