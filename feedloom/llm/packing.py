"""Best-fit packing of token pieces into sequences, planned on the histogram of lengths.

How pieces of a length are placed depends on their number only, so the plan is
made from at most `capacity` counts whatever the corpus' size: pieces above a
third of the capacity, of which a sequence holds two at most, are matched
greedily (the longest with the longest that fits beside it); shorter ones,
longest first, go to the tightest gap left. The plan is a short list of runs
"the next n pieces of this length go, t to a sequence, to sequences b, b+1, ...
at this offset"; each piece finds its place by its rank among those of its
length, which is computed without gathering a length in one task.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import partition_id
from .shared import save, table, text_batches, with_rank
from .tokens import encoder

CAPACITY, END_ID = 1024, 2


class Run(NamedTuple):
    """Pieces of `length` with ranks from `rank` on, `count` of them, go to the sequences from `sequence` on, `each` to one, from `offset` on."""

    length: int
    rank: int
    count: int
    each: int
    sequence: int
    offset: int


def plan(counts: Mapping[int, int], capacity: int = CAPACITY) -> tuple[list[Run], int]:
    """The runs and the number of sequences. There are at most a few runs for each length and gap, however large the counts."""
    if any(not 0 < length <= capacity for length in counts):
        raise ValueError("lengths must be from 1 to the capacity")
    left = {length: n for length, n in counts.items() if n > 0}
    used = dict.fromkeys(left, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}
    runs: list[Run] = []
    sequences = 0

    def put(length: int, bins: int, each: int, at: int, offset: int) -> None:
        runs.append(Run(length, used[length], bins * each, each, at, offset))
        used[length] += bins * each
        left[length] -= bins * each

    def keep(gap: int, at: int, bins: int) -> None:
        if gap and bins:
            gaps.setdefault(gap, []).append((at, bins))

    large = sorted(length for length in left if 3 * length > capacity)
    while large:
        length = large[-1]
        if not left[length]:
            large.pop()
            continue
        place = bisect.bisect_right(large, capacity - length) - 1
        while place >= 0 and left[large[place]] < 1 + (large[place] == length):
            place -= 1
        partner = large[place] if place >= 0 else 0
        if partner == length:
            bins = left[length] // 2
            put(length, bins, 2, sequences, 0)
        elif partner:
            bins = min(left[length], left[partner])
            put(length, bins, 1, sequences, 0)
            put(partner, bins, 1, sequences, length)
        else:
            bins = left[length]
            put(length, bins, 1, sequences, 0)
        keep(capacity - length - partner, sequences, bins)
        sequences += bins
    for length in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        open_gaps = sorted(g for g in gaps if g >= length)
        while left[length]:
            while open_gaps and not gaps.get(open_gaps[0]):
                open_gaps.pop(0)
            if open_gaps:
                gap = open_gaps[0]
                at, bins = gaps[gap].pop()
            else:
                gap, at = capacity, sequences
                bins = -(-left[length] // (capacity // length))
                sequences += bins
            each = gap // length
            full = min(bins, left[length] // each)
            if full:
                put(length, full, each, at, capacity - gap)
                keep(gap - each * length, at, full)
            rest = min(left[length], each) if full < bins else 0
            if rest:
                put(length, 1, rest, at + full, capacity - gap)
                keep(gap - rest * length, at + full, 1)
            keep(gap, at + full + bool(rest), bins - full - bool(rest))
    return runs, sequences


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids (little-endian bytes) and a number of its own (uid).
    A text's ids and the end id are one piece; only longer ones are cut, the remainder first. A null text is the end id alone."""
    end = struct.pack("<I", end_id)
    kinds = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary()), ("uid", pa.int64())] * with_ids
    schema = pa.schema(kinds)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = partition_id() << 40
        for batch in text_batches(batches, "text"):
            columns: list[list] = [[] for _ in kinds]
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), encoder(vocabulary).encode(batch.column("text").to_pylist()), strict=True):
                raw += end
                n = len(raw) // 4
                stops = range(n % capacity or capacity, n + 1, capacity)
                for i, stop in enumerate(stops):
                    start = stops[i - 1] if i else 0
                    part = raw[4 * start : 4 * stop]
                    for column, value in zip(columns, (doc_id, i, start, stop - start, zlib.crc32(part), part, uid), strict=False):
                        column.append(value)
                    uid += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary, uid long" * with_ids)


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ids_crc32, ...). Repeated rows are pieces of their own; no pieces, no rows."""
    ranked = with_rank(cut, ["length"], ["doc_id", "piece", "ids_crc32"], "__rank", ordered=False)
    counts = {r["length"]: r["n"] for r in ranked.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs, _ = plan(counts, capacity)
    table_of = {length: np.array([r for r in runs if r.length == length], np.int64) for length in counts}

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            length, rank = frame["length"].to_numpy(), frame.pop("__rank").to_numpy()
            sequence, offset = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
            order = np.argsort(length, kind="stable")
            values, starts = np.unique(length[order], return_index=True)
            for value, rows in zip(values.tolist(), np.split(order, starts[1:]), strict=True):
                own = table_of[value]
                run = own[np.searchsorted(own[:, 1], rank[rows], side="right") - 1]
                inside = rank[rows] - run[:, 1]
                sequence[rows] = run[:, 4] + inside // run[:, 3]
                offset[rows] = run[:, 5] + inside % run[:, 3] * value
            frame["sequence_id"], frame["offset"] = sequence, offset
            yield frame

    return ranked.mapInPandas(find, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long")


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents in sequences of at most `capacity` tokens: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    cut = pieces(docs, vocabulary, capacity, end_id, with_ids, id_col, text_col)
    if not with_ids:
        return place(cut, capacity)
    cut = save(cut, "pieces")  # ids wait there while their places are found, and move once
    placed = place(cut.drop("ids"), capacity)
    return placed.join(cut.select("uid", "ids"), "uid").drop("uid")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (little-endian bytes) and the doc_ids in it, of pieces packed with their ids. A sequence is at most `capacity` rows."""
    held = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    rows = packed.groupBy("sequence_id").agg(held.alias("held"))
    return rows.select("sequence_id", F.aggregate("held", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"), F.transform("held", lambda x: x["doc_id"]).alias("doc_ids"))


def op2_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op2_best_fit": op2_best_fit}
