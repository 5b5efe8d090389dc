"""Repeated byte strings: interval trees over enhanced suffix arrays of buckets, and removal of what smaller ids already have.

A window is a byte string of SPAN bytes. Its key is the least hash of the
K-byte strings in it, so equal windows have equal keys, and windows in a row
with one key are a segment. Three passes over the documents' blocks (input
splits) follow:

1. a block tells each bucket of keys which it has and how many distinct segments
   of each; keys of one document only are done with;
2. of the rest it sends each distinct segment's bytes once, with the least
   document. A bucket builds the suffix array of its segments' windows with the
   common prefixes of neighbours, and a scan with a stack gives the tree of
   common-prefix intervals. The outermost intervals of SPAN bytes or more are the
   repeated windows, which have the least document of all their occurrences;
   intervals whose occurrences don't all have the same byte before them are the
   maximal repeats;
3. a block looks its segments up in what the buckets answered, and each document
   drops the bytes that smaller documents have, or tells its places of the
   maximal repeats.

Buckets get one row for each block, however common a string is. A key with more
than HOT distinct segments is no bucket's work: of those segments blocks send
the hash and least document of each distinct window instead, which spread over
all buckets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as pads
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import save, shared_dir, table, text_batches
from .words import BYTE, mix

SPAN, K = 50, 24
#: Distinct segments of a key, summed over blocks, beyond which its windows are dealt one by one.
HOT = 20_000
#: Texts whose windows are hashed at once; some ten arrays of eight bytes for each of theirs stand beside them.
BATCH_BYTES = 1_500_000
FACTOR = np.uint64(0xC2B2AE3D27D4EB4F)
INVERSE = np.uint64(pow(int(FACTOR), -1, 2**64))
NONE = np.iinfo(np.int64).max


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def rolled(values: np.ndarray, n: int) -> np.ndarray:
    """The hash of n values in a row, from each place on (n a sum of powers of two)."""
    parts, width, block, at, out = [], 1, values, 0, None
    while width <= n:
        parts.append((width, block))
        block = block[:-width] * np.uint64(pow(int(FACTOR), width, 2**64)) + block[width:]
        width *= 2
    for width, block in reversed(parts):
        if n & width:
            out = block if out is None else out[: len(block) - at] * np.uint64(pow(int(FACTOR), width, 2**64)) + block[at:][: len(out)]
            at += width
    return out


def least_of(values: np.ndarray, n: int) -> np.ndarray:
    """The least of n values in a row, from each place on."""
    width, block = 1, values
    while 2 * width <= n:
        block = np.minimum(block[:-width], block[width:])
        width *= 2
    rest = n - width
    return np.minimum(block[: len(block) - rest], block[rest:]) if rest else block


class Segments:
    """The segments of some texts: key, bytes' hash, document index, start and number of windows of each."""

    def __init__(self, raws: list[bytes]):
        self.data = np.frombuffer(b"".join(raws), np.uint8)
        lengths = np.fromiter(map(len, raws), np.int64, len(raws))
        self.ends = np.cumsum(lengths)
        self.begins = self.ends - lengths
        n = len(self.data) - SPAN + 1
        self.keys = self.hashes = np.zeros(0, np.uint64)
        self.text = self.start = self.size = np.zeros(0, np.int64)
        if n < 1:
            return
        values = BYTE[self.data]
        key = least_of(mix(rolled(values, K)), SPAN - K + 1)
        valid = np.zeros(n, bool)
        change = np.zeros(n + 1, np.int8)
        long = lengths >= SPAN
        np.add.at(change, self.begins[long], 1)
        np.add.at(change, self.ends[long] - SPAN + 1, -1)
        valid = np.cumsum(change[:-1], dtype=np.int8) > 0
        edge = np.ones(n, bool)
        edge[1:] = (key[1:] != key[:-1]) | (valid[1:] != valid[:-1])
        edge[self.begins[long]] = True
        self.start = np.flatnonzero(edge & valid)
        stops = np.append(np.flatnonzero(edge), n)
        self.size = stops[np.searchsorted(stops, self.start, side="right")] - self.start
        self.keys = mix(key[self.start] ^ FACTOR)  # a least hash is small; buckets need even numbers
        self.text = np.searchsorted(self.ends, self.start, side="right")
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * _powers(FACTOR, len(values)))))
        self.back = _powers(INVERSE, len(values))
        self.hashes = self.hashed(self.start, self.start + self.size + SPAN - 1, self.size.astype(np.uint64))

    def hashed(self, start: np.ndarray, stop: np.ndarray, salt: np.ndarray | np.uint64) -> np.ndarray:
        """A hash of each byte string from start to stop."""
        return mix((self.sums[stop] - self.sums[start]) * self.back[start] + salt)

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(segment, start, hash) of all windows of these segments."""
        each = self.size[which]
        inner = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        segment = np.repeat(which, each)
        start = self.start[segment] + inner
        return segment, start, self.hashed(start, start + SPAN, np.uint64(0)) if len(start) else np.zeros(0, np.uint64)

    def name(self) -> np.ndarray:
        """One number for key and bytes."""
        return mix(self.keys) + self.hashes


def answers(path: str, block: int) -> list[dict[str, Any]]:
    system, folder = pafs.FileSystem.from_uri(f"{path}/block={block}")
    if system.get_file_info(folder).type != pafs.FileType.Directory:
        return []
    return pads.dataset(folder, filesystem=system, format="parquet").to_table().to_pylist()


def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[pa.RecordBatch, Segments]]]]:
    """Each block and its texts' segments, BATCH_BYTES at a time."""

    def parts() -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "text", BATCH_BYTES):
            blocks = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield batch.slice(a, b - a)

    for block, group in groupby(parts(), key=lambda b: b.column("block")[0].as_py()):
        yield block, ((b, Segments([(t or "").encode() for t in b.column("text").to_pylist()])) for b in group)


def ids_of(batch: pa.RecordBatch) -> np.ndarray:
    """Document ids; NONE, which is larger than all and removes nothing, for null."""
    return batch.column("doc_id").fill_null(NONE).to_numpy()


@dataclass
class Tree:
    """Windows in suffix order (text, place) and the common-prefix intervals of at least SPAN bytes: length, rows low to high, whether nothing
    above it has SPAN bytes too, and whether the bytes before its occurrences differ (a text's start differs from all)."""

    text: np.ndarray
    place: np.ndarray
    length: np.ndarray
    low: np.ndarray
    high: np.ndarray
    outer: np.ndarray
    diverse: np.ndarray


def suffix_array(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, height, byte before or -1) of all windows in the order of their suffixes, which end with their text; the height is
    the common prefix with the row before, 0 if it is below SPAN.

    Ties are refined eight bytes at a time up to SPAN, then by prefix doubling: each round sorts them by twice as many bytes."""
    data = np.frombuffer(b"".join(texts) + bytes(2 * SPAN), np.uint8)
    whole = np.fromiter(map(len, texts), np.int64, len(texts))
    sizes, stops = whole - SPAN + 1, np.cumsum(whole)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    place = (np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
    at = (stops - whole)[owner] + place
    eight = np.zeros(len(data) - 7, np.uint64)
    for i in range(8):
        eight = (eight << np.uint64(8)) | data[i : i + len(eight)]
    offsets = (0, 8, 16, 24, 32, 40, SPAN - 8)  # the last word overlaps the one before it: SPAN bytes in all

    def word(position: np.ndarray, left: np.ndarray, offset: int) -> np.ndarray:
        """The eight bytes at an offset, those beyond `left` as zeros."""
        n = np.clip(left - offset, 0, 8).astype(np.uint64)
        kept = np.where(n > 0, ~np.uint64(0) << (np.uint64(8) * (np.uint64(8) - np.maximum(n, np.uint64(1)))), np.uint64(0))
        return eight[np.minimum(position + offset, len(eight) - 1)] & kept

    array = np.argsort(eight[at], kind="stable")
    first = eight[at[array]]
    new = np.append(True, first[1:] != first[:-1])

    def tied() -> np.ndarray:
        return np.flatnonzero(~new | np.append(~new[1:], False))

    def refine(ties: np.ndarray, columns: list[np.ndarray]) -> None:
        """Sorts the tied rows of each group by the columns; what they tell apart begins a group."""
        columns = [np.cumsum(new)[ties], *columns]
        order = np.lexsort(columns[::-1])
        array[ties] = array[ties][order]
        fresh = np.ones(len(ties), bool)
        fresh[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns])
        new[ties] = fresh

    def ranks() -> np.ndarray:
        out = np.empty(len(array), np.int32)
        out[array] = np.cumsum(new) - 1
        return out

    for offset in offsets[1:]:
        ties = tied()
        if len(ties):
            refine(ties, [eight[at[array[ties]] + offset]])
    second = np.flatnonzero(~new)  # SPAN bytes as the row before
    levels, h = [(SPAN, ranks())], SPAN
    while h < whole.max(initial=0) and len(ties := tied()):
        rows = array[ties]
        left = np.maximum(stops[owner[rows]] - at[rows] - h, 0)
        later = np.where(left >= SPAN, levels[-1][1][np.minimum(rows + h, len(array) - 1)], -1)
        refine(ties, [*(word(at[rows] + h, left, o) for o in offsets), np.minimum(left, SPAN), later])
        h *= 2
        levels.append((h, ranks()))
    x, y = array[second - 1].astype(np.int64), array[second].astype(np.int64)
    end_x, end_y = (np.cumsum(sizes)[owner[w]] for w in (x, y))  # of the text's windows
    height = np.zeros(len(second), np.int64)
    for h, rank in reversed(levels):
        both = (x < end_x) & (y < end_y) & (x + h - SPAN < end_x) & (y + h - SPAN < end_y)
        more = both & (rank[np.minimum(x, len(array) - 1)] == rank[np.minimum(y, len(array) - 1)])
        height += h * more
        x, y = x + h * more, y + h * more
    a, b = at[array[second - 1]] + height, at[array[second]] + height
    end_a, end_b = stops[owner[array[second - 1]]], stops[owner[array[second]]]
    alive = np.arange(len(second))
    for _ in range(SPAN):
        alive = alive[(a[alive] < end_a[alive]) & (b[alive] < end_b[alive])]
        alive = alive[data[a[alive]] == data[b[alive]]]
        if not len(alive):
            break
        height[alive] += 1
        a[alive] += 1
        b[alive] += 1
    heights = np.zeros(len(array), np.int64)
    heights[second] = height
    before = np.where(place[array] > 0, data[at[array] - 1].astype(np.int16), -1)
    return owner[array], place[array], heights, before


def interval_tree(texts: list[bytes]) -> Tree:
    """All common-prefix intervals of SPAN bytes or more of the texts' windows: one scan of the suffix array's heights with a stack."""
    if not texts:
        none = np.zeros(0, np.int64)
        return Tree(none, none, none, none, none, none.astype(bool), none.astype(bool))
    text, place, heights, before = suffix_array(texts)
    found: list[tuple[int, int, int, bool]] = []
    stack: list[tuple[int, int]] = []
    rows = np.flatnonzero(heights)
    cuts = np.flatnonzero(np.diff(rows, prepend=-2) > 1)  # heights below SPAN are no interval's: each stretch between them is scanned alone
    for a, z in zip(cuts.tolist(), np.append(cuts[1:], len(rows)).tolist(), strict=False):
        first = int(rows[a])
        for row, height in enumerate([*heights[rows[a:z]].tolist(), 0], first):
            left = row - 1
            while stack and stack[-1][0] > height:
                top, left = stack.pop()
                found.append((top, left, row, not stack and not height))
            if height and (not stack or stack[-1][0] < height):
                stack.append((height, left))
    length, low, high, outer = (np.array(x, k) for x, k in zip(zip(*found, strict=True) if found else ((), (), (), ()), (np.int64, np.int64, np.int64, bool), strict=True))
    changes = np.cumsum(np.append(0, (before[1:] != before[:-1]) | (before[1:] < 0)))
    return Tree(text, place, length, low, high, outer, changes[high - 1] > changes[low] if len(length) else np.zeros(0, bool))


def repeated_windows(tree: Tree, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, least document) of the windows that a text of a smaller document has too; docs: the least document of each text."""
    low, high = tree.low[tree.outer], tree.high[tree.outer]
    order = np.argsort(low)
    low, high = low[order], high[order]
    own = docs[tree.text]
    least = np.minimum.reduceat(np.append(own, NONE), np.stack([low, high], axis=1).ravel())[::2] if len(low) else np.zeros(0, np.int64)
    rows = np.concatenate([np.zeros(0, np.int64), *map(np.arange, low, high)])
    least = np.repeat(least, high - low)
    hit = least < own[rows]
    return tree.text[rows[hit]], tree.place[rows[hit]], least[hit]


def maximal_repeats(data: bytes) -> list[tuple[int, list[int]]]:
    """(length, all places) of each maximal repeat of SPAN bytes or more in one text."""
    if len(data) < SPAN:
        return []
    tree = interval_tree([data])
    use = np.flatnonzero(tree.diverse)
    return sorted((int(tree.length[i]), sorted(tree.place[tree.low[i] : tree.high[i]].tolist())) for i in use)


def least_by(names: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct names, sorted, with the least document of each."""
    order = np.lexsort((docs, names))
    names, docs = names[order], docs[order]
    first = np.append(True, names[1:] != names[:-1]) if len(names) else np.zeros(0, bool)
    return names[first], docs[first]


def found_at(sorted_names: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The place of each name among the sorted ones, -1 if it isn't there."""
    if not len(sorted_names):
        return np.full(len(names), -1)
    at = np.minimum(np.searchsorted(sorted_names, names), len(sorted_names) - 1)
    return np.where(sorted_names[at] == names, at, -1)


def joined(rows: list[dict[str, Any]], field: str, kind: Any) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *[np.frombuffer(r[field], kind) for r in rows if r[field]]])


def split(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """The buckets of sorted keys."""
    which = (keys >> np.uint64(32)).astype(np.int64) * buckets >> 32
    found, starts = np.unique(which, return_index=True)
    yield from ((b, slice(a, z)) for b, a, z in zip(found.tolist(), starts.tolist(), np.append(starts[1:], len(keys)).tolist(), strict=False))


class Passes:
    """The passes over one table: `keys` and `answers` are folders with a part for each block."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, scanned: bool, trees: bool):
        self.spark, self.trees = docs.sparkSession, trees
        columns = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")]
        source = docs.select(*columns) if scanned else save(docs.select(*columns), "documents")  # a block is a split of a file
        self.rows = source.select("doc_id", "text", F.xxhash64(F.input_file_name(), F.input_file_block_start()).alias("block"))
        self.buckets = max(256, 2 * int(self.spark.conf.get("spark.sql.shuffle.partitions")), 2 * self.rows.rdd.getNumPartitions())  # grows with the input's splits
        self.keys, self.answers = shared_dir(self.spark, "keys"), shared_dir(self.spark, "answers")
        self.tell_keys()
        self.tell_segments()

    def kept(self, reply: DataFrame, path: str) -> None:
        reply.repartition("block").write.partitionBy("block").option("compression", "zstd").parquet(path)

    def tell_keys(self) -> None:
        buckets, most = self.buckets, HOT

        def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, parts in by_block(batches):
                pairs, sizes = [], []
                for batch, s in parts:
                    ids = ids_of(batch)[s.text]
                    use = ids != NONE
                    pairs.append(pd.DataFrame({"key": s.keys[use], "doc": ids[use]}).drop_duplicates())
                    distinct, n = np.unique(s.keys[use][np.unique(s.name()[use], return_index=True)[1]], return_counts=True)
                    sizes.append(pd.DataFrame({"key": distinct, "n": n}))
                every = pd.concat(pairs).groupby("key")["doc"].agg(["min", "max"])
                counts = pd.concat(sizes).groupby("key")["n"].sum().to_numpy(np.int64)  # in key order, as `every` is
                keys, several, first = every.index.to_numpy(np.uint64), (every["min"] != every["max"]).to_numpy(), every["min"].to_numpy()
                cut = list(split(keys, buckets))
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array([b for b, _ in cut], pa.int32()), "block": pa.array([block] * len(cut), pa.int64()), "keys": pa.array([keys[x].tobytes() for _, x in cut], pa.binary()),
                    "docs": pa.array([np.where(several[x], -1, first[x]).tobytes() for _, x in cut], pa.binary()), "counts": pa.array([counts[x].tobytes() for _, x in cut], pa.binary()),
                })

        def shared(frame: pd.DataFrame) -> pd.DataFrame:
            keys = [np.frombuffer(x, np.uint64) for x in frame["keys"]]
            own, counts = (np.concatenate([np.frombuffer(x, np.int64) for x in frame[c]]) for c in ("docs", "counts"))
            names, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            low, high, total = np.full(len(names), NONE), np.full(len(names), -NONE), np.zeros(len(names), np.int64)
            np.minimum.at(low, inverse, own)
            np.maximum.at(high, inverse, own)
            np.add.at(total, inverse, counts)
            mine, hot = names[(low != high) | (low == -1)], names[total > most]
            told = [k[np.isin(k, mine, assume_unique=True)] for k in keys]
            return pd.DataFrame({"block": frame["block"], "keys": [k.tobytes() for k in told], "hot": [np.isin(k, hot, assume_unique=True).tobytes() for k in told]})

        sent = self.rows.mapInArrow(tell, "bucket int, block long, keys binary, docs binary, counts binary")
        self.kept(sent.groupBy("bucket").applyInPandas(shared, "block long, keys binary, hot binary"), self.keys)

    def tell_segments(self) -> None:
        buckets, keys_path, trees = self.buckets, self.keys, self.trees
        ddl = "bucket int, block long, keys binary, names binary, docs binary, sizes binary, texts binary, windows binary, window_docs binary"

        def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, parts in by_block(batches):
                mine, hot = known_keys(keys_path, block)
                frames: list[pd.DataFrame] = []
                raws: list[bytes] = []
                before = 0  # bytes of the block's earlier batches
                hashes, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for batch, s in parts:
                    ids = ids_of(batch)[s.text]
                    spot = found_at(mine, s.keys)
                    use = (spot >= 0) & (ids != NONE)
                    busy = use & hot[spot] if len(hot) else np.zeros(len(use), bool)
                    segment, _, window = s.windows(np.flatnonzero(busy))
                    window, owner = least_by(window, ids[segment])
                    hashes.append(window)
                    owners.append(owner)
                    use = np.flatnonzero(use & ~busy)
                    frames.append(first_segments(pd.DataFrame({"key": s.keys[use], "name": s.name()[use], "doc": ids[use], "at": before + s.start[use], "size": s.size[use]})))
                    raws.append(s.data.tobytes())
                    before += len(s.data)
                every, whole = first_segments(pd.concat(frames)), b"".join(raws)
                names, docs, keys = every["name"].to_numpy(np.uint64), every["doc"].to_numpy(np.int64), every["key"].to_numpy(np.uint64)
                starts, stops = every["at"].to_numpy(), (every["at"] + every["size"]).to_numpy() + SPAN - 1
                for b, x in split(keys, buckets):
                    held = [whole[a:z] for a, z in zip(starts[x].tolist(), stops[x].tolist(), strict=True)]
                    yield message(ddl, {"bucket": b, "block": block, "keys": keys[x], "names": names[x], "docs": docs[x], "sizes": np.array([len(t) for t in held], np.int32), "texts": b"".join(held)})
                window, owner = least_by(np.concatenate(hashes), np.concatenate(owners))
                for b, x in split(window, buckets):
                    yield message(ddl, {"bucket": b, "block": block, "windows": window[x], "window_docs": owner[x]})

        def least_documents(frame: pd.DataFrame) -> pd.DataFrame:
            rows = frame.to_dict("records")
            names, keys, own, sizes = joined(rows, "names", np.uint64), joined(rows, "keys", np.uint64), joined(rows, "docs", np.int64), joined(rows, "sizes", np.int32).astype(np.int64)
            data, stops = b"".join(r["texts"] or b"" for r in rows), np.cumsum(sizes)
            distinct, first, inverse = np.unique(names, return_index=True, return_inverse=True)
            least = np.full(len(distinct), NONE)
            np.minimum.at(least, inverse, own)
            _, at, n = np.unique(keys[first], return_inverse=True, return_counts=True)
            mixed = np.flatnonzero(n[at] > 1) if len(distinct) else np.zeros(0, np.int64)  # keys with several segments: their windows may be equal in part
            tree = interval_tree([data[stops[i] - sizes[i] : stops[i]] for i in first[mixed].tolist()])
            del data
            windows: dict[int, np.ndarray] = {}
            text, place, low = repeated_windows(tree, least[mixed])
            order = np.argsort(text, kind="stable")
            for i, group in groupby(zip(text[order].tolist(), place[order].tolist(), low[order].tolist(), strict=True), key=lambda x: x[0]):
                row = np.full(int(sizes[first[mixed[i]]]) - SPAN + 1, NONE)
                for _, p, d in group:
                    row[p] = d
                windows[int(mixed[i])] = row
            hot, hot_least = least_by(joined(rows, "windows", np.uint64), joined(rows, "window_docs", np.int64))
            leaves = nodes = None
            if trees:
                leaves, nodes = groups_of(tree, mixed, distinct, sizes[first], int(frame["bucket"].iloc[0]))
            out, start = [], 0
            for k, r in enumerate(rows):
                count = len(r["names"] or b"") // 8
                mine, had = inverse[start : start + count], own[start : start + count]
                start += count
                part = [i for i, d in zip(mine.tolist(), had.tolist(), strict=True) if i in windows and d == least[i]]
                asked = np.frombuffer(r["windows"] or b"", np.uint64)
                told = {
                    "names": distinct[mine], "least": least[mine], "parts": distinct[part] if part else b"", "sizes": np.array([len(windows[i]) for i in part], np.int64), "windows": b"".join(windows[i].tobytes() for i in part),
                    "hot": asked, "hot_least": hot_least[found_at(hot, asked)], "leaves": leaves[np.isin(leaves[:, 0], distinct[mine])] if trees else b"", "nodes": nodes if trees and not k else b"",
                }
                out.append((r["block"], *[x if isinstance(x, bytes) else x.tobytes() for x in told.values()]))
            return pd.DataFrame(out, columns=["block", *told])

        fields = ("names", "least", "parts", "sizes", "windows", "hot", "hot_least", "leaves", "nodes")
        self.kept(self.rows.mapInArrow(tell, ddl).groupBy("bucket").applyInPandas(least_documents, "block long, " + ", ".join(f"{f} binary" for f in fields)), self.answers)


def first_segments(frame: pd.DataFrame) -> pd.DataFrame:
    """Each distinct segment once, by key and name, with its least document and a place where its bytes are."""
    order = np.lexsort((frame["doc"], frame["name"], frame["key"]))
    frame = frame.take(order)
    return frame[~frame.duplicated(["key", "name"])]


def known_keys(path: str, block: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's keys that several documents have, sorted, and which of them are hot."""
    told = answers(path, block)
    mine, hot = joined(told, "keys", np.uint64), joined(told, "hot", np.bool_)
    order = np.argsort(mine)
    return mine[order], hot[order]


def message(ddl: str, values: dict[str, Any]) -> pa.RecordBatch:
    """One row; arrays as their bytes, fields without a value null."""
    kinds = {name: {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[kind] for name, kind in (x.split() for x in ddl.split(", "))}
    plain = {k: v.tobytes() if isinstance(v, np.ndarray) else v for k, v in values.items()}
    return pa.RecordBatch.from_arrays([pa.array([plain.get(name)], kind) for name, kind in kinds.items()], schema=pa.schema(kinds.items()))


def groups_of(tree: Tree, mixed: np.ndarray, names: np.ndarray, sizes: np.ndarray, bucket: int) -> tuple[np.ndarray, np.ndarray]:
    """(name, place, node) of the windows at their deepest interval, and (node, parent or -1, length, maximal) of the intervals.

    Each segment, of which several documents may have a copy, is also a node of its whole length."""
    base, deepest, parent = bucket << 32, np.full(len(tree.text), -1), np.full(len(tree.length), -1)
    above: list[int] = []
    for i in range(len(tree.length) - 1, -1, -1):  # the scan finds inner intervals before outer ones
        while above and not (tree.low[above[-1]] <= tree.low[i] and tree.high[i] <= tree.high[above[-1]]):
            above.pop()
        parent[i] = above[-1] if above else -1
        above.append(i)
        deepest[tree.low[i] : tree.high[i]] = i
    use = np.flatnonzero(deepest >= 0)
    own = base + len(tree.length) + np.arange(len(names))
    leaves = np.concatenate([
        np.stack([names[mixed[tree.text[use]]], tree.place[use].astype(np.uint64), (base + deepest[use]).astype(np.uint64)], axis=1),
        np.stack([names, np.zeros(len(names), np.uint64), own.astype(np.uint64)], axis=1),
    ])
    nodes = np.concatenate([
        np.stack([base + np.arange(len(parent)), np.where(parent < 0, -1, base + parent), tree.length, tree.diverse.astype(np.int64)], axis=1),
        np.stack([own, np.full(len(own), -1), sizes, np.ones(len(own), np.int64)], axis=1),
    ])
    return leaves, nodes.astype(np.int64)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, scanned: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes, a row for each row of docs.

    A byte goes if a SPAN-byte string over it also starts in a document with a
    smaller id. Null and empty texts have no bytes; rows of one id don't remove
    from each other; rows with a null id lose nothing and remove from none.
    scanned: docs reads files and does nothing else; else it is written first.
    """
    passes = Passes(docs, id_col, text_col, scanned, trees=False)
    keys_path, answers_path = passes.keys, passes.answers
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())]
    schema = pa.schema(fields if with_text else fields[:5])

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, parts in by_block(batches):
            told, (mine, hot) = answers(answers_path, block), known_keys(keys_path, block)
            names, least = joined(told, "names", np.uint64), joined(told, "least", np.int64)
            order = np.argsort(names)
            names, least = names[order], least[order]
            partial, sizes, windows = joined(told, "parts", np.uint64), joined(told, "sizes", np.int64), joined(told, "windows", np.int64)
            stops = np.cumsum(sizes)
            of = {n: (z - k, z) for n, z, k in zip(partial.tolist(), stops.tolist(), sizes.tolist(), strict=True)}
            busy, busy_least = least_by(joined(told, "hot", np.uint64), joined(told, "hot_least", np.int64))
            for batch, s in parts:
                ids = ids_of(batch)
                name, own = s.name(), ids[s.text]
                spot = found_at(names, name)
                known = (spot >= 0) & (own != NONE)
                whole = known.copy()
                whole[known] = least[spot[known]] < own[known]
                change = np.zeros(len(s.data) + 1, np.int32)
                np.add.at(change, s.start[whole], 1)
                np.add.at(change, s.start[whole] + s.size[whole] + SPAN - 1, -1)
                for i in np.flatnonzero(known & ~whole & np.isin(name, partial)).tolist():
                    a, z = of[int(name[i])]
                    hit = s.start[i] + np.flatnonzero(windows[a:z] < own[i])
                    np.add.at(change, hit, 1)
                    np.add.at(change, hit + SPAN, -1)
                if hot.any():
                    segment, start, window = s.windows(np.flatnonzero((own != NONE) & np.isin(s.keys, mine[hot])))
                    at = found_at(busy, window)
                    hit = start[(at >= 0) & (np.append(busy_least, NONE)[at] < own[segment])]
                    np.add.at(change, hit, 1)
                    np.add.at(change, hit + SPAN, -1)
                gone = np.cumsum(change[:-1]) > 0
                out: list[list[Any]] = [[] for _ in fields]
                for k, (a, z) in enumerate(zip(s.begins.tolist(), s.ends.tolist(), strict=True)):
                    mask = gone[a:z]
                    kept = s.data[a:z][~mask].tobytes()
                    spans = int(np.count_nonzero(mask[1:] & ~mask[:-1]) + mask[:1].sum())
                    for column, value in zip(out, (batch.column("doc_id")[k].as_py(), z - a, int(mask.sum()), spans, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=False)], schema=schema)

    return passes.rows.mapInArrow(drop, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scanned: bool = False) -> tuple[DataFrame, DataFrame]:
    """The repeats of SPAN bytes and more of several documents: nodes (node, parent, length, maximal) and places (node, doc_id, start).

    A node is an interval of the buckets' trees: a byte string with all its occurrences, which are the places of the node and
    of all nodes below it, so that the output grows with the text and not with nesting. `maximal`: its occurrences don't all
    have the same byte before them. A segment is a node of its own, with one place if only parts of it are repeated. Strings are cut at the borders of segments (runs of windows with one least hash), and so
    is what is known of the byte before. Windows of hot keys aren't told. Rows with a null id have no places.
    """
    passes = Passes(docs, id_col, text_col, scanned, trees=True)
    answers_path = passes.answers

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.concatenate([np.zeros((0, 4), np.int64), *[np.frombuffer(x.as_py(), np.int64).reshape(-1, 4) for x in batch.column("nodes")]])
            parent = pa.array(found[:, 1], mask=found[:, 1] < 0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), parent, pa.array(found[:, 2]), pa.array(found[:, 3] == 1)], names=["node", "parent", "length", "maximal"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, parts in by_block(batches):
            leaves = joined(answers(answers_path, block), "leaves", np.uint64).reshape(-1, 3)
            leaves = np.unique(leaves, axis=0)
            for batch, s in parts:
                ids, name = ids_of(batch), s.name()
                low, high = np.searchsorted(leaves[:, 0], name, side="left"), np.searchsorted(leaves[:, 0], name, side="right")
                each = np.where(ids[s.text] != NONE, high - low, 0)
                segment = np.repeat(np.arange(len(name)), each)
                leaf = leaves[np.repeat(low, each) + np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)] if len(leaves) else leaves
                start = s.start[segment] + leaf[:, 1].astype(np.int64) - s.begins[s.text[segment]]
                yield pa.RecordBatch.from_arrays([pa.array(leaf[:, 2].astype(np.int64)), pa.array(ids[s.text[segment]]), pa.array(start)], names=["node", "doc_id", "start"])

    told = passes.spark.read.parquet(answers_path).where("octet_length(nodes) > 0").select("nodes")
    return told.mapInArrow(nodes, "node long, parent long, length long, maximal boolean"), passes.rows.mapInArrow(places, "node long, doc_id long, start long")


def op3_interval_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), scanned=True)


QUERIES = {"op3_interval_tree": op3_interval_tree}
