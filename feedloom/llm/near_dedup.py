"""MinHash near-duplicates by an LSH forest.

A document is its set of distinct shingles. Each tree of the forest sorts the
documents by a signature of its own: equal beginnings stand next to each other.
A region is a run with one short prefix; where it is dense, a longer prefix
cuts it into smaller ones. Most documents are alone in all their regions and
are left out at once. The others go two ways:

1. neighbours in an order, those with the longest common prefix, are tried
   first, each document's most promising ones only, so that rows grow with
   documents and most of a large group is joined;
2. then every two documents of a region that are still in different components
   are compared, in blocks of a bounded number of rows.

No pair is left out for its place. A profile (how many shingles fall into each
of some cells, one for every two shingles, so that it tells as much of long
documents as of short ones) gives an upper bound of what two sets share, so a
pair that it rules out can't be similar enough; full sets confirm all others.
Two similar documents are missed only if no tree puts them in one region: at a
similarity of 0.8 one pair in 2 * 10**7. Regions with more than `DENSE`
documents are cut to five or six values; their documents stand in `MORE_TREES`
further trees, which makes up for it. Documents with equal sets count once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components, merged
from .shared import save, scratch, table, text_batches
from .words import SPACED, mix, words_of

SHINGLE, PERCENT = 2, 80
#: A tree's order has DEPTH values; regions share the first LEAST_DEPTH, or one more and again one more where they hold over DENSE documents.
TREES, DEPTH, LEAST_DEPTH, DENSE = 32, 6, 4, 4096
#: Trees for documents of dense regions: 32 chances of 0.8 ** 4 are worth as much as 56 of 0.8 ** 6.
MORE_TREES = 24
#: Neighbours of a row that are tried first, in two rounds.
REACH = (4, 16)
#: Rows of one block; two blocks are compared in one group.
BLOCK = 512
#: Cells of a profile, four bits each: at least and at most, and those of its coarse form.
WIDTH, MOST_WIDTH, COARSE = 512, 65_536, 64
#: Up to so many bytes of ids (ID_BYTES each, once they are in a hash table) go to all tasks to pick texts; more are joined by a shuffle.
SENT_BYTES, ID_BYTES = 32_000_000, 72

_RNG = np.random.default_rng(8)
FACTORS = _RNG.integers(0, 2**63, TREES * DEPTH, np.uint64) * np.uint64(2) + np.uint64(1)
MORE_FACTORS = _RNG.integers(0, 2**63, MORE_TREES * DEPTH, np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0x9DDFEA08EB382D69)
Keep = Callable[[DataFrame, str], DataFrame]


def shingle_sets(texts: Sequence[str | None], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted 64-bit hashes of each text's distinct shingles; of fewer words, the whole sequence is one."""
    words = words_of(texts, SPACED)
    out = []
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        own = words.hashes[a:b]
        n = min(shingle, len(own))
        joined = np.zeros(max(len(own) - n + 1, 0) if n else 0, np.uint64)
        for i in range(n):
            joined = joined * STEP + own[i : i + len(joined)]
        out.append(np.unique(mix(joined + np.uint64(n))))
    return out


def signatures(sets: Sequence[np.ndarray], factors: np.ndarray = FACTORS) -> np.ndarray:
    """sets x factors MinHash values of 32 bits; the sets aren't empty."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), len(factors)), np.uint32)
    for i, factor in enumerate(factors):
        out[:, i] = np.minimum.reduceat((flat * factor) >> np.uint64(32), starts)
    return out


def set_keys(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    return int(mix(hashes).sum().astype(np.int64)), int(mix(hashes ^ STEP).sum().astype(np.int64))


def packed(hashes: np.ndarray) -> bytes:
    """The low 48 bits of each hash, six bytes each."""
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def profile(hashes: np.ndarray) -> bytes:
    """How many of a set's hashes fall into each cell, 15 at most, two cells a byte. There are WIDTH cells, or twice as many again and again
    up to half the set's size."""
    width = WIDTH
    while 2 * width < len(hashes) and width < MOST_WIDTH:
        width *= 2
    cells = np.minimum(np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width), 15).astype(np.uint8)
    return (cells[0::2] << 4 | cells[1::2]).tobytes()


def cells_of(raw: bytes) -> np.ndarray:
    both = np.frombuffer(raw, np.uint8)
    return np.stack([both >> 4, both & 15], axis=1).ravel()


def folded(cells: np.ndarray, width: int) -> np.ndarray:
    """The cells of a narrower profile."""
    return cells if len(cells) == width else cells.reshape(-1, width).sum(0, dtype=np.uint16)


def features(docs: DataFrame, shingle: int, factors: np.ndarray = FACTORS) -> DataFrame:
    """doc_id, n_shingles, a 128-bit key of the set and the signature as 16-bit values (null for empty sets)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("key1", pa.int64()), ("key2", pa.int64()), ("signature", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "text", 2_000_000):
            sets = shingle_sets(batch.column("text").to_pylist(), shingle)
            full = [i for i, s in enumerate(sets) if len(s)]
            found: list[bytes | None] = [None] * len(sets)
            if full:
                low = (signatures([sets[i] for i in full], factors) & np.uint32(0xFFFF)).astype(">u2")
                for i, row in zip(full, low, strict=True):
                    found[i] = row.tobytes()
            keys = [set_keys(s) for s in sets]
            columns = [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([a for a, _ in keys], pa.int64()), pa.array([b for _, b in keys], pa.int64()), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.mapInArrow(run, "doc_id long, n_shingles long, key1 long, key2 long, signature binary")


def full_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """doc_id, hashes (packed) and profile of the wanted documents (doc_id); of several texts of one id, that with the least keys."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "text"):
            sets = shingle_sets(batch.column("text").to_pylist(), shingle)
            keys = [set_keys(s) for s in sets]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n": pa.array([len(s) for s in sets], pa.int64()), "key1": pa.array([a for a, _ in keys], pa.int64()), "key2": pa.array([b for _, b in keys], pa.int64()),
                "hashes": pa.array([packed(s) for s in sets], pa.binary()), "profile": pa.array([profile(s) for s in sets], pa.binary()),
            })

    some = F.broadcast(wanted) if ID_BYTES * wanted.count() <= SENT_BYTES else wanted
    rows = docs.join(some, "doc_id", "left_semi").mapInArrow(pack, "doc_id long, n long, key1 long, key2 long, hashes binary, profile binary").where("n > 0")
    return rows.groupBy("doc_id").agg(F.min(F.struct("n", "key1", "key2", "hashes", "profile")).alias("s")).select("doc_id", "s.n", "s.hashes", "s.profile")


def counted(rows: DataFrame) -> DataFrame:
    """Rows of regions with several documents, n of them."""
    several = rows.groupBy("region").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(several, "region")


def region_key(depth: int) -> Column:
    return F.xxhash64("tree", F.substring("signature", F.col("tree") * (2 * DEPTH) + 1, F.lit(2 * depth)))


def region_rows(reps: DataFrame, rows: DataFrame, shingle: int, keep: Keep) -> tuple[DataFrame, DataFrame]:
    """(region, tree, doc_id, n): the places of documents (doc_id, signature) in regions with several, n of them; and the documents with
    the signature of all their trees. rows: their texts."""
    trees = reps.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))))
    members = keep(counted(trees.select(region_key(LEAST_DEPTH).alias("region"), "tree", "doc_id")), "members")
    crowded = members.where(F.col("n") > DENSE).select("doc_id").distinct()
    if crowded.isEmpty():
        return members, reps
    crowded = keep(crowded, "crowded")
    for depth in range(LEAST_DEPTH + 1, DEPTH + 1):
        dense = members.where(F.col("n") > DENSE)
        if dense.isEmpty():
            break
        deeper = counted(dense.select("tree", "doc_id").join(reps, "doc_id").select(region_key(depth).alias("region"), "tree", "doc_id"))
        members = keep(members.where(F.col("n") <= DENSE).unionByName(deeper), "members")
    own = features(rows.join(crowded, "doc_id", "left_semi"), shingle, MORE_FACTORS).where("signature IS NOT NULL")
    least = F.min(F.struct("n_shingles", "key1", "key2", "signature")).alias("s")  # of several texts of one id the one that is compared
    more = own.groupBy("doc_id").agg(least).select("doc_id", F.col("s.signature").alias("further"))
    every = keep(reps.join(more, "doc_id", "left").select("doc_id", F.concat("signature", F.coalesce("further", F.lit(b""))).alias("signature")), "signatures")
    trees = every.join(crowded, "doc_id", "left_semi").withColumn("tree", F.explode(F.sequence(F.lit(TREES), F.lit(TREES + MORE_TREES - 1))))
    return keep(members.unionByName(counted(trees.select(region_key(DEPTH).alias("region"), "tree", "doc_id"))), "members"), every


class Rows:
    """Rows of several groups in order, with what bounds their sets' intersections."""

    def __init__(self, frame: pd.DataFrame, keys: Sequence[str]):
        self.ids, self.sizes, self.components = (frame[c].to_numpy(np.int64) for c in ("doc_id", "n", "component"))
        columns = frame[list(keys)]
        self.group = np.cumsum((columns != columns.shift()).any(axis=1).to_numpy()) - 1
        profiles = frame["profile"].tolist()
        self.wide = {i: cells_of(p) for i, p in enumerate(profiles) if 2 * len(p) > WIDTH}
        raw = np.frombuffer(b"".join(bytes(WIDTH // 2) if i in self.wide else p for i, p in enumerate(profiles)), np.uint8).reshape(len(frame), -1)
        self.fine = np.stack([raw >> 4, raw & 15], axis=2).reshape(len(frame), WIDTH)
        for i, cells in self.wide.items():
            self.fine[i] = np.minimum(folded(cells, WIDTH), 255)
        self.coarse = self.fine.reshape(len(frame), COARSE, -1).sum(2, dtype=np.uint16 if self.wide else np.uint8)
        self.rest = self.sizes - self.fine.sum(1, dtype=np.int64)

    def most(self, i: int, j: int) -> int:
        """What two rows with wide profiles share at most."""
        a, b = self.wide[i], self.wide[j]
        width = min(len(a), len(b))
        rest = min(self.sizes[i] - int(a.sum(dtype=np.int64)), self.sizes[j] - int(b.sum(dtype=np.int64)))
        return int(np.minimum(folded(a, width), folded(b, width)).sum(dtype=np.int64)) + rest

    def pairs(self, percent: int, reach: int, apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, similarity at most) of rows of one group and different components up to `reach` places apart that the profiles don't rule out.
        apart: only rows of different blocks, where it isn't -1, count."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        largest = int(np.bincount(self.group).max()) if len(self.group) else 0
        for shift in range(1, min(reach, largest - 1) + 1):
            i = np.flatnonzero((self.group[shift:] == self.group[:-shift]) & (self.components[shift:] != self.components[:-shift]))
            j = i + shift
            use = 100 * np.minimum(self.sizes[i], self.sizes[j]) >= percent * np.maximum(self.sizes[i], self.sizes[j])
            if apart is not None:
                use &= (apart[i] < 0) | (apart[i] != apart[j])
            i, j = i[use], j[use]
            for cells in (self.coarse, self.fine):
                most = np.minimum(cells[i], cells[j]).sum(1, dtype=np.int64) + np.minimum(self.rest[i], self.rest[j])
                both = self.sizes[i] + self.sizes[j]
                use = (100 + percent) * most >= percent * both
                i, j, most, both = i[use], j[use], most[use], both[use]
            if self.wide and len(i):
                closer = [self.most(a, b) if a in self.wide and b in self.wide else m for a, b, m in zip(i.tolist(), j.tolist(), most.tolist(), strict=True)]
                most = np.minimum(most, closer)
                use = (100 + percent) * most >= percent * both
                i, j, most, both = i[use], j[use], most[use], both[use]
            out.append((i, j, most / np.maximum(both - most, 1)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def nearest(placed: DataFrame, percent: int, reach: int) -> DataFrame:
    """(a, b): for each document the most promising of its neighbours in all orders (region, label, doc_id, n, component, profile)."""
    ordered = placed.repartitionByRange("region", "label", "doc_id").sortWithinPartitions("region", "label", "doc_id")

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            held = frame.tail(reach)
            rows = Rows(frame, ["region"])
            i, j, alike = rows.pairs(percent, reach)
            ends = pd.DataFrame({"doc": rows.ids[np.append(i, j)], "other": rows.ids[np.append(j, i)], "alike": np.append(alike, alike)})
            yield ends.sort_values("alike").drop_duplicates("doc", keep="last")

    found = ordered.mapInPandas(look, "doc long, other long, alike double")
    best = found.groupBy("doc").agg(F.max(F.struct("alike", "other")).alias("b"))
    return best.select(F.least("doc", "b.other").alias("a"), F.greatest("doc", "b.other").alias("b")).distinct()


def rest_of_regions(placed: DataFrame, percent: int, keep: Keep) -> DataFrame:
    """(a, b): every two documents of a region and different components that the profiles don't rule out.

    A region up to BLOCK rows is one group. In a larger one the rows of its
    most frequent component aren't compared with each other: blocks of the
    other rows are compared with all blocks, each two in a group of their own.
    """
    each = placed.groupBy("region", "component").agg(F.count(F.lit(1)).alias("m"))
    mixed = each.groupBy("region").agg(F.sum("m").alias("size"), F.max(F.struct("m", "component")).alias("top")).where("top.m < size")
    rows = placed.join(mixed, "region").withColumn("minor", F.col("component") != F.col("top.component"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    less, more, whole = blocks(F.col("size") - F.col("top.m")), blocks(F.col("top.m")), F.col("size") <= BLOCK
    spot = lambda n: F.pmod(F.xxhash64("doc_id"), n).cast("int")
    block = F.when(whole, 0).when(F.col("minor"), spot(less)).otherwise(less + spot(more))
    last = F.when(whole, 0).when(F.col("minor"), less + more - 1).otherwise(less - 1)
    dealt = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    dealt = dealt.select("region", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "doc_id", "n", "component", "profile")
    keys = ["region", "x", "y"]
    ordered = keep(dealt, "dealt").repartitionByRange(*keys).sortWithinPartitions(*keys)

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            last = (frame[keys] == frame[keys].iloc[-1]).all(axis=1)  # a group may go on in the next frame; it has two blocks at most
            held = frame[last]
            yield compare(frame[~last])
        if held is not None:
            yield compare(held)

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        if len(frame) < 2:
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        rows = Rows(frame, keys)
        apart = np.where(frame["x"] == frame["y"], -1, frame["block"]).astype(np.int64)
        i, j, _ = rows.pairs(percent, len(frame), apart)
        return pd.DataFrame({"a": np.minimum(rows.ids[i], rows.ids[j]), "b": np.maximum(rows.ids[i], rows.ids[j])}).drop_duplicates()

    return ordered.mapInPandas(look, "a long, b long").distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets (doc_id, hashes) are similar enough."""
    left = pairs.select("a", "b").join(sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("left")), "a")
    both = left.join(sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("right")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, left, right = (batch.column(n) for n in ("a", "b", "left", "right"))
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = unpacked(left[i].as_py()), unpacked(right[i].as_py())
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(keep)), b.filter(pa.array(keep))], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable over links) and kept, a row for each row of docs.

    Documents without words have an empty set and are linked with nothing.
    Rows of one id are one document: that with the least keys of their sets is
    compared, all share its component. A row with a null id links with nothing,
    has a null component and is kept. No rows, no rows. The result is a table in
    the shared folder; what else was written there is removed.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    key = ["n_shingles", "key1", "key2"]
    with scratch(docs.sparkSession, "near-duplicates") as keep:
        found = keep(features(rows, shingle), "features")
        sound = found.where("doc_id IS NOT NULL AND signature IS NOT NULL")
        named = sound.groupBy("doc_id").agg(F.min(F.struct(*key)).alias("k")).select("doc_id", "k.*")
        classes = keep(named.groupBy(*key).agg(F.min("doc_id").alias("rep")), "classes")
        one = sound.join(classes.withColumnRenamed("rep", "doc_id"), [*key, "doc_id"]).dropDuplicates(["doc_id"])
        reps = keep(one.select("doc_id", "signature"), "reps")
        members, signed = region_rows(reps, rows, shingle, keep)
        wanted = keep(members.select("doc_id").distinct(), "wanted")
        sets = keep(full_sets(rows, wanted, shingle), "sets")
        cards = keep(signed.join(sets.select("doc_id", "n", "profile"), "doc_id"), "cards")

        def placed(groups: DataFrame | None) -> DataFrame:
            own = cards.withColumn("component", F.col("doc_id")) if groups is None else cards.join(groups, F.col("doc_id") == F.col("node"), "left").withColumn("component", F.coalesce("label", "doc_id"))
            label = F.substring("signature", F.col("tree") * (2 * DEPTH) + 1, F.lit(2 * DEPTH))
            return members.select("region", "tree", "doc_id").join(own, "doc_id").select("region", label.alias("label"), "doc_id", own["n"], "component", "profile")

        groups: DataFrame | None = None
        for reach in (*REACH, None):
            here = keep(placed(groups), "placed")
            pairs = keep(nearest(here, percent, reach) if reach else rest_of_regions(here, percent, keep), "pairs")
            links = keep(confirmed(pairs, sets, percent), "links")
            if groups is None or not links.isEmpty():
                groups = components(links, keep) if groups is None else merged(groups, links, keep)
        known = named.join(classes, key).join(groups, F.col("rep") == F.col("node"), "left").select("doc_id", F.coalesce("label", "rep").alias("component"))
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
        result = found.select("doc_id", "n_shingles").join(known, "doc_id", "left").select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
        return save(result, "components")


def op8_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op8_lsh_forest": op8_lsh_forest}
