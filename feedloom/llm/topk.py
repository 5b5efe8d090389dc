"""Exact top-k inner products by three-phase uniform thresholds.

A vector's score is the sum of its scores in a few lists, one for each block of
dimensions. Phase one gathers each list's k best entries, its best and its least
score; the k-th best sum that these prove is a safe cutoff. Phase two broadcasts
it with its uniform share: a vector below the share in every list can't reach
the cutoff. A list is only scored for vectors that, by their scores in the lists
before and the best of those to come, still can; what is left after all lists
are the entries at or above the share of at least one. Phase three takes the
sums of these survivors, a task's k best of each query leave it. Queries go
through in blocks of a bounded number, each against all rows, and rows are
never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import save, table

K, LISTS, SCALE = 10, 4, 1024
#: Queries in a block (sent to all tasks) and in a matrix product.
BLOCK, TILE = 2048, 256
ROWS = 4096


#: Sums below this are exact in doubles; larger ones are taken in 64-bit integers.
EXACT = 2**53


class Queries(NamedTuple):
    ids: np.ndarray
    vectors: np.ndarray  # float64 with integer values


class Cutoffs(NamedTuple):
    """For each query and list the least and best score, for each query the score that its k best reach at least."""

    least: np.ndarray
    most: np.ndarray
    bound: np.ndarray


def scaled(column: pa.Array, scale: int) -> list[np.ndarray | None]:
    """floor(scale * x) of each vector; None for null vectors and those with a null or non-finite component."""
    out: list[np.ndarray | None] = []
    for v in column:
        x = None if v.as_py() is None else np.array(v.as_py(), np.float64)
        out.append(np.floor(scale * x) if x is not None and len(x) and np.isfinite(x).all() else None)
    return out


def vectors_of(batch: pa.RecordBatch, scale: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scaled vectors of the rows that take part, in id order."""
    ids, column = batch.column(0), batch.column(1)
    whole = column.null_count == 0 and ids.null_count == 0
    flat = column.flatten()
    lengths = np.diff(column.offsets.to_numpy())
    if whole and flat.null_count == 0 and (lengths == size).all():
        found = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
        keep = np.isfinite(found).all(1)
        numbers, found = ids.to_numpy()[keep], np.floor(scale * found[keep])
    else:
        pairs = [(i, v) for i, v in zip(ids.to_pylist(), scaled(column, scale), strict=True) if i is not None and v is not None and len(v) == size]
        numbers, found = np.array([i for i, _ in pairs], np.int64), np.array([v for _, v in pairs]).reshape(-1, size)
    order = np.argsort(numbers, kind="stable")
    return numbers[order], found[order]


def best(scores: np.ndarray, use: np.ndarray, k: int) -> np.ndarray:
    """A mask of the k largest scores in use of each row, the first ones among equals."""
    lowest = -np.inf if scores.dtype.kind == "f" else np.iinfo(scores.dtype).min
    scores = np.where(use, scores, lowest)
    if scores.shape[1] <= k:
        return use
    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k : scores.shape[1] - k + 1]
    above, equal = (scores > least) & use, (scores == least) & use
    return above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(1, keepdims=True)))


def spans(size: int, lists: int) -> list[slice]:
    edges = np.linspace(0, size, min(lists, size) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def largest(x: np.ndarray) -> float:
    return float(np.abs(x).max()) if x.size else 0.0


def tiles(batches: Iterator[pa.RecordBatch], queries: Queries, scale: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, bool]]:
    """(first query, ids, vectors, whether it is the query's own row, whether doubles are exact) for parts of the product that fit in memory."""
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            ids, vectors = vectors_of(batch.slice(a, ROWS), scale, queries.vectors.shape[1])
            top = largest(vectors) * largest(queries.vectors) * vectors.shape[1]
            if top >= 2**63:
                raise OverflowError("scores beyond 2**63 aren't longs")
            for q in range(0, len(queries.ids), TILE) if len(ids) else ():
                yield q, ids, vectors, queries.ids[q : q + TILE, None] == ids[None, :], top < EXACT


class Kept:
    """The k best (score, id) of each query so far."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.ids = k, [np.zeros(0, np.int64)] * n, [np.zeros(0, np.int64)] * n

    def add(self, first: int, ids: np.ndarray, scores: np.ndarray, use: np.ndarray) -> None:
        chosen = best(scores, use, self.k)
        for row in np.flatnonzero(chosen.any(1)):
            at = first + row
            s, i = np.append(self.scores[at], scores[row, chosen[row]].astype(np.int64)), np.append(self.ids[at], ids[chosen[row]])
            order = np.lexsort((i, -s))[: self.k]
            self.scores[at], self.ids[at] = s[order], i[order]

    def rows(self, query_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = [len(s) for s in self.scores]
        return np.repeat(query_ids, n), np.concatenate([*self.ids, np.zeros(0, np.int64)]), np.concatenate([*self.scores, np.zeros(0, np.int64)])


def top_k(candidates: DataFrame, queries: DataFrame, k: int = K, lists: int = LISTS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best candidates, ties to smaller ids, all if there are fewer.

    A candidate with the query's id is the query itself. Null vectors, vectors
    with null or non-finite components, empty vectors and null ids take no
    part; vectors of another length than the query's aren't compared with it.
    Repeated candidate rows count as often as they occur; of query rows with
    one id the smallest vector stands. Scores that may exceed 2**63, and so a
    long, raise an error.
    """
    rows = candidates.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    sound = queries.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    sound = sound.where(F.col("vec_id").isNotNull() & (F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    found: DataFrame | None = None
    last: int | None = None
    while True:
        page = sound if last is None else sound.where(F.col("vec_id") > last)
        taken = page.groupBy("vec_id").agg(F.min("vector").alias("vector")).orderBy("vec_id").limit(block).collect()
        for size in sorted({len(r["vector"]) for r in taken}):
            own = [r for r in taken if len(r["vector"]) == size]
            part = Queries(np.array([r["vec_id"] for r in own], np.int64), np.floor(scale * np.array([r["vector"] for r in own], np.float64)))
            result = one_block(rows, part, k, lists, scale)
            found = result if found is None else found.unionByName(result)
        if len(taken) < block:
            break
        last = taken[-1]["vec_id"]
    if found is None:
        return candidates.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return found


def one_block(rows: DataFrame, queries: Queries, k: int, lists: int, scale: int) -> DataFrame:
    context = rows.sparkSession.sparkContext
    sent = context.broadcast(queries)
    parts = spans(queries.vectors.shape[1], lists)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Phase one: each list's k best entries, by row (repeated ids are rows of their own), its best and its least score.

        Tiles with scores beyond EXACT tell nothing and are resolved in full."""
        q = sent.value
        row = (TaskContext.get().partitionId() << 40) - 1
        kept = [Kept(len(q.ids), k) for _ in parts]
        least, most = np.full((len(parts), len(q.ids)), np.inf), np.full((len(parts), len(q.ids)), -np.inf)
        for first, ids, vectors, itself, exact in tiles(batches, q, scale):
            if first == 0:
                keys = np.arange(row + 1, row + 1 + len(ids))
                row += len(ids)
            here = slice(first, first + TILE)
            for n, part in enumerate(parts) if exact else ():
                scores = q.vectors[here, part] @ vectors[:, part].T
                np.minimum(least[n, here], np.where(itself, np.inf, scores).min(1), out=least[n, here])
                np.maximum(most[n, here], np.where(itself, -np.inf, scores).max(1), out=most[n, here])
                kept[n].add(first, keys, scores, ~itself)
        for n, some in enumerate(kept):
            query, found, score = some.rows(q.ids)
            use = np.isfinite(least[n])
            kinds = np.repeat(["entry", "least", "most"], [len(query), use.sum(), use.sum()])
            none = np.full(2 * use.sum(), -1)
            yield pa.RecordBatch.from_pydict({
                "query_id": np.concatenate([query, q.ids[use], q.ids[use]]), "list": np.full(len(kinds), n, np.int32), "row": np.append(found, none),
                "score": np.concatenate([score, least[n][use].astype(np.int64), most[n][use].astype(np.int64)]), "kind": kinds,
            })

    lists_of = save(rows.mapInArrow(gather, "query_id long, list int, row long, score long, kind string"), "lists")
    edges = lists_of.groupBy("query_id", "list").agg(F.min(F.when(F.col("kind") == "least", F.col("score"))).alias("least"), F.max(F.when(F.col("kind") == "most", F.col("score"))).alias("most"))
    in_list = Window.partitionBy("query_id", "list").orderBy(F.desc("score"), "row")
    heads = lists_of.where("kind = 'entry'").withColumn("n", F.row_number().over(in_list)).where(F.col("n") <= k)
    above = heads.join(edges, ["query_id", "list"]).groupBy("query_id", "row").agg(F.sum(F.col("score") - F.col("least")).alias("above"))
    in_query = Window.partitionBy("query_id").orderBy(F.desc("above"))
    proven = above.withColumn("n", F.row_number().over(in_query)).where(F.col("n") == k).select("query_id", "above")
    cutoffs = Cutoffs(np.zeros((len(parts), len(queries.ids))), np.full((len(parts), len(queries.ids)), np.inf), np.full(len(queries.ids), -np.inf))
    at = {q: i for i, q in enumerate(queries.ids.tolist())}
    for r in edges.join(proven, "query_id", "left").collect():  # a row for each list and query of the block
        i = at[r["query_id"]]
        cutoffs.least[r["list"], i], cutoffs.most[r["list"], i] = r["least"], r["most"]
        cutoffs.bound[i] = -np.inf if r["above"] is None else r["above"]
    cutoffs = cutoffs._replace(bound=cutoffs.bound + cutoffs.least.sum(0))
    safe = context.broadcast(cutoffs)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Phases two and three on the vectors of this task."""
        q, cut = sent.value, safe.value
        kept = Kept(len(q.ids), k)
        for first, ids, vectors, itself, exact in tiles(batches, q, scale):
            here = slice(first, first + TILE)
            if not exact:
                kept.add(first, ids, q.vectors[here].astype(np.int64) @ vectors.astype(np.int64).T, ~itself)
                continue
            base, own = cut.least[:, here].sum(0), [s[k - 1] if len(s) == k else -np.inf for s in kept.scores[here]]
            bound = np.maximum(cut.bound[here], own)
            share = np.floor((bound - base) / len(parts))
            left, total = np.arange(len(ids)), np.zeros(itself.shape)
            seen = np.zeros(itself.shape, bool)
            for n, part in enumerate(parts):
                scores = q.vectors[here, part] @ vectors[left, part].T
                total += scores
                seen |= scores - cut.least[n, here, None] >= share[:, None]
                can = total + cut.most[n + 1 :, here].sum(0)[:, None] >= bound[:, None]
                keep = (can & ~itself[:, left]).any(0)
                if not keep.all():
                    left, total, seen, can = left[keep], total[:, keep], seen[:, keep], can[:, keep]
            kept.add(first, ids[left], total, can & seen & ~itself[:, left])
        query, vec, score = kept.rows(q.ids)
        yield pa.RecordBatch.from_pydict({"query_id": query, "vec_id": vec, "score": score})

    resolved = rows.mapInArrow(resolve, "query_id long, vec_id long, score long")
    ranks = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return resolved.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_uniform_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where("vec_id % 100 = 0"))


QUERIES = {"op1_uniform_threshold": op1_uniform_threshold}
ORACLE_SQL = {
    "op1_uniform_threshold": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10"""
}
