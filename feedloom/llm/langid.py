"""Language ID by error-correcting output codes.

Each language has a codeword; one binary n-gram classifier per bit tells the
languages with a 1 from those with a 0. The nearest codeword wins, where a
bit's loss counts with its reliability on the training rows, and a document
whose two nearest codewords are about as near is flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import product
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table, text_batches

#: The classifiers are fitted on about this many labelled rows of each language, chosen by a hash, or on all if there are fewer; more labels than MOST_LANGS are an error.
TRAIN_ROWS, MOST_LANGS = 3000, 500
#: n-grams of bytes, hashed into this many buckets for each n.
GRAMS, BUCKETS = (2, 3), 1 << 16
SMOOTHING, SHARPNESS = 0.5, 12.0
#: Ambiguous: the nearest codeword's share of the score is below this.
CLEAR = 0.6
UND = "und"
FOLD = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n codewords of -1 and 1: the exhaustive code up to 6 languages, else the random code with the largest least distance out of 50."""
    if n < 2:
        return np.ones((n, 1), np.int8)
    if n <= 6:
        bits = [b for b in product((-1, 1), repeat=n) if b[0] == 1 and -1 in b]
        return np.array(bits, np.int8).T
    rng, best, least = np.random.default_rng(seed), np.zeros(0), -1
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.int8), (n, int(np.ceil(10 * np.log2(n)))))
        code = code[:, np.abs(code.sum(0)) < n]
        gap = ((len(code[0]) - code.astype(int) @ code.T.astype(int)) // 2 + np.eye(n, dtype=int) * 10**6).min()
        if gap > least:
            best, least = code, gap
    return best


def fold(text: str) -> bytes:
    """Lower case, with anything that isn't a letter or beyond ASCII as one space."""
    return b" " + b" ".join(text.lower().encode().translate(FOLD).split()) + b" "


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def features(texts: Sequence[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each n the bucket of every n-gram (BUCKETS for those that cross a text's end), and where each text starts."""
    raws = [fold(t) for t in texts]
    data = np.frombuffer(b"".join(raws) + b"  ", np.uint8).astype(np.uint32)
    lengths = np.fromiter(map(len, raws), np.int64, len(raws))
    ends = np.cumsum(lengths)
    total, out = int(ends[-1]), []
    key = data[:total].copy()
    for n in range(2, max(GRAMS) + 1):
        key = (key << np.uint32(8)) | data[n - 1 : total + n - 1]
        if n in GRAMS:
            bucket = ((key * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int32)
            for k in range(1, n):
                bucket[np.maximum(ends - k, ends - lengths)] = BUCKETS
            out.append(bucket)
    return out, ends - lengths


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # n-gram sizes x bits x (BUCKETS + 1)
    reliability: np.ndarray  # of each bit

    def margins(self, texts: Sequence[str]) -> np.ndarray:
        """texts x bits: the mean log-odds of a text's n-grams."""
        buckets, starts = features(texts)
        out = np.zeros((len(texts), self.code.shape[1]))
        counts = np.add.reduceat((buckets[0] != BUCKETS).astype(np.int64), starts)
        for gram, bucket in enumerate(buckets):
            for bit in range(out.shape[1]):
                out[:, bit] += np.add.reduceat(self.weights[gram, bit][bucket].astype(np.float64), starts)
        return out / np.maximum(counts, 1)[:, None] / len(GRAMS)

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest codeword of each row and its share: exp(-loss) over all languages."""
        loss = np.zeros((len(margins), len(self.langs)))
        for k in range(len(self.langs)):
            loss[:, k] = (np.logaddexp(0, -SHARPNESS * margins * self.code[k]) * self.reliability).sum(1)
        share = np.exp(loss.min(1)[:, None] - loss)
        share /= share.sum(1)[:, None]
        best = loss.argmin(1)
        return best, share[np.arange(len(best)), best]


def held_out(doc_id: Column) -> Column:
    """Rows that take no part in learning; a null id isn't one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", rows: int = TRAIN_ROWS) -> Model:
    """Fits on rows with a language and a letter. Each language weighs the same; without any there are no languages.

    Of each language about `rows` rows are used, chosen by a hash of id and text, the bound of what is learned from.
    More than MOST_LANGS labels raise an error: the model goes to all tasks.
    """
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    found = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGS + 1).collect()
    if len(found) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages among the labels")
    counts = {r["lang"]: r["n"] for r in found}
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros((0, 1), np.int8), np.zeros((len(GRAMS), 1, BUCKETS + 1), np.float32), np.ones(1))
    share = F.element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, rows / counts[k]))]), F.col("lang"))
    # the whole table is read by as many tasks as it has splits; only the sample moves to fewer
    sample = labelled.where(F.pmod(F.xxhash64("id", "text", F.lit(1)), F.lit(1_000_000)) < share * 1_000_000).select("text", "lang").repartition(16)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in text_batches(batches, "text", 1_000_000):
            pairs = [(t, k) for t, k in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True) if has_letter(t)]
            for lang in {k for _, k in pairs}:
                buckets, _ = features([t for t, k in pairs if k == lang])
                found = np.stack([np.bincount(b, minlength=BUCKETS + 1)[:BUCKETS] for b in buckets])
                sums[lang] = sums.get(lang, 0) + found
        yield pa.RecordBatch.from_pydict({"lang": list(sums), "counts": [v.astype("<i8").tobytes() for v in sums.values()]}, pa.schema([("lang", pa.string()), ("counts", pa.binary())]))

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x, "<i8") for x in frame["counts"]], axis=0)
        return pd.DataFrame({"lang": frame["lang"].head(1), "counts": [total.astype("<i8").tobytes()]})

    totals = np.zeros((len(langs), len(GRAMS), BUCKETS))
    summed = sample.mapInArrow(count, "lang string, counts binary").groupBy("lang").applyInPandas(add, "lang string, counts binary")
    for row in summed.toLocalIterator():  # a row for each language
        totals[langs.index(row["lang"])] = np.frombuffer(row["counts"], "<i8").reshape(len(GRAMS), BUCKETS)
    return fit(langs, totals)


def fit(langs: list[str], totals: np.ndarray) -> Model:
    """The bits' weights from each language's n-gram counts (languages x n-gram sizes x BUCKETS)."""
    code = codewords(len(langs))
    rates = totals / np.maximum(totals.sum(2, keepdims=True), 1)
    floor = SMOOTHING / np.maximum(totals.sum(2, keepdims=True).max(0), 1)
    weights = np.zeros((len(GRAMS), code.shape[1], BUCKETS + 1), np.float32)
    reliability = np.ones(code.shape[1])
    for bit in range(code.shape[1]):
        one, zero = code[:, bit] == 1, code[:, bit] == -1
        if zero.any():
            w = np.log(rates[one].mean(0) + floor) - np.log(rates[zero].mean(0) + floor)
            weights[:, bit, :BUCKETS] = w
            expected = (rates * w).sum((1, 2)) / len(GRAMS) * code[:, bit]
            reliability[bit] = max(float(expected.min()), 1e-3)
    return Model(langs, code, weights, reliability / reliability.mean())


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds lang_pred, score (0 to 1) and ambiguous to docs; replaces columns of these names.

    `und` with score 0, not ambiguous, where the text is null, empty or has no
    letter, or nothing was learned. Rows are judged one by one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded: languages' bits x BUCKETS
    base = docs.drop("lang_pred", "score", "ambiguous")
    schema = base.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("ambiguous")).schema

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = sent.value
        for batch in text_batches(batches, text_col, 1_000_000):
            texts = batch.column(text_col).to_pylist()
            use = [i for i, t in enumerate(texts) if model.langs and has_letter(t)]
            langs: list[str] = [UND] * len(texts)
            scores = np.zeros(len(texts))
            if use:
                best, share = model.decode(model.margins([texts[i] for i in use]))
                scores[use] = share
                for i, k in zip(use, best.tolist(), strict=True):
                    langs[i] = model.langs[k]
            unclear = (scores > 0) & (scores < CLEAR)
            columns: list[Any] = [*batch.columns, pa.array(langs), pa.array(scores), pa.array(unclear)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "lang_pred", "score", "ambiguous"])

    return base.mapInArrow(predict, schema)


def op10_output_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


QUERIES = {"op10_output_codes": op10_output_codes}
