"""The exact token count of every prefix of a text, by dynamic programming over byte-level BPE.

The last token of a prefix is the one token that ends it and may follow the
last token of what stands before, where "may follow" says that the vocabulary
encodes the two, joined, as these two. So one pass over a run of characters
gives the count of each of its prefixes. Runs are those of the vocabulary's own
cutter; two of its rules look ahead, and the counts of the prefixes that end
there are set right: within 're, 've and 'll, and after white space of several
characters, which is one run only while nothing follows.

A store has a row per document with the counts of all its prefixes, in
characters, as compressed steps. What a truncated text would count, and how
much of a text fits a budget, is read from it without encoding again.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise
from operator import sub

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .shared import save, table, text_batches
from .tokens import LETTER_OF, RUNS, SURE, Known, WordEncoder, unsure

LIMIT = 1024
#: Words, runs and pairs of tokens kept by a worker, and the characters of words; at a limit a cache starts anew.
CACHE_WORDS, CACHE_CHARS, CACHE_PAIRS = 250_000, 8_000_000, 1_000_000
#: Texts are worked on about so many characters at a time, cut at spaces where the vocabulary cuts in any case.
SLICE_CHARS = 200_000
SPACE = re.compile(r"(?<=\S) (?=\S)")
#: The characters that count as white space in the vocabulary's pattern.
WHITE = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
#: Contractions of three characters, of which two are no run yet.
SHORTENED = ("'re", "'ve", "'ll")
STEPS = [struct.Struct(f"<{n}h").pack for n in range(64)]


class PrefixCounter:
    """The steps of the token count, a little-endian int16 for each character of a text. Only byte-level BPE whose added tokens are plain."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        base = WordEncoder(path)
        self.tokenizer = base.tokenizer
        plain = all(not (t.lstrip or t.rstrip or t.single_word or t.normalized) for t in self.tokenizer.get_added_tokens_decoder().values())
        if base.kind != "bytes" or not plain:
            raise ValueError(f"{path}: prefixes are counted for byte-level BPE with plain added tokens")
        self.added = re.compile("|".join(re.escape(t) for t in sorted(base.added, key=len, reverse=True))) if base.added else None
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.names = {i: name for name, i in vocabulary.items()}
        self.ending = ahocorasick.Automaton()
        for name, i in vocabulary.items():
            self.ending.add_word(name, (len(name) - 1, i))
        self.ending.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.words, self.runs, self.held = Known(self._word), Known(self._run), 0

    def _fits(self, before: int, token: int) -> bool:
        """Whether a token may follow another (or, after -1, begin a run)."""
        want = [token] if before < 0 else [before, token]
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        fits = self.pairs[before << 20 | token] = [t.id for t in self.tokenizer.model.tokenize("".join(self.names[t] for t in want))] == want
        return fits

    def counts(self, letters: str) -> list[int]:
        """Of a run in the vocabulary's letters: the count of each prefix, from the empty one on."""
        known = self.pairs.get
        lasts, out, done = [-1], [0], -1
        for stop, (length, token) in self.ending.iter(letters):  # the tokens that end here, the longest first
            if stop == done:
                continue
            start = stop - length
            before = lasts[start]
            fits = known(before << 20 | token)
            if fits or fits is None and self._fits(before, token):
                lasts.append(token)
                out.append(out[start] + 1)
                done = stop
        if len(out) <= len(letters):
            raise ValueError("a byte without a token")
        return out

    def _run(self, run: str) -> bytes:
        self.held += len(run)
        if run.isascii():
            counts = self.counts(run.replace(" ", LETTER_OF[0x20]) if run.isprintable() else run.translate(LETTER_OF))
            if run in SHORTENED:
                counts[2] = 2
        else:
            every, counts, place = self.counts(run.encode().decode("latin-1").translate(LETTER_OF)), [0], 0
            for c in run:
                place += 1 if c < "\x80" else len(c.encode())
                counts.append(every[place])
        return STEPS[len(run)](*map(sub, counts[1:], counts)) if len(run) < len(STEPS) else np.diff(counts).astype("<i2").tobytes()

    def _runs(self, runs: list[str]) -> bytes:
        steps = [self.runs[run] for run in runs]
        joined = b"".join(steps)
        places = [i for i, (run, then) in enumerate(pairwise(runs)) if run[0] in WHITE and then[0] in WHITE and WHITE.issuperset(run)]
        if not places:
            return joined
        out, starts = np.frombuffer(joined, "<i2").copy(), np.cumsum([0, *map(len, runs)])
        for i in places:  # white space up to here is one run, as long as nothing follows
            at = starts[i + 1]
            longer = int(np.frombuffer(self.runs[runs[i] + runs[i + 1][0]], "<i2").sum()) - int(out[starts[i] : at + 1].sum())
            out[at] += longer
            if at + 1 < len(out):
                out[at + 1] -= longer
        return out.tobytes()

    def _cut(self, text: str) -> list[str]:
        return [text[start:stop] for _, (start, stop) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def _word(self, word: str) -> bytes:
        self.held += len(word)
        runs = RUNS["bytes"].findall(word) if SURE.fullmatch(word) else self._cut(word)
        return self.runs[word] if len(runs) == 1 else self._runs(runs)

    def _plain(self, text: str) -> Iterator[bytes]:
        """Steps of a text without added tokens."""
        start = 0
        while start < len(text):
            cut = SPACE.search(text, start + SLICE_CHARS) if len(text) - start > SLICE_CHARS else None
            stop = cut.start() if cut else len(text)
            part, start = text[start:stop], stop
            for known in (self.words, self.runs):
                if len(known) > CACHE_WORDS or self.held > CACHE_CHARS:
                    known.clear()
                    known[""] = b""
            self.held *= self.held <= CACHE_CHARS
            if unsure(part):
                yield self._runs(self._cut(part))
            else:
                head, *words = part.split(" ")
                yield self.words[head] + b"".join(map(self.words.__getitem__, map(" ".__add__, words)))

    def steps(self, text: str) -> bytes:
        """Text[:n] has sum(steps[:n]) tokens, for every n."""
        parts: list[bytes] = []
        start = 0
        for match in self.added.finditer(text) if self.added else ():
            whole = b"".join(self._plain(text[start : match.end() - 1]))  # inside an added token what is there is plain text still
            inside = 2 * (match.start() - start)
            late = int(np.frombuffer(whole[inside:], "<i2").sum(dtype=np.int64))
            parts += [whole, struct.pack("<h", 1 - late)]
            start = match.end()
        parts += self._plain(text[start:])
        return parts[0] if len(parts) == 1 else b"".join(parts)


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    """One for each file and Python worker."""
    return PrefixCounter(path)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_chars", pa.int64()), ("n_tokens", pa.int64()), ("steps", pa.binary())])


def count_prefixes(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, n_bytes (UTF-8), n_chars, n_tokens and steps, the counts of all prefixes.

    Null texts are empty, with no tokens. Null and repeated ids are rows like
    others, other columns play no part, an empty table has no rows. A text of
    any length is worked on in slices; its steps take two bytes a character
    before they are compressed.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, find = zstandard.ZstdCompressor(level=1), counter(vocabulary)
        for batch in text_batches(batches, "text"):
            texts = batch.column("text").to_pylist()
            steps = [find.steps(t) for t in texts]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
                pa.array([int(np.frombuffer(s, "<i2").sum(dtype=np.int64)) for s in steps], pa.int64()), pa.array([pack.compress(s) for s in steps], pa.binary()),
            ], schema=SCHEMA)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_chars long, n_tokens long, steps binary")


def unpacked(steps: bytes) -> np.ndarray:
    """The token count of each prefix, from the empty one on."""
    return np.concatenate(([0], np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(steps), "<i2"), dtype=np.int64)))


@F.pandas_udf(LongType())
def _count_at(steps: pd.Series, n_chars: pd.Series) -> pd.Series:
    held = ((unpacked(s), n) for s, n in zip(steps, n_chars, strict=True))
    return pd.Series([int(counts[min(max(int(n), 0), len(counts) - 1)]) for counts, n in held], dtype="int64")


@F.pandas_udf(LongType())
def _chars_within(steps: pd.Series, budget: pd.Series) -> pd.Series:
    return pd.Series([int(np.flatnonzero(unpacked(s) <= max(int(b), 0))[-1]) for s, b in zip(steps, budget, strict=True)], dtype="int64")


def count_at(steps: Column, n_chars: Column) -> Column:
    """How many tokens the first n_chars characters are (all, if there are fewer); nothing for null."""
    return F.when(steps.isNotNull() & n_chars.isNotNull(), _count_at(F.coalesce(steps, F.lit(EMPTY)), F.coalesce(n_chars.cast("long"), F.lit(0))))


def chars_within(steps: Column, budget: Column) -> Column:
    """The most characters from the start that are at most so many tokens; a negative budget is 0, null gives null."""
    return F.when(steps.isNotNull() & budget.isNotNull(), _chars_within(F.coalesce(steps, F.lit(EMPTY)), F.coalesce(budget.cast("long"), F.lit(0))))


EMPTY = zstandard.ZstdCompressor(level=1).compress(b"")


def op13_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adds fit_chars: how much of the text the limit leaves."""
    import public_tokenizers

    stored = save(count_prefixes(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")), "prefixes")
    over = F.col("n_tokens") > LIMIT
    fit = F.when(over, chars_within(F.when(over, F.col("steps")), F.lit(LIMIT))).otherwise(F.col("n_chars"))
    return stored.select("doc_id", "n_bytes", "n_tokens", over.alias("over_limit"), fit.alias("fit_chars"))


QUERIES = {"op13_prefix_counts": op13_prefix_counts}
