"""Counts of prefixes against the library, prefix by prefix."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from feedloom.llm import token_counts  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"w{i * i % 911}" for i in range(3000))
TEXTS = [None, "", " ", "don't they're we'll I've 'tis", "a\n\n\nb  c \n d\t", "x<|endoftext|>  <|endoftext|> y <|endof", "naïve Ärger ß 漢字 \U0001f600‍", LONG, "ab" * 2000, "don't they're we'll I've 'tis", "\x85\xa0　 a"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(PATH)
    return lambda texts: [len(e.ids) for e in fresh.encode_batch(texts, add_special_tokens=False)]


def random_texts(n, seed):
    rng = random.Random(seed)
    pools = [[chr(i) for i in range(32, 127)], [chr(i) for i in range(0x250)], list(" \n\t\xa0 \x85　a"), [chr(i) for i in range(0x370, 0x600)], list("'srtvemld l"), list("aeiou nth"), ["<|endoftext|>", " ", "\n", "a", "'ll", "'", "r", "e"], ["\U0001f600", "‍", "́", "İ", "ς"]]
    return ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(1, 40))) if i % 3 else "".join(rng.choices(rng.choice(pools), k=rng.randint(1, 60))) for i in range(n)]


@pytest.mark.parametrize("slice_chars", [5, 200_000])
def test_every_prefix_counts_as_the_library_does(library, monkeypatch, slice_chars):
    monkeypatch.setattr(token_counts, "SLICE_CHARS", slice_chars)
    monkeypatch.setattr(token_counts, "CACHE_WORDS", 50)
    find = token_counts.PrefixCounter(PATH)
    for text in random_texts(500, slice_chars) + [t for t in TEXTS if t and len(t) < 100]:
        got = np.concatenate(([0], np.cumsum(np.frombuffer(find.steps(text), "<i2")))).tolist()
        assert got == library([text[:n] for n in range(len(text) + 1)]), text


def test_one_very_long_run_and_a_very_long_text(library):
    find = token_counts.PrefixCounter(PATH)
    for text in ("x" * 100_000, "é" * 50_000, " " * 30_000 + "x", LONG * 30):
        steps = np.frombuffer(find.steps(text), "<i2")
        assert len(steps) == len(text)
        assert int(steps.sum(dtype=np.int64)) == library([text])[0]


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        token_counts.PrefixCounter(public_tokenizers.path("word_bpe_49k.json"))


def test_a_store_answers_for_any_prefix_and_budget(spark, library, tmp_path):
    rows = [(None if i == 3 else min(i, 9), t, "clash", 7) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, steps string, n_tokens int").repartition(3)
    token_counts.count_prefixes(docs, PATH).write.parquet(f"file://{tmp_path}/store")
    stored = spark.read.parquet(f"file://{tmp_path}/store")
    assert stored.columns == ["doc_id", "n_bytes", "n_chars", "n_tokens", "steps"]
    texts = [t or "" for t in TEXTS]
    want = sorted(zip([r[0] or -1 for r in rows], [len(t.encode()) for t in texts], [len(t) for t in texts], library(texts), strict=True))
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_chars, r.n_tokens) for r in stored.collect()) == want
    asked = stored.where("doc_id in (5, 7)").withColumn("n", F.explode(F.array(*[F.lit(n).cast("int") for n in (-1, 0, 1, 3, 9, 20, 100_000)], F.lit(None).cast("int"))))
    for r in asked.select("doc_id", "n", token_counts.count_at(F.col("steps"), F.col("n")).alias("tokens"), token_counts.chars_within(F.col("steps"), F.col("n")).alias("chars")).collect():
        text = TEXTS[r.doc_id]
        if r.n is None:
            assert r.tokens is None and r.chars is None
            continue
        assert r.tokens == library([text[: max(r.n, 0)]])[0]
        assert library([text[: r.chars]])[0] <= max(r.n, 0)
        assert r.chars == len(text) or all(library([text[:k] for k in range(r.chars + 1, min(r.chars + 40, len(text)) + 1)])[i] > r.n for i in range(min(39, len(text) - r.chars)))
    assert token_counts.count_prefixes(docs.where("doc_id < 0"), PATH).count() == 0


def test_the_query_has_the_contracts_columns(spark, library, tmp_path):
    spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in token_counts.op13_prefix_counts(spark, str(tmp_path)).collect():
        text = TEXTS[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), library([text])[0])
        assert r.over_limit == (r.n_tokens > 1024)
        assert r.fit_chars == len(text) if not r.over_limit else library([text[: r.fit_chars]])[0] <= 1024 < library([text[: r.fit_chars + 1]])[0]
