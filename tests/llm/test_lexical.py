"""Ranked search against a plain scoring of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from feedloom.llm import lexical, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k):
    """Sorted (item_id, rank, doc_id, score) of every row, by the formula alone."""
    held = [(d, Counter(terms_of(t))) for d, t in docs]
    n_docs, total = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for doc, counts in held:
            n = sum(counts.values())
            m = 25 + (75 * n * n_docs) // total if total else 25
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * counts[t] // (1000 * counts[t] + 8 * m)) for t in terms_of(text) if counts[t])
            if score:
                found.append((-score, doc is None, doc))
        out += [(item, i + 1, doc, -score) for i, (score, _, doc) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def random_docs(seed, n):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", *[f"w{i}" for i in range(60)], "é", "É", "漢字", "x1", "'", "a_b"]
    text = lambda: " ".join(rng.choice(vocabulary[: rng.choice([4, 20, 70])]) for _ in range(rng.choice([0, 1, 5, 40, 300])))
    docs = [(i, text()) for i in range(n)]
    docs += [(i, docs[i][1]) for i in range(0, n, 7)] + [(1000 + i, docs[3 * i][1]) for i in range(n // 9)]  # repeated rows and ties
    docs += [(None, docs[2][1] or "the of"), (None, None), (5000, None), (5001, ""), (5002, "..!? \n")]
    items = [(i, text()) for i in range(12)] + [(0, "the of w1 w1"), (50, None), (51, ""), (52, "nowhere seen"), (None, "the w2")]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_search_equals_scoring_every_document(spark, monkeypatch, seed):
    monkeypatch.setattr(lexical, "SEGMENT_BYTES", 3000)
    monkeypatch.setattr(lexical, "FILE_BYTES", 2000)
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 4)
    monkeypatch.setattr(lexical, "STEP", 1)
    docs, items = random_docs(seed, 80)
    d = spark.createDataFrame([(i, t, 1, "clash") for i, t in docs], "doc_id long, text string, score int, block string").repartition(3)
    q = spark.createDataFrame([(i, t, 1, "clash") for i, t in items], "item_id long, text string, rank int, number string").repartition(2)
    for k in (1, 10, 1000):
        got = lexical.search(lexical.build_index(d), q, k)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=str) == plain(docs, items, k)


def test_empty_tables_and_items_named_by_strings(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a")], "doc_id long, text string")
    items = spark.createDataFrame([("x", "A!"), ("y", None)], "name string, body string")
    index = lexical.build_index(docs)
    assert sorted((r.name, r.rank, r.doc_id) for r in lexical.search(index, items, item_col="name", text_col="body").withColumnRenamed("item_id", "name").collect()) == [("x", 1, 2), ("x", 2, 1)]
    assert lexical.search(index, items.where("false"), item_col="name", text_col="body").count() == 0
    assert lexical.search(lexical.build_index(docs.where("false")), items, item_col="name", text_col="body").count() == 0


def test_the_threshold_ends_a_search_before_the_lists_do():
    rng = random.Random(4)
    texts = ["alpha beta gamma"] + [f"alpha w{rng.randint(0, 50)} " * rng.randint(1, 9) for _ in range(3000)]
    segment = lexical.segment_of(np.arange(len(texts)), np.zeros(len(texts), bool), texts, len(texts), sum(len(t.split()) for t in texts))
    vocabulary = np.sort(words.words_of(["alpha beta gamma"], words.ALNUM).hashes)
    lists = lexical.Lists(segment, vocabulary)
    weights = np.array([lexical.weight(len(texts), int(n)) for n in lists.df])
    best, looked = lists.best(np.arange(3), weights, lexical.none_yet(), 1)
    assert best.ids.tolist() == [0] and looked < 50
    _, again = lists.best(np.arange(3), weights, lexical.Best(best.scores + 1, best.ids, best.nulls), 1)
    assert again <= looked


def test_lengths_beyond_64_bits_and_bad_files(spark, tmp_path):
    assert lexical.lengths(np.array([10**9]), 10**10, 10**12).tolist() == [25 + 75 * 10**9 * 10**10 // 10**12]
    assert lexical.lengths(np.array([0]), 0, 0).tolist() == [25]
    (tmp_path / "bad.lxi").write_bytes(b"not an index" * 20)
    with pytest.raises(lexical.LexicalIndexError):
        list(lexical.segments(f"file://{tmp_path}/bad.lxi", 1))
    index = lexical.build_index(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))
    path = index.manifest.first()["path"]
    with pytest.raises(lexical.LexicalIndexError):
        list(lexical.segments(path, 2))


@pytest.mark.parametrize("size", [1, 3, 7, 8_000_000])
def test_words_across_slices(monkeypatch, size):
    texts = [None, "", "Alpha beta-gamma é\n\tx", "y" * 40, " z "]
    want = [words.words_of([w], words.ALNUM).hashes[0] for t in texts for w in re.findall(r"[^\W_]+", t or "")]
    monkeypatch.setattr(words, "SLICE", size)
    got = words.words_of(texts, words.ALNUM)
    assert got.hashes.tolist() == want
    assert np.diff(got.bounds).tolist() == words.sizes_of(texts, words.ALNUM).tolist() == [0, 0, 5, 1, 1]
