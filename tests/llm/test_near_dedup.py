"""Dense regions and long documents: nothing is lost, and few pairs reach the full sets."""

import numpy as np
import pytest

from feedloom.llm import near_dedup


def sets_of(texts):
    words = [t.split() for t in texts]
    return [set(zip(w, w[1:], strict=False)) for w in words]


def components(texts):
    sets, label = sets_of(texts), list(range(len(texts)))
    links = [(i, j) for i in range(len(texts)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    for _ in range(8):
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    return label, links


def crowd():
    """One template: 150 documents about 0.7 similar, 20 of which have a partner at 0.802."""
    rng = np.random.default_rng(5)
    slots = rng.integers(0, 30, (150, 20))
    slots[100:120, :8] = slots[:20, :8]
    slots[100:120, 8:] = (slots[:20, 8:] + 1) % 30
    return [" ".join(" ".join(f"f{10 * j + k}" for k in range(10)) + f" s{j}v{v}" for j, v in enumerate(row)) for row in slots]


def test_a_dense_region_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "DENSE", 8)
    texts = crowd()
    want, links = components(texts)
    assert len(links) >= 20
    docs = spark.createDataFrame(list(enumerate(texts)) + [(7, "two words")], "doc_id long, text string").repartition(3)  # one id with two texts
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs.where("text <> 'two words'")).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert near_dedup.near_duplicates(docs).where("doc_id = 7").count() == 2


def test_long_documents_send_few_pairs_to_the_full_sets(spark, monkeypatch):
    """60 documents of 6000 words, every two of a similarity of 0.5 to 0.75, and two of them with a partner."""
    rng = np.random.default_rng(6)
    base = [f"b{i}" for i in range(6000)]
    texts = []
    for d in range(60):
        words = list(base)
        for start in rng.choice(300, 30 + d % 20, replace=False):
            words[20 * start : 20 * start + 20] = [f"d{d}w{start}x{k}" for k in range(20)]
        texts.append(" ".join(words))
    for d in (0, 31):
        texts.append(texts[d] + " " + " ".join(f"tail{d}n{k}" for k in range(500)))
    sets = sets_of(texts)
    alike = [len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in range(20) for j in range(i)]
    assert 0.5 < min(alike) and max(alike) < 0.8
    sent = []
    confirmed = near_dedup.confirmed

    def counting(pairs, *rest):
        sent.append(pairs.count())
        return confirmed(pairs, *rest)

    monkeypatch.setattr(near_dedup, "confirmed", counting)
    want, links = components(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want and len(links) >= 2
    assert sum(sent) < 100  # of 1891 pairs


@pytest.mark.parametrize("sizes", [(10, 700), (3000, 3000), (1500, 9000), (300_000, 280_000)])
def test_profiles_never_rule_out_what_is_shared(sizes):
    rng = np.random.default_rng(sum(sizes))
    common = rng.integers(0, 2**63, min(sizes) * 9 // 10, np.uint64)
    a, b = (np.unique(np.append(common, rng.integers(0, 2**63, n - len(common), np.uint64))) for n in sizes)
    import pandas as pd

    frame = pd.DataFrame({"doc_id": [1, 2], "n": [len(a), len(b)], "component": [1, 2], "region": [0, 0], "profile": [near_dedup.profile(a), near_dedup.profile(b)]})
    rows = near_dedup.Rows(frame, ["region"])
    i, j, alike = rows.pairs(1, 2)
    shared = len(np.intersect1d(a, b))
    assert len(i) == 1 and alike[0] >= shared / (len(a) + len(b) - shared)
