"""Each operator against a plain version of it, on a fixture with nulls, empty and repeated rows, ties and clashing columns."""

import hashlib
import io
import re
import zlib
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from feedloom.llm import components, decontaminate, langid, near_dedup, packing, pii, repeats, sharding, token_files, tokens, topk, warc  # noqa: E402

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{i * i % 911}" for i in range(4000))
TEXTS = [None, "", " ", "One two three.", "One two three.", LONG, LONG + " tail", "x" * 60, "y" + "x" * 60, "ÄÖ émile  naïve\n\n text", "a b c d e f g h i j k l m n o p q r s t", "a b c d e f g h i j k l m n o p q r s u", "1234", "<|endoftext|> 's I'M"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][i % 3], "clash", i) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, spans string, n_words int").repartition(3)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("doc_id < 0")


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_words_are_the_librarys():
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = tokens.WordEncoder(public_tokenizers.path(name), 50)
        texts = [t or "" for t in TEXTS] + ["İx Σa ς́ \x85\x1c|</w>", "\t a  \n b ", "don't I'LL"]
        assert e.encode(texts) == e._whole(texts)


def test_added_tokens_are_the_librarys(docs):
    from tokenizers import Tokenizer

    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|startoftext|>y<|endoftext|><|endoftext|>", "a  <|endoftext|>\n b é", "<|ENDOFTEXT|> <|endoftext| >", "<|endoftext|", "", "plain words", *[t or "" for t in TEXTS]]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        fresh = Tokenizer.from_file(path)
        want = [np.array(fresh.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert tokens.WordEncoder(path).encode(texts) == want
        assert len(want[0]) == 4 * (4 if name.startswith("byte") else 3)
        got = [r for r in packing.pack(docs, path, with_ids=True).collect() if r.doc_id == len(TEXTS) - 1]
        assert b"".join(r.ids for r in got) == want[-1] + np.uint32(2).tobytes()


def test_random_texts_have_the_librarys_ids():
    from tokenizers import Tokenizer

    rng = np.random.default_rng(8)
    pools = [list(range(32, 127)), list(range(0, 0x250)), [0x20, 0x0A, 0x09, 0xA0, 0x2003, 0x85, 0x3000], list(range(0x370, 0x600)), list(range(0x4E00, 0x4E80)), [0x1F600, 0x200D, 0xFE0F, 0x301, 0x130, 0x3C2, 0x1E9E, 0xDF]]
    texts = ["".join(chr(int(rng.choice(pools[int(rng.integers(len(pools)))]))) for _ in range(int(rng.integers(1, 60)))) for _ in range(400)]
    texts += [" ".join(t) for t in zip(texts[:50], texts[50:100], ["don't I'LL we've '"] * 50, strict=True)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        fresh = Tokenizer.from_file(path)
        got = tokens.WordEncoder(path, 100).encode(texts)
        bad = [t for t, ids in zip(texts, got, strict=True) if ids != np.array(fresh.encode(t, add_special_tokens=False).ids, "<u4").tobytes()]
        assert not bad


def test_packing(docs, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.pack(docs, path, 128, with_ids=True).collect()
    whole = tokens.encoder(path).encode([t or "" for t in TEXTS])
    for i, raw in enumerate(whole):
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        assert b"".join(r.ids for r in own) == raw + np.uint32(2).tobytes()
        assert all(r.ids_crc32 == zlib.crc32(r.ids) and 4 * r.length == len(r.ids) for r in own)
        assert [r.length for r in own[1:]] == [128] * (len(own) - 1)
    rows: dict = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == rows.get(r.sequence_id, 0)
        rows[r.sequence_id] = r.offset + r.length
    assert max(rows.values()) <= 128
    assert packing.pack(nothing, path).count() == 0


def plain_best_fit(lengths, capacity):
    """Pieces above a third of the capacity, the longest first with the longest that fits beside it; then each shorter one, longest first, into the tightest gap."""
    large = sorted((x for x in lengths if 3 * x > capacity), reverse=True)
    bins = []
    while large:
        one = large.pop(0)
        other = next((x for x in large if x <= capacity - one), 0)
        if other:
            large.remove(other)
        bins.append(capacity - one - other)
    for x in sorted((x for x in lengths if 3 * x <= capacity), reverse=True):
        at = min((i for i, gap in enumerate(bins) if gap >= x), key=lambda i: bins[i], default=None)
        if at is None:
            bins.append(capacity - x)
        else:
            bins[at] -= x
    return bins


def test_plan_is_best_fit():
    rng = np.random.default_rng(1)
    for t in range(30):
        capacity = int(rng.integers(8, 200))
        lengths = rng.integers(1, capacity + 1, int(rng.integers(1, 400))) if t % 2 else np.minimum(rng.geometric(6 / capacity, 300), capacity)
        values, counts = np.unique(lengths, return_counts=True)
        runs, n = packing.plan(dict(zip(values.tolist(), counts.tolist(), strict=True)), capacity)
        assert sum(r.count for r in runs) == len(lengths)
        assert n == len(plain_best_fit(lengths.tolist(), capacity))
    assert packing.plan({600: 3, 424: 2, 400: 1})[1] == 3
    with pytest.raises(ValueError):
        packing.plan({0: 1}, 8)


def test_packing_of_repeated_and_null_ids(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = spark.createDataFrame([(1, "one two three"), (1, "one two three"), (None, "four five"), (None, None)] + [(2, "six " * 300)] * 3, "doc_id long, text string").repartition(3)
    got = packing.pack(rows, path, 64, with_ids=True).collect()
    whole = tokens.encoder(path)
    assert sum(r.length for r in got) == sum(len(x) // 4 + 1 for x in whole.encode(["one two three"] * 2 + ["four five", ""] + ["six " * 300] * 3))
    places = sorted((r.sequence_id, r.offset, r.length) for r in got)
    assert all(a[1] + a[2] == b[1] if a[0] == b[0] else b[1] == 0 for a, b in zip(places, places[1:], strict=False))
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in got)
    filled = {r.sequence_id: r for r in packing.sequences(packing.pack(rows, path, 64, with_ids=True)).collect()}
    assert sum(len(r.ids) for r in filled.values()) == 4 * sum(r.length for r in got)


def removal(rows):
    """By brute force: n_bytes, n_removed, kept of (id, text) rows."""
    first: dict = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49 if i is not None else 0):
            first[b[k : k + 50]] = min(first.get(b[k : k + 50], i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49 if i is not None else 0):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        out.append((i, len(b), sum(gone), bytes(x for x, y in zip(b, gone, strict=True) if not y)))
    return out


@pytest.mark.parametrize("hot", [20_000, 0])
def test_repeats(spark, docs, nothing, hot, monkeypatch):
    """Also with repeated and null ids, and with each key too hot for a bucket."""
    monkeypatch.setattr(repeats, "HOT", hot)
    rng = np.random.default_rng(4)
    line = "a line of forty-three bytes that is common; "
    odd = [line + "".join(map(chr, rng.integers(97, 123, 40))) + line for _ in range(20)] + ["a" * 400, "b" + "a" * 300 + "b", "a" * 49]
    rows = list(enumerate(TEXTS)) + [(100 + i, t) for i, t in enumerate(odd)] + [(5, LONG + " tail"), (None, LONG), (7, "x" * 61), (104, odd[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in repeats.remove_repeats(df, with_text=True).collect()), key=order)
    assert got == sorted(removal(rows), key=order)
    one = repeats.remove_repeats(docs).where("doc_id = 6").first()
    assert one.kept_sha256 == hashlib.sha256(removal(list(enumerate(TEXTS)))[6][3]).hexdigest() and one.n_spans == 1
    assert repeats.remove_repeats(nothing).count() == 0


def plain_repeats(data, least=50):
    """Maximal repeats by comparing all neighbours of the sorted suffixes."""
    at = sorted(range(len(data) - least + 1), key=lambda i: data[i:])
    common = [next((k for k in range(len(data)) if max(a, b) + k >= len(data) or data[a + k] != data[b + k]), 0) for a, b in zip(at, at[1:], strict=False)]
    out = []
    for h in sorted({x for x in common if x >= least}):
        for low, stretch in groupby(range(len(common)), key=lambda i: common[i] >= h):
            run = list(stretch)
            if low and min(common[run[0] : run[-1] + 1]) == h:
                places = sorted(at[run[0] : run[-1] + 2])
                if len({data[p - 1] if p else -1 for p in places}) > 1:
                    out.append((h, places))
    return sorted(out)


def test_maximal_repeats():
    rng = np.random.default_rng(0)
    for t in range(20):
        base = bytes(rng.integers(97, 99 if t % 2 else 123, int(rng.integers(60, 200))).astype(np.uint8))
        parts = [base[rng.integers(0, 40) : rng.integers(50, len(base))] for _ in range(rng.integers(1, 5))] + [b"a" * int(rng.integers(0, 180))]
        data = b"|".join(parts) + parts[0] * (t % 3)
        assert repeats.maximal_repeats(data) == plain_repeats(data)


def test_repeat_groups_have_all_places(spark):
    rng = np.random.default_rng(6)
    passage = "".join(map(chr, rng.integers(97, 123, 130)))
    texts = [passage[a : a + 90] + "".join(map(chr, rng.integers(97, 123, 20))) for a in (0, 0, 10, 40)] + ["".join(map(chr, rng.integers(97, 123, 200)))]
    nodes, places = repeats.repeat_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2))
    parent, length = {r.node: r.parent for r in nodes.collect()}, {r.node: r.length for r in nodes.collect()}
    at: dict = {}
    for r in places.collect():
        node = r.node
        while node is not None:
            at.setdefault(node, set()).add((r.doc_id, r.start))
            node = parent[node]
    strings = []
    for node, found in at.items():
        same = {texts[d][a : a + length[node]] for d, a in found}
        assert len(same) == 1 and len(same.copy().pop()) == length[node] >= 50
        strings.append((same.pop(), found))
    starts = [(d, a, t[a : a + 50]) for d, t in enumerate(texts) for a in range(len(t) - 49)]
    for d, a, w in starts:  # a window of several documents is in a group with all its places
        every = {(x, b) for x, b, v in starts if v == w}
        if len({x for x, _ in every}) > 1:
            assert any((d, a - k) in found and {(x, b - k) for x, b in every} <= found for s, found in strings for k in range(len(s) - 49) if s[k : k + 50] == w)


def test_warc(spark, monkeypatch):
    rows = [(0, "http://a", "<p>1"), (1, None, "<p>1"), (2, "http://b\n", None), (3, "http://c", ""), (4, "u", "é" * 9000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = by_id(warc.read_archives(warc.write_archives(pages)), "page_id")
    assert [got[i].record_type for i in range(5)] == ["response", "revisit", "response", "revisit", "response"]
    assert (got[1].refers_to, got[3].refers_to, got[0].refers_to) == (0, 2, None)
    assert bytes(got[4].payload).decode() == "é" * 9000
    assert all(got[i].payload_digest == warc.base32_sha1((rows[i][2] or "").encode()) for i in range(5))
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0
    odd = pages.unionByName(spark.createDataFrame([(None, "n", "<p>1"), (0, "again", "<p>1"), (None, None, "only null"), (None, "x", "only null")], pages.schema))
    monkeypatch.setattr(warc, "SENT_BYTES", -1)  # groups too many to be sent to all
    kinds = sorted((r.page_id is None, r.page_id or 0, r.record_type, r.refers_to) for r in warc.read_archives(warc.write_archives(odd)).collect())
    assert kinds == [(False, 0, "response", None), (False, 0, "response", None), (False, 1, "revisit", 0), (False, 2, "response", None), (False, 3, "revisit", 2), (False, 4, "response", None),
                     (True, 0, "response", None), (True, 0, "response", None), (True, 0, "revisit", 0)]
    good = warc.record_bytes(1, "u", b"abc", None, False)
    for bad in (good[:-1], good.replace(b"abc", b"abd"), good.replace(b"WARC-Date", b"Date"), b"x" + good):
        with pytest.raises(warc.WarcError):
            warc.parse_record(bad)


def test_sharding(docs, nothing):
    base, grown = sharding.topology(16), sharding.topology(17)
    got = sharding.shard(docs, base, grown).collect()
    assert all(r.grown_shard in (r.shard, 16) for r in got)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in enumerate(TEXTS)}
    assert sharding.shard(nothing, base, grown).count() == 0


def test_sharding_is_the_sqls(spark):
    import duckdb

    got = sharding.op5_weighted_tree(spark, "/root/testdata/sf0.001").drop("text_crc32").toPandas()
    documents = "'/root/testdata/sf0.001/documents.parquet'"
    want = duckdb.sql(sharding.oracle().replace("FROM documents d", f"FROM {documents} d")).df()[list(got.columns)]
    key = ["doc_id"]
    assert (got.sort_values(key).reset_index(drop=True).astype(str) == want.sort_values(key).reset_index(drop=True).astype(str)).all().all()


def test_sharding_moves_rows_only_where_weights_change(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).unionByName(spark.createDataFrame([(None, "x"), (None, None), (5, "y")], "doc_id long, text string"))
    heavy = [sharding.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 5 else 1.0) for x in sharding.topology(16)]
    got = sharding.shard(rows, sharding.topology(16), heavy).collect()
    moved = {(r.shard, r.grown_shard) for r in got if r.shard != r.grown_shard}
    region = {x.shard: x.region for x in heavy}
    assert moved and all(b == 5 or (region[a] == region[b] == region[5]) or region[b] == region[5] for a, b in moved)
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_token_files(docs, nothing):
    path = public_tokenizers.path("word_bpe_49k.json")
    manifest, dictionary = token_files.write_tokens(docs, path)
    got, start = by_id(token_files.read_tokens(manifest, dictionary)), 0
    for i, raw in enumerate(tokens.encoder(path).encode([t or "" for t in TEXTS])):
        raw += np.uint32(2).tobytes()
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(raw) // 4, zlib.crc32(raw))
        start += len(raw) // 4
    one = token_files.Reader(manifest.first()["path"], dictionary)
    assert len(one.document(int(one.ids[0]))) == one.counts[0]
    with pytest.raises(token_files.TokenFileError):
        token_files.Reader(manifest.first()["path"], b"another")
    empty, dictionary = token_files.write_tokens(nothing, path)
    assert token_files.read_tokens(empty, dictionary).count() == 0


def test_pii(spark):
    texts = [None, "", "a@b a.b@c-d.org x@y.z@q.rs", "1.2.3.4.5 300.1.1.1", "4111 1111 1111 1111 and 4111 1111 1111 1112", "+1 (988) 555-2485", "iban DE89 3704 0044 0532 0130 00", "ssn 123-45-6789 or 123-45-6780x", "é" * 50 + " a@b.co", "1 " * 30000, "a" * 60000 + "@b.c"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(pii.find_pii(rows))
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
    for i, t in enumerate(texts[:-1]):
        assert [(s.start, s.end) for s in got[i].spans if s.kind == "email"] == [m.span() for m in email.finditer(t or "")]
    kinds = [[s.kind for s in got[i].spans] for i in range(len(texts))]
    assert kinds[3:] == [["ip"], ["card"], ["phone"], ["iban"], ["ssn"], ["email"], [], ["email"]]
    assert by_id(pii.redact(rows))[5].text == "[PHONE]"


def test_near_duplicates(spark, docs, nothing):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        return set(zip(w, w[1:], strict=False)) if len(w) > 1 else {tuple(w)} if w else set()

    sets = [shingles(t) for t in TEXTS]
    want = list(range(len(TEXTS)))
    for _ in TEXTS:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    want[i] = min(want[i], want[j])
    got = by_id(near_dedup.near_duplicates(docs))
    assert [(got[i].n_shingles, got[i].component_id, got[i].kept) for i in range(len(TEXTS))] == [(len(sets[i]), want[i], want[i] == i) for i in range(len(TEXTS))]
    assert near_dedup.near_duplicates(nothing).count() == 0
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(99, 98), (5, None)], "a long, b long")
    assert {r.node: r.label for r in components.components(chain).collect()} == {**dict.fromkeys(range(41), 0), 98: 98, 99: 98}


def test_near_duplicates_in_a_crowd(spark, monkeypatch):
    """One template, 20 slots: 300 documents about 0.7 similar, and of these 20 pairs of 0.802, however few places of an order are looked at."""
    rng = np.random.default_rng(5)
    slots = rng.integers(0, 30, (300, 20))
    slots[150:170, :8] = slots[:20, :8]
    slots[150:170, 8:] = (slots[:20, 8:] + 1) % 30
    texts = [" ".join(" ".join(f"f{10 * j + k}" for k in range(10)) + f" s{j}v{v}" for j, v in enumerate(row)) for row in slots]
    words = [t.split() for t in texts]
    sets = [set(zip(w, w[1:], strict=False)) for w in words]
    links = [(i, j) for i in range(300) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert {(i + 150, i) for i in range(20)} <= set(links)
    want = list(range(300))
    for _ in range(5):
        for i, j in links:
            want[i] = want[j] = min(want[i], want[j])
    monkeypatch.setattr(near_dedup, "REACH", (1, 1))
    monkeypatch.setattr(near_dedup, "BLOCK", 16)  # regions of several blocks
    got = by_id(near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)))
    assert [got[i].component_id for i in range(300)] == want


def test_contamination(spark, docs, nothing):
    items = spark.createDataFrame([(1, "A b c d e f g h i j K"), (2, "two three"), (3, None), (4, "zz"), (None, "1234"), (1, "A b c d e f g h i j K")], "item_id long, text string")
    got = by_id(decontaminate.find_contamination(docs, items))
    assert got[3].items == ["2"] and got[10].items == ["1"] and got[12].items == ["null"] and got[0].items == []
    assert [(s.start, s.end) for s in got[10].spans] == [(0, 11)]
    assert got[9].n_words == 4 and got[0].n_words == 0
    assert by_id(decontaminate.find_contamination(docs, items.limit(0)))[9].n_words == 4
    assert decontaminate.find_contamination(nothing, items).count() == 0
    assert {r.doc_id for r in decontaminate.clean(docs, items).collect()} == {i for i in range(len(TEXTS)) if not got[i].spans}


def phrases(texts, items):
    """By brute force: each text's hit words and the items with windows in it."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    out = []
    for t in texts:
        own, hit, found = words(t), set(), set()
        for k, item in items:
            w = words(item)
            for win in ([w[i : i + 10] for i in range(len(w) - 9)] or [w]) if w else []:
                for i in range(len(own) - len(win) + 1):
                    if own[i : i + len(win)] == win:
                        hit |= set(range(i, i + len(win)))
                        found.add(str(k))
        out.append((len(own), len(hit), sorted(found)))
    return out


def test_phrases_and_near_matches(spark, monkeypatch):
    rng = np.random.default_rng(2)
    prose = lambda n: " ".join(f"w{x}" for x in rng.zipf(1.3, n) % 300)
    items = [(i, prose(int(n))) for i, n in enumerate(rng.integers(1, 30, 30))] + [(7, None), (8, "")]
    items += [(40 + i, items[5][1]) for i in range(5)]  # equal windows of several items
    texts = [prose(int(n)) for n in rng.integers(0, 400, 60)] + [None, ""]
    for i in range(20):
        texts[i] += " , " + items[i][1].upper() + " " + prose(5)
    rare = "zeta eta theta iota kappa lambda mu nu xi omicron"
    items.append((99, rare))
    texts += [rare.replace(" ", " x "), " ".join(rare.split()[:4]) + " x" * 60 + " " + " ".join(rare.split()[4:])]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = phrases([t for _, t in rows], items)
    for most in (20_000, 9):  # one block, several blocks
        monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", most)
        got = decontaminate.search(decontaminate.build_index(docs), benchmark).collect()
        key = lambda i: -1 if i is None else i
        have = sorted((key(r.doc_id), r.n_words, sum(s.end - s.start for s in r.spans), r.items) for r in got)
        assert have == sorted((key(i), *w) for (i, _), w in zip(rows, want, strict=True))
        near = {r.doc_id: r.near for r in got}
        assert "99" in near[62] and "99" not in near[0]


def test_index_files_must_be_whole(spark, docs):
    manifest = decontaminate.build_index(docs)
    with pytest.raises(Exception, match="instead of"):
        decontaminate.term_counts(manifest.withColumn("segments", F.col("segments") + 1), np.zeros(1, np.uint64))
    raw = decontaminate.segment_bytes(np.zeros((1, 4)), np.array([0, 3]), np.array([5, 3, 5], np.uint64), __import__("zstandard").ZstdCompressor())
    one = next(decontaminate.segments(io.BytesIO(raw)))
    assert one.terms.tolist() == [3, 5] and [int(x) & 0xFFFFFFFF for x in one.postings] == [1, 0, 2]
    with pytest.raises(decontaminate.PostingsError):
        list(decontaminate.segments(io.BytesIO(b"x" + raw)))


def test_top_k(spark):
    rng = np.random.default_rng(3)
    vectors = [[float(x) for x in rng.normal(size=7)] for _ in range(300)]
    vectors[20:60] = [vectors[20]] * 40
    rows = [(i, v) for i, v in enumerate(vectors)] + [(900, None), (901, [float("nan")] * 7), (902, [None] + [1.0] * 6), (903, [1.0]), (None, vectors[0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    ints = {i: [int(np.floor(1024 * float(np.float32(x)))) for x in v] for i, v in enumerate(vectors)}
    got = topk.top_k(df, df.where("vec_id % 100 = 0"), block=2).collect()
    for q in (0, 100, 200):
        order = sorted(((-sum(a * b for a, b in zip(ints[q], ints[i], strict=True)), i) for i in ints if i != q))[:10]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == order
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_top_k_with_random_multiplicities(spark):
    rng = np.random.default_rng(11)
    for scale in (1, 2**23):  # with the second, scores need 64-bit integers
        ints = rng.integers(-9, 10, (60, 6))
        ints[20:30] = ints[20]
        times = rng.integers(1, 5, 60)
        rows = [(i, [float(x) for x in ints[i]]) for i in range(60) for _ in range(times[i])]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
        got = topk.top_k(df, df.where("vec_id % 20 = 0"), k=7, lists=3, scale=scale).collect()
        for q in (0, 20, 40):
            every = sorted((-int(ints[q] @ ints[i]) * scale * scale, i) for i in range(60) if i != q for _ in range(times[i]))
            assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == every[:7]
    huge = spark.createDataFrame([(0, [3e18, 1.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="longs"):
        topk.top_k(huge, huge, scale=1).collect()


def test_top_k_of_repeated_rows(spark):
    """12 vectors that are large in one list, three times each, don't hide ten that are middling in all."""
    large = [(i, [float(989 + i) if n == i % 4 else 0.0 for n in range(4)]) for i in range(12)]
    df = spark.createDataFrame(3 * large + [(100 + i, [700.0] * 4) for i in range(10)], "vec_id long, embedding array<double>").repartition(2)
    ones = spark.createDataFrame([(-1, [1.0] * 4)], "vec_id long, embedding array<double>")
    got = topk.top_k(df, ones, scale=1).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(100 + i, 2800) for i in range(10)]
    got = topk.top_k(df.where("vec_id < 100"), ones, scale=1).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(i, 989 + i) for i in (11, 11, 11, 10, 10, 10, 9, 9, 9, 8)]


def test_language(spark, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    found = langid.identify(docs, model).where(langid.held_out(F.col("doc_id")))
    assert found.where("lang_pred = lang").count() >= 0.97 * found.count()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 %"), (4, "é")], "doc_id long, text string")
    assert [r.lang_pred == "und" for r in langid.identify(odd, model).orderBy("doc_id").collect()] == [True, True, True, False]
    assert langid.train(nothing).langs == []
    code = langid.codewords(12)
    assert min((code[a] != code[b]).sum() for a in range(12) for b in range(a)) >= 5


def test_decoding_is_the_nearest_codeword():
    rng = np.random.default_rng(3)
    langs = [f"l{i}" for i in range(9)]
    model = langid.fit(langs, rng.integers(0, 50, (9, len(langid.GRAMS), langid.BUCKETS)).astype(float))
    margins = rng.normal(0, 0.05, (40, model.code.shape[1]))
    best, share = model.decode(margins)
    for m, k, s in zip(margins, best, share, strict=True):
        loss = [sum(r * np.log1p(np.exp(-langid.SHARPNESS * x * c)) for x, c, r in zip(m, word, model.reliability, strict=True)) for word in model.code]
        weights = [np.exp(-x) for x in loss]
        assert k == int(np.argmin(loss)) and abs(s - weights[k] / sum(weights)) < 1e-9


def test_language_of_odd_rows(spark, monkeypatch):
    rows = [(i, ("the cat sat on the mat " if i % 2 else "der hund ging in den wald ") * 3, "en" if i % 2 else "de", "clash") for i in range(60)] + [(None, "the cat", None, "clash"), (3, "the cat sat", "en", "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    model = langid.train(docs)
    got = langid.identify(docs, model).collect()
    assert len(got) == 62 and {(r.lang, r.lang_pred) for r in got} == {("en", "en"), ("de", "de"), (None, "en")}
    mixed = langid.identify(spark.createDataFrame([(1, "x q"), (2, "the der")], "doc_id long, text string"), model).collect()
    assert all(0 <= r.score <= 1 and r.ambiguous == (0 < r.score < langid.CLEAR) for r in mixed)
    monkeypatch.setattr(langid, "MOST_LANGS", 1)
    with pytest.raises(ValueError, match="languages"):
        langid.train(docs)


def test_personal_data_beyond_the_base(spark):
    texts = ["iban DE89 3704 0044 0532 0130 00 and GB82 WEST 1234 5698 7654 32 but DE88370400440532013000", "ssn 219-09-9999, 219-09-9998 " + "x " * 60 + "version 123-45-6789", "x 4111 1111 1111 1111 x 4111111111111111", "a@b.cd a@b.cd"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 2, "doc_id long, text string")
    got: dict = {}
    for r in pii.find_pii(rows).collect():
        got.setdefault(r.doc_id, []).append([(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.spans])
    assert all(a == b for a, b in got.values())
    assert [x for x in got[0][0] if x[0] == "iban"] == [("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82 WEST 1234 5698 7654 32")]
    assert [x for x in got[1][0] if x[0] == "ssn"] == [("ssn", "219-09-9999"), ("ssn", "219-09-9998")]
    assert [k for k, _ in got[3][0]] == ["email", "email"] and pii.find_pii(rows.limit(0)).count() == 0


def test_pipeline_stages(spark):
    """Each stage against a plain version, on rows with nulls, copies, a benchmark passage and personal data; also without any rows."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy(F.length("text").desc()).first().text
    given = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en' AND n_chars BETWEEN 300 AND 900").orderBy("doc_id").limit(12).collect()]
    long = " ".join(f"{w} {i}" for i, w in enumerate(given[0].split()))
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(given[1:])] + [(50, long, None, "s", None), (51, long + " end", "en", "s", 1), (52, long, "en", None, 1), (53, given[1] + " " + item, "en", "s", 1)]
    rows += [(54, None, "en", "s", None), (55, "", None, None, 0), (56, "12 34 %", "en", "s", 7), (57, "write to a.b@c.de " + given[2][:200], "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("spans", F.lit("clash")).repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    kept = by_id(stages["language"](spark, docs, sf))
    assert set(kept) == {r[0] for r in rows} - {54, 55, 56} and kept[50].lang is not None and kept[50].text == long
    five = lambda t: {tuple(w[i : i + 5]) for w in [(t or "").translate(LOWER).split()] for i in range(max(1, len(w) - 4) if w else 0)}
    sets = {r[0]: five(r[1]) for r in rows}
    label = {i: i for i in sets}
    for _ in rows:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = min(label[a], label[b])
    assert set(by_id(stages["near_duplicates"](spark, docs, sf))) == {i for i in sets if label[i] == i}
    assert {51, 52}.isdisjoint({i for i in sets if label[i] == i})
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hit = {r[0] for r, (_, n, _) in zip(rows, phrases([r[1] for r in rows], items), strict=True) if n}
    assert 53 in hit and set(by_id(stages["benchmark"](spark, docs, sf))) == {r[0] for r in rows} - hit
    masked = by_id(stages["personal_data"](spark, docs, sf))
    assert len(masked) == len(rows) and masked[57].text.startswith("write to [EMAIL] ") and masked[54].text is None and masked[0].text == rows[0][1]
    packed = stages["packing"](spark, docs, sf).collect()
    assert {r.doc_id for r in packed} == {r[0] for r in rows} and all(len(r.ids) == 4 * r.length for r in packed)
    none = docs.where("doc_id < 0")
    assert all(f(spark, none, sf).count() == 0 for f in stages.values())


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    ids = {r.doc_id for r in corpus_pipeline.run(spark, "/root/testdata/sf0.001").select("doc_id").distinct().collect()}
    assert 0 < len(ids) < docs.count()
    hit = {r.doc_id for r in decontaminate.find_contamination(docs.select("doc_id", "text"), spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")).where("size(spans) > 0").collect()}
    assert not ids & hit
