"""Keys that were ever seen, against a set, over many batches, with filters that let too much through and batches that run twice."""

import random

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException

from feedloom.operators import seen


def test_filters_hold_what_was_added():
    rng = np.random.default_rng(3)
    for n in (0, 1, 1000):
        hashes = rng.integers(-(2**63), 2**63 - 1, n)
        raw = seen.filter_of(hashes, 12)
        assert not n or seen.may_hold(raw, hashes).all()
        assert seen.may_hold(raw, rng.integers(-(2**63), 2**63 - 1, 1000)).sum() < 30


@pytest.mark.parametrize("bits", [1, 12])
def test_batches_equal_a_set(spark, tmp_path, bits, monkeypatch):
    """With one bit a key most filters let keys through that they don't hold; the look-up tells."""
    draw, known = random.Random(bits), set()
    index = seen.SeenKeys(spark, f"file://{tmp_path}", buckets=3, fan=2, bits=bits)
    opened, of = [], index.of
    monkeypatch.setattr(index, "of", lambda kind, places, schema: opened.append((kind, len(places))) or of(kind, places, schema))
    for number in range(6):
        keys = [draw.choice([None, f"k{draw.randint(0, 60)}"]) for _ in range(30)]
        for _ in range(2 if number == 3 else 1):  # one batch runs twice
            opened.clear()
            new = index.unseen(spark.createDataFrame([(k,) for k in keys], "key string"), number)
            assert sorted(r.key for r in new.collect()) == sorted({k for k in keys if k} - known)
            assert max(n for _, n in opened) <= 3 * 3  # segments of a bucket don't grow with the batches
            index.add(new, number)
        known |= {k for k in keys if k}
    segments = index.manifest().collect()
    assert sum(r["keys"] for r in segments) == len(known) and max(r.level for r in segments) >= 2
    assert index.unseen(spark.createDataFrame([("k1",), ("new",)], "key string")).count() == (1 if "k1" in known else 2)
    assert index.manifests.numbers() == [3, 4, 5]
    kept = {(r.segment, r.bucket) for n in (3, 4, 5) for r in index.manifest(n + 1).collect()}
    there = {tuple(x.partition("=")[2] for x in p.relative_to(tmp_path / "keys").parts) for p in (tmp_path / "keys").glob("segment=*/bucket=*")}
    assert {(s, int(b)) for s, b in there} == kept  # others are deleted
    assert index.unseen(spark.createDataFrame([], "key string")).count() == 0


def test_a_stream_that_is_stopped_hands_each_key_on_once(spark, tmp_path):
    index = seen.SeenKeys(spark, f"file://{tmp_path}/index", buckets=2)
    index.add(index.unseen(spark.createDataFrame([("old",)], "key string"), -1), -1)
    schema, stop = "dedupe_key string, source string", {"now": False}

    def hand_on(rows, number):
        rows.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={number}")
        if stop["now"]:
            raise RuntimeError("stopped")

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        requests = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        seen.registering(requests, index, hand_on, f"{tmp_path}/c").awaitTermination()

    run([("a", "s2"), ("a", "s1"), ("old", "s"), (None, "s")])
    stop["now"] = True
    with pytest.raises(StreamingQueryException):
        run([("b", "s"), ("a", "s")])
    stop["now"] = False
    run([("b", "s0"), ("c", "s")])
    got = spark.read.parquet(f"{tmp_path}/out").select("dedupe_key", "source").collect()
    assert sorted(map(tuple, got)) == [("a", "s1"), ("b", "s"), ("c", "s")]
