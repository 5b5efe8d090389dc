"""Repair of conversations against all edits, the registered SQL and plain Python."""

import hashlib
import random
import re
import zlib
from itertools import product

import duckdb
import pytest

from feedloom.llm import conversations

FORM = re.compile("(s?(ua)+)?")


def cheapest(letters, most=3):
    """(cost, audit) by trying all edits of a few turns, with up to `most` inserts between them."""
    found = []
    slots = [""] + ["".join(p) for n in range(1, most + 1) for p in product("ua", repeat=n)]
    options = []
    for x in letters:
        kind, role = divmod(conversations.LETTERS.index(x), 4)
        initial = "suao"[role]
        options.append([("D", "", 3)] + ([("K", initial, kind), ("R", "u", 2 + kind), ("R", "a", 2 + kind)] if kind < 2 else []))
    for edits in product(*options):
        for added in product(slots, repeat=len(letters) + 1):
            form = added[0] + "".join(e[1] + a for e, a in zip(edits, added[1:], strict=True))
            if FORM.fullmatch(form):
                audit = "I" * len(added[0]) + "".join(e[0] + "I" * len(a) for e, a in zip(edits, added[1:], strict=True))
                found.append((sum(e[2] for e in edits) + 2 * sum(map(len, added)), audit))
    return min(found)


def test_the_matrices_give_the_cheapest_edits():
    for n in (1, 2):
        for letters in product(conversations.LETTERS, repeat=n):
            assert conversations.verdict(conversations.chunk("".join(letters))) == cheapest(letters)
    rng = random.Random(5)
    for _ in range(60):
        letters = [rng.choice("suaoSUA1") for _ in range(3)]
        assert conversations.verdict(conversations.chunk("".join(letters))) == cheapest(letters, 2)


def test_products_may_be_taken_in_any_grouping():
    rng = random.Random(6)
    for _ in range(200):
        nodes = [conversations.one(rng.choice(conversations.LETTERS)) for _ in range(rng.randint(2, 30))]
        cut = rng.randint(1, len(nodes) - 1)
        line = nodes[0]
        for n in nodes[1:]:
            line = conversations.joined(line, n)
        assert line == conversations.product(nodes) == conversations.joined(conversations.product(nodes[:cut]), conversations.product(nodes[cut:]))


def random_rows(seed, n):
    rng = random.Random(seed)
    texts = ["Hello.", "Hello.", "hi", "", " \t\n", "Well?\n", "x\x0b", "a!b", "\xa0", None, "é."]
    rows = []
    for conv in [*range(n), None]:
        turns = [None] * rng.choice([0, 0, 1]) + rng.sample(range(50), rng.choice([1, 2, 5, 9]))
        rows += [(conv, t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "User"]), rng.choice(texts)) for t in turns]
    return rows + [(10_000, i, "user" if i % 3 else "assistant", f"line {i % 700}." if i % 5 else "stop") for i in range(2500)]


@pytest.mark.parametrize("seed", [1, 2])
def test_the_query_equals_its_sql(spark, monkeypatch, seed):
    monkeypatch.setattr(conversations, "CHUNK", 7)
    monkeypatch.setattr(conversations, "FAN", 3)
    schema = "conv_id long, turn long, role string, text string"
    rows = spark.createDataFrame([(*r, 1, "clash") for r in random_rows(seed, 60)], schema + ", rank int, letter string").repartition(4)
    got = sorted(map(tuple, conversations.repaired_digests(rows, conversations.damage(rows)).collect()), key=str)
    frame = rows.select("conv_id", "turn", "role", "text").toArrow()
    con = duckdb.connect()
    con.register("conversations", frame)
    want = con.execute(conversations.ORACLE_SQL["op11_minplus_repair"]).fetchall()
    assert got == sorted(want, key=str)


def test_repaired_turns_and_equal_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 1, "user", "Still there?"), (1, 2, "assistant", "Yes"), (2, 5, "user", " "), (3, 7, "system", "Be kind."), (3, 8, "assistant", "Ok.")]
    df = spark.createDataFrame(rows, "c int, n long, who string, said string")
    verdicts, turns = conversations.repair(df, "c", "n", "who", "said")
    assert {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) for r in verdicts.collect()} == {
        1: (0, 0, 1, 1, 2, 6, "KDIKK"), 2: (0, 1, 0, 0, 0, 3, "D"), 3: (0, 0, 0, 0, 1, 2, "KIK"),
    }
    got = [(r.conv_id, r.place, r.role, r.text, r.edit) for r in turns.orderBy("conv_id", "place").collect()]
    assert got == [
        (1, 0, "user", "Hi.", "K"), (1, 1, "assistant", "", "I"), (1, 2, "user", "Still there?", "K"), (1, 3, "assistant", "Yes", "K"),
        (3, 0, "system", "Be kind.", "K"), (3, 1, "user", "", "I"), (3, 2, "assistant", "Ok.", "K"),
    ]
    assert conversations.repair(df.where("false"), "c", "n", "who", "said").turns.count() == 0
    shas = {r.conv_id: r.sha256 for r in conversations.digests(turns).collect()}
    assert shas[3] == hashlib.sha256("system:Be kind.\nuser:\nassistant:Ok.".encode()).hexdigest() and 2 not in shas


def test_damage_and_conversations_without_rows(spark):
    drop = next(i for i in range(100) if zlib.crc32(f"7:{i}".encode()) % 20 == 0)
    stop = next(i for i in range(100) if zlib.crc32(f"7:{i}".encode()) % 20 == 2)
    twice = next(i for i in range(100) if zlib.crc32(f"7:{i}".encode()) % 20 == 3)
    schema = "conv_id long, turn long, role string, text string"
    rows = spark.createDataFrame([(7, stop, "assistant", "a.b!c?"), (7, twice, "user", None)], schema)
    assert sorted((r.turn, r.role, r.text) for r in conversations.damage(rows).collect()) == sorted([(stop, "assistant", "abc"), (twice, "user", " "), (twice, "user", " ")])
    gone = spark.createDataFrame([(7, drop, "user", "x")], schema)
    (r,) = conversations.repaired_digests(gone, conversations.damage(gone)).collect()
    assert tuple(r) == (7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert conversations.repaired_digests(gone.where("false"), conversations.damage(gone.where("false"))).count() == 0
