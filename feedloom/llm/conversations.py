"""Repair of conversations: the cheapest edits that give one system turn at most, then user and assistant in turn.

Each turn becomes a 4x4 matrix over the states of the wanted form (nothing yet,
after system, after user, after assistant). An element is what it costs to get
from one state to the other over this turn, any number of inserted turns
before it included, and the edits that do it. Elements add by taking the
cheaper (then ASCII-least) one and multiply by adding costs and joining edits.
Two different sequences of edits over the same turns from the same state are
never each other's beginning (edits decide the states, inserts cost), so the
least one stays the least whatever follows, and products may be taken in any
grouping: turns of a chunk in one task, chunks by a tree of groups.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache, reduce
from typing import Any, NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from .shared import Keep, save, scratch, table, with_rank

#: What edits cost, besides 1 for each truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Turns of a chunk, and chunks that one step of the tree joins.
CHUNK, FAN = 1024, 16
WHITE = " \t\n\x0b\x0c\r"
#: A turn as a letter: role initial (other ones: o), in capitals if truncated, as a digit if it must go.
LETTERS = "suaoSUAO0123"
START, SYSTEM, USER, ASSISTANT = range(4)
STEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "o": {}}
LEGAL = ("su", "ua", "au")

Element = tuple[int, str]
Matrix = tuple[tuple[Element | None, ...], ...]


def times(left: Matrix, right: Matrix) -> Matrix:
    """The min-plus product; None is what can't be reached."""
    rows = []
    for a in left:
        row: list[Element | None] = []
        for j in range(4):
            best: Element | None = None
            for x, b in zip(a, right, strict=True):
                y = b[j]
                if x is not None and y is not None and (best is None or x[0] + y[0] <= best[0]):
                    found = (x[0] + y[0], x[1] + y[1])
                    best = found if best is None else min(best, found)
            row.append(best)
        rows.append(tuple(row))
    return tuple(rows)


def plus(left: Matrix, right: Matrix) -> Matrix:
    least = lambda x, y: min(v for v in (x, y) if v is not None) if x is not None or y is not None else None
    return tuple(tuple(least(x, y) for x, y in zip(a, b, strict=True)) for a, b in zip(left, right, strict=True))


def matrix(moves: dict[tuple[int, int], Element]) -> Matrix:
    return tuple(tuple(moves.get((i, j)) for j in range(4)) for i in range(4))


ONE = matrix({(i, i): (0, "") for i in range(4)})
_ADDED = matrix({(i, j): (INSERT, "I") for role in "ua" for i, j in STEPS[role].items()})
#: Any number of inserted turns: beyond three of them a state comes back, at a higher price.
CLOSURE = reduce(lambda x, _: plus(ONE, times(x, _ADDED)), range(3), ONE)


@lru_cache(maxsize=None)
def turn(letter: str) -> Matrix:
    """Inserts, then one edit of the turn."""
    kind, role = divmod(LETTERS.index(letter), 4)
    edits = [matrix({(i, i): (DELETE, "D") for i in range(4)})]
    if kind < 2:
        edits.append(matrix({(i, j): (TRUNCATED * kind, "K") for i, j in STEPS["suao"[role]].items()}))
        edits.append(matrix({(i, j): (REROLE + TRUNCATED * kind, "R") for to in "ua" for i, j in STEPS[to].items()}))
    return times(CLOSURE, reduce(plus, edits))


class Node(NamedTuple):
    """Some turns in a row: initials of the first and last, illegal neighbours among them, and their matrix."""

    first: str
    last: str
    illegal: int
    moves: Matrix


def joined(left: Node, right: Node) -> Node:
    return Node(left.first, right.last, left.illegal + right.illegal + (left.last + right.first not in LEGAL), times(left.moves, right.moves))


def one(letter: str) -> Node:
    initial = "suao"[LETTERS.index(letter) % 4]
    return Node(initial, initial, 0, turn(letter))


@lru_cache(maxsize=4096)
def _short(letters: str) -> Node:
    return product([one(x) for x in letters])


def chunk(letters: str) -> Node:
    return _short(letters) if len(letters) <= 24 else product([_short(letters[i : i + 8]) for i in range(0, len(letters), 8)])


def product(nodes: Sequence[Node]) -> Node:
    """By a tree, so edits of a long chunk are joined a few times only."""
    level = list(nodes)
    while len(level) > 1:
        level = [joined(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def verdict(node: Node) -> Element:
    """Of whole conversations: the least edits from nothing to nothing or an assistant's turn."""
    last = times(node.moves, CLOSURE)[START]
    return min(x for x in (last[START], last[ASSISTANT]) if x is not None)


NODE = StructType().add("first", StringType()).add("last", StringType()).add("illegal", LongType()).add("cost", ArrayType(LongType())).add("audit", ArrayType(StringType()))


def _frame(nodes: Sequence[Node]) -> pd.DataFrame:
    flat = [[x for row in n.moves for x in row] for n in nodes]
    return pd.DataFrame({
        "first": [n.first for n in nodes], "last": [n.last for n in nodes], "illegal": pd.Series([n.illegal for n in nodes], dtype="int64"),
        "cost": pd.Series([[None if x is None else x[0] for x in f] for f in flat], dtype=object), "audit": pd.Series([[None if x is None else x[1] for x in f] for f in flat], dtype=object),
    })


def _node(row: Any) -> Node:
    held = [None if a is None else (int(c), a) for c, a in zip(row["cost"], row["audit"], strict=True)]
    return Node(row["first"], row["last"], int(row["illegal"]), tuple(tuple(held[i : i + 4]) for i in range(0, 16, 4)))


@F.pandas_udf(NODE)
def _chunks(letters: pd.Series) -> pd.DataFrame:
    return _frame([chunk(x) for x in letters])


@F.pandas_udf(NODE)
def _products(nodes: pd.Series) -> pd.DataFrame:
    return _frame([product([_node(x["node"]) for x in sorted(held, key=lambda x: x["at"])]) for held in nodes])


@F.pandas_udf(StructType().add("illegal", LongType()).add("cost", LongType()).add("audit", StringType()))
def _verdicts(nodes: pd.DataFrame) -> pd.DataFrame:
    found = [(n.illegal, *verdict(n)) for n in map(_node, nodes.to_dict("records"))]
    return pd.DataFrame(found, columns=["illegal", "cost", "audit"])


EDIT = re.compile("I*[DKR]|I+")


def edits_of(verdicts: DataFrame) -> DataFrame:
    """A row for each turn of each conversation (conv_id, rank): its edit with the inserts before it, the place of the first of them
    in the repaired conversation, and whether that begins with system; inserts at the end stand at the rank after the last turn."""
    kind = verdicts.schema["conv_id"].dataType
    schema = pa.schema([("conv_id", to_arrow_type(kind)), ("rank", pa.int64()), ("edit", pa.string()), ("place", pa.int64()), ("system", pa.bool_())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])

            def made(b: pa.RecordBatch = batch, rows: tuple[list, ...] = rows) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([b.column("conv_id").take(pa.array(rows[0], pa.int64())).cast(schema[0].type), *[pa.array(r, f.type) for r, f in zip(rows[1:], list(schema)[1:], strict=True)]], schema=schema)

            for i, audit in enumerate(batch.column("audit").to_pylist()):
                place, system = 0, (len(audit) - audit.count("D")) % 2 == 1  # legal turns come in pairs but for a system turn
                for rank, edit in enumerate(EDIT.findall(audit)):
                    for column, value in zip(rows, (i, rank, edit, place, system), strict=True):
                        column.append(value)
                    place += len(edit) - (edit[-1] == "D")
                    if len(rows[0]) >= 50_000:
                        yield made()
                        for column in rows:
                            column.clear()
            if rows[0]:
                yield made()

    return verdicts.select("conv_id", "audit").mapInArrow(cut, f"conv_id {kind.simpleString()}, rank long, edit string, place long, system boolean")


class Repaired(NamedTuple):
    """verdicts: a row per conversation (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit). turns: the repaired
    conversations (conv_id, place from 0, role, text, edit)."""

    verdicts: DataFrame
    turns: DataFrame


def repair(rows: DataFrame, conv: str = "conv_id", turn_col: str = "turn", role: str = "role", text: str = "text", keep: Keep = save) -> Repaired:
    """Judges and repairs conversations.

    Turns stand by their numbers, null first; equal numbers by role, then by a
    hash of the text. A null role or text is one space. Blank turns and those
    whose role and text were there before must go; a truncated one (its last
    character is no . ! ?) may stay at a price. Roles count by their initials,
    and others than s, u, a can't stay. A null conv_id is a conversation like
    others; other columns play no part; no rows, no conversations. Role and
    text are compared by 128-bit hashes.

    Turns of a conversation spread over many tasks, hot ones too. What `keep`
    writes must last as long as the results are read.
    """
    trimmed = F.rtrim("text", F.lit(WHITE))
    both = lambda n: F.xxhash64(F.lit(n), "role", F.lit("\x01"), "text")
    base = rows.select(F.col(conv).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), *[F.coalesce(F.col(c), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))])
    flagged = base.withColumns({"d0": both(0), "d1": both(1), "blank": trimmed == "", "cut": ~F.right(trimmed, F.lit(1)).isin(".", "!", "?")})
    order = ["conv_id", "turn", "role", "d0", "d1"]
    held: dict[str, DataFrame] = {}

    def known(df: DataFrame, step: str) -> DataFrame:
        held["rows"] = keep(df, step)
        return held["rows"]

    ranked = with_rank(flagged, ["conv_id"], order, "rank", then=lambda d: d.withColumn("uid", F.monotonically_increasing_id()), keep=known)
    light = keep(ranked.select("conv_id", "turn", "rank", "uid", "d0", "d1", "blank", "cut", F.left("role", F.lit(1)).alias("initial")), "light")
    again = light.where("NOT blank").groupBy("conv_id", "d0", "d1").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = again.select(F.col("conv_id").alias("c"), F.col("d0").alias("e0"), F.col("d1").alias("e1"), "first")
    same = [F.col(x).eqNullSafe(F.col(y)) for x, y in (("conv_id", "c"), ("d0", "e0"), ("d1", "e1"))]
    seen = light.join(again, same, "left").select("conv_id", "turn", "rank", "uid", "blank", "cut", "initial", F.coalesce(F.col("rank") > F.col("first"), F.lit(False)).alias("twice"))
    kind = F.when(F.col("blank") | F.col("twice"), 2).when(F.col("cut"), 1).otherwise(0)
    place = F.coalesce(F.nullif(F.instr(F.lit("sua"), F.col("initial")) * (F.length("initial") == 1).cast("int"), F.lit(0)), F.lit(4))
    lettered = keep(seen.withColumn("letter", F.substring(F.lit(LETTERS), kind * 4 + place, F.lit(1))), "letters")

    number = lambda c: F.sum(c.cast("long"))
    counts = lettered.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"), number(F.col("blank")).alias("blank"),
        number(F.col("twice")).alias("duplicate"), number(~F.col("blank") & ~F.col("twice") & F.col("cut")).alias("truncated"),
    )
    chunks = lettered.groupBy("conv_id", F.floor(F.col("rank") / CHUNK).alias("at")).agg(F.array_sort(F.collect_list(F.struct("rank", "letter"))).alias("held"))
    chunks = chunks.select("conv_id", "at", F.array_join(F.transform("held", lambda x: x["letter"]), "").alias("letters"))
    nodes = keep(chunks.select("conv_id", "at", ((F.col("at") == 0) & (F.length("letters") < CHUNK)).alias("whole"), _chunks("letters").alias("node")), "nodes")
    done, parts = nodes.where("whole").select("conv_id", "node"), nodes.where("NOT whole").select("conv_id", "at", "node")
    while (parts.agg(F.max("at").alias("m")).first()["m"] or 0) > 0:
        groups = parts.groupBy("conv_id", F.floor(F.col("at") / FAN).alias("up")).agg(F.collect_list(F.struct("at", "node")).alias("nodes"))
        parts = keep(groups.select("conv_id", F.col("up").alias("at"), _products("nodes").alias("node")), "nodes")
    every = done.unionByName(parts.select("conv_id", "node")).select("conv_id", _verdicts("node").alias("v")).select("conv_id", "v.*")
    # both sides have one row for each conversation: summed up by it, they meet without a join on a null
    verdicts = counts.unionByName(every, allowMissingColumns=True).groupBy("conv_id").agg(*[F.max(c).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")])
    verdicts = keep(verdicts, "verdicts")

    edits = edits_of(verdicts)
    to = edits.join(lettered.select(F.col("conv_id").alias("c"), F.col("rank").alias("r"), "uid"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("rank") == F.col("r")), "left")
    texts = held["rows"].select("uid", "role", "text")
    return Repaired(verdicts, applied(to.select("conv_id", "uid", "edit", "place", "system").join(texts, "uid", "left")))


def applied(edits: DataFrame) -> DataFrame:
    """The turns that edits leave or insert."""
    own = F.right("edit", F.lit(1))
    before = F.length("edit") - (own != "I").cast("int")
    due = lambda place: F.when((place + F.col("system").cast("int")) % 2 == 0, "user").otherwise("assistant")
    made = lambda place, role, text, edit: F.struct(place.cast("long").alias("place"), role.alias("role"), text.alias("text"), edit.alias("edit"))
    added = F.transform(F.sequence(F.lit(1), before), lambda i: made(F.col("place") + i - 1, due(F.col("place") + i - 1), F.lit(""), F.lit("I")))
    here = F.col("place") + before
    kept = made(here, F.when(own == "K", F.col("role")).otherwise(due(here)), F.col("text"), own)
    none = F.array().cast("array<struct<place:long,role:string,text:string,edit:string>>")
    turns = F.concat(F.when(before > 0, added).otherwise(none), F.when(own.isin("K", "R"), F.array(kept)).otherwise(none))
    return edits.select("conv_id", F.explode(turns).alias("t")).select("conv_id", "t.*")


def digests(turns: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of its turns, `role:text` in lines. A hash has one order, so a conversation is one task's stream, sorted on disk."""
    kind = turns.schema["conv_id"].dataType
    schema = pa.schema([("conv_id", to_arrow_type(kind)), ("sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list[Any] = []  # the conversation and its hash so far
        for batch in batches:
            ids: list[Any] = []
            found: list[str] = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                line = f"{role}:{text}".encode()
                if now and now[0] == conv:
                    now[1].update(b"\n" + line)
                    continue
                if now:
                    ids.append(now[0])
                    found.append(now[1].hexdigest())
                now = [conv, hashlib.sha256(line)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, schema[0].type), pa.array(found, pa.string())], schema=schema)
        if now:
            yield pa.RecordBatch.from_arrays([pa.array(now[:1], schema[0].type), pa.array([now[1].hexdigest()])], schema=schema)

    dealt = turns.select("conv_id", "place", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return dealt.mapInArrow(run, f"conv_id {kind.simpleString()}, sha256 string")


def damage(rows: DataFrame, conv: str = "conv_id", turn_col: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations with faults, the same ones each time: the CRC-32 of `conv_id:turn` decides which. A null is one space."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(spaced(conv), F.lit(":"), spaced(turn_col))) % 20
    texts = F.when(how == 1, "").when(how == 2, F.translate(spaced(text), ".!?", "")).otherwise(spaced(text))
    base = rows.where(how != 0).select(F.col(conv).alias("conv_id"), F.col(turn_col).alias("turn"), F.when(how == 4, "user").otherwise(spaced(role)).alias("role"), texts.alias("text"), F.when(how == 3, 2).otherwise(1).alias("__n"))
    return base.withColumn("__n", F.explode(F.sequence(F.lit(1), "__n"))).drop("__n")


def repaired_digests(rows: DataFrame, damaged: DataFrame) -> DataFrame:
    """Every conversation of `rows` with its verdict after repair of `damaged`, and the digest of its repaired turns."""
    number = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    with scratch(rows.sparkSession, "repair") as keep:
        verdicts, turns = repair(damaged, keep=keep)
        parts = [rows.select("conv_id").distinct(), verdicts, digests(turns)]
        every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).groupBy("conv_id").agg(*[F.max(c).alias(c) for c in (*number, "audit", "sha256")])
        empty: Column = F.lit(hashlib.sha256(b"").hexdigest())
        return save(every.select("conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in number], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", empty).alias("repaired_sha256")), "repaired")


def op11_minplus_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repaired_digests(rows, damage(rows))


QUERIES = {"op11_minplus_repair": op11_minplus_repair}


def oracle() -> str:
    """DuckDB SQL of op11: turn by turn, the four states' least (cost, edits) as a padded cost with the edits behind it."""
    add = lambda s, n, e: f"lpad(CAST(CAST({s}[1:12] AS BIGINT) + {n} AS VARCHAR), 12, '0') || {s}[13:] || '{e}'"
    bit = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))"
    key = "COALESCE(CAST(conv_id AS VARCHAR), ' ') || ':' || COALESCE(CAST(turn AS VARCHAR), ' ')"
    crc = f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({key}, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: {bit})) % 20"
    free = lambda v: f"least({v}2, {add(f'{v}0', INSERT, 'I')}, {add(f'{v}1', INSERT, 'I')}, {add(f'{v}3', INSERT, 'I')}) AS w2, least({v}3, {add(f'{v}2', INSERT, 'I')}, {add(f'{v}0', 2 * INSERT, 'II')}, {add(f'{v}1', 2 * INSERT, 'II')}) AS w3"
    keep = lambda w, role: f"CASE WHEN ok AND initial = '{role}' THEN {add(w, 'late', 'K')} END"
    change = lambda w: f"CASE WHEN ok THEN {add(w, f'{REROLE} + late', 'R')} END"
    gone = lambda w: add(w, DELETE, "D")
    user = ", ".join(f"{keep(w, 'u')}, {change(w)}" for w in ("w0", "w1", "w3"))
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""WITH RECURSIVE h AS (SELECT conv_id, turn, COALESCE(role, ' ') AS role, COALESCE(text, ' ') AS text, {crc} AS how FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN how = 3 THEN 2 ELSE 1 END)) AS copy
FROM h WHERE how <> 0),
n AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) - 1 AS r, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, rtrim(text, {white}) AS t FROM d),
f AS (SELECT conv_id, turn, role, text, r, t = '' AS blank, t <> '' AND again AS twice, t <> '' AND NOT again AND right(t, 1) NOT IN ('.', '!', '?') AS cut, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY r) AS prior FROM n),
g AS (SELECT conv_id, r, initial, NOT blank AND NOT twice AS ok, CAST(cut AS INT) AS late FROM f),
dp AS (SELECT conv_id, CAST(0 AS BIGINT) AS r, CAST('000000000000' AS VARCHAR) AS v0, CAST(NULL AS VARCHAR) AS v1, CAST(NULL AS VARCHAR) AS v2, CAST(NULL AS VARCHAR) AS v3 FROM (SELECT DISTINCT conv_id FROM d)
UNION ALL SELECT conv_id, r + 1, {gone("w0")}, least({gone("w1")}, {keep("w0", "s")}), least({gone("w2")}, {user}), least({gone("w3")}, {keep("w2", "a")}, {change("w2")})
FROM (SELECT dp.conv_id, dp.r, ok, late, initial, v0 AS w0, v1 AS w1, {free("v")} FROM dp JOIN g ON dp.conv_id IS NOT DISTINCT FROM g.conv_id AND dp.r = g.r)),
best AS (SELECT conv_id, CAST(x[1:12] AS BIGINT) AS cost, x[13:] AS audit FROM (SELECT conv_id, least(v0, w3) AS x FROM (SELECT conv_id, v0, {free("v")}, r, max(r) OVER (PARTITION BY conv_id) AS m FROM dp) WHERE r = m)),
letters AS (SELECT conv_id, audit, unnest(string_split(audit, '')) AS e, unnest(range(1, length(audit) + 1)) AS i FROM best WHERE audit <> ''),
placed AS (SELECT conv_id, e, i, count(*) FILTER (e <> 'I') OVER w - CAST(e <> 'I' AS INT) AS r, count(*) FILTER (e <> 'D') OVER w - 1 AS place, count(*) FILTER (e <> 'D') OVER (PARTITION BY conv_id) % 2 AS sys FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
lines AS (SELECT placed.conv_id, i, CASE WHEN e = 'K' THEN role WHEN (place + sys) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END AS line
FROM placed LEFT JOIN f ON placed.conv_id IS NOT DISTINCT FROM f.conv_id AND placed.r = f.r WHERE e <> 'D'),
shas AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY i)) AS sha FROM lines GROUP BY conv_id),
sums AS (SELECT conv_id, COALESCE(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (twice) AS duplicate, count(*) FILTER (cut) AS truncated,
count(*) FILTER (prior IS NOT NULL AND prior || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT o.conv_id, CAST(COALESCE(gaps, 0) AS BIGINT) AS gaps, COALESCE(blank, 0) AS blank, COALESCE(duplicate, 0) AS duplicate, COALESCE(truncated, 0) AS truncated, COALESCE(illegal, 0) AS illegal,
COALESCE(cost, 0) AS cost, COALESCE(audit, '') AS audit, COALESCE(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN sums ON o.conv_id IS NOT DISTINCT FROM sums.conv_id LEFT JOIN best ON o.conv_id IS NOT DISTINCT FROM best.conv_id LEFT JOIN shas ON o.conv_id IS NOT DISTINCT FROM shas.conv_id"""


ORACLE_SQL = {"op11_minplus_repair": oracle()}
