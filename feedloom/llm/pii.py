"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust a score.

Everything is a column expression: no Python runs in tasks. Offsets are code
points, ends exclusive. Patterns use possessive quantifiers and start only
where a run of their characters starts, so that long runs cost no more than
their length and no stack; places are summed up in chunks and read from pieces
of the text, so that time grows with a text's length and matches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

#: Code points on each side of a span in which context words count.
NEAR = 40
#: Elements of an array that are summed up at a time, and code points of a text's pieces.
CHUNK, BLOCK = 64, 512
#: Spans of the kinds beyond the base need this score; base spans stay whatever theirs is.
LEAST_SCORE = 0.6


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    hint: str  # a text without it has no match
    score: float
    words: str
    base: bool = True


LOCAL = "A-Za-z0-9._%+-"
KINDS = (
    Kind("email", rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, r"mail|contact|write to"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "[0-9][.][0-9]", 0.6, r"\bip\b|address|host|server|login"),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", "(?:[0-9][ -]?){15}[0-9]", 0.8, r"card|credit|debit|visa|master|payment|expir"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "[+][0-9]", 0.6, r"phone|tel|mobile|call|fax|whatsapp"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", 0.7, r"iban|bank|account|transfer|bic|swift", base=False),
    Kind("ssn", r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])", "[0-9]-[0-9]{2}-[0-9]", 0.4, r"\bssn\b|social security|taxpayer", base=False),
)
BASE = tuple(k.name for k in KINDS if k.base)
NOT_PERSONAL = r"example only|dummy|placeholder|version|order no|invoice no|serial"
SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


# Expressions are put together as SQL text: a few thousand calls for each query would take seconds.


def digits(found: str) -> str:
    return f"regexp_replace({found}, '[^0-9]', '')"


def luhn(found: str) -> str:
    """Whether the digits pass the mod-10 check."""
    digit = "CAST(substr(number, i, 1) AS INT)"
    worth = f"IF(i % 2 = 1, {digit}, 2 * {digit} - IF({digit} > 4, 9, 0))"
    return let(f"reverse({digits(found)})", "number", f"aggregate(sequence(1, length(number)), 0, (a, i) -> a + {worth}) % 10 = 0")


def mod97(found: str) -> str:
    """Whether an IBAN's remainder is 1, letter by letter: the number itself would have up to 60 digits."""
    code = "ascii(substr(turned, i, 1))"
    step = f"IF({code} < 65, (a * 10 + {code} - 48) % 97, (a * 100 + {code} - 55) % 97)"
    whole = let("concat(substr(flat, 5), substr(flat, 1, 4))", "turned", f"aggregate(sequence(1, length(turned)), 0, (a, i) -> {step}) = 1")
    return let(f"replace({found}, ' ', '')", "flat", f"length(flat) BETWEEN 15 AND 34 AND {whole}")


def valid(kind: str, found: str) -> str:
    n = f"length({digits(found)})"
    tests = {
        "ip": f"forall(split({found}, '[.]'), part -> CAST(part AS DOUBLE) <= 255)",
        "card": f"IF({n} BETWEEN 16 AND 19, {luhn(found)}, false)",
        "phone": f"{n} BETWEEN 8 AND 15",
        "iban": mod97(found),
        "ssn": f"NOT ({found} RLIKE '^(?:000|666|9..)|-00-|-0000$')",
    }
    return tests.get(kind, "true")


def let(value: str, name: str, then: str) -> str:
    """A value that is worked out once, however often it is used: inside a lambda an expression would be for each element."""
    return f"element_at(transform(array({value}), {name} -> {then}), 1)"


def running(values: str, add: str) -> str:
    """Of an array (a lambda's variable) that isn't empty: what `add`, of a and x, makes, from 0 on, of the elements before each one.
    Sums of chunks, and of chunks of these, bound what one element costs, so time grows with the array's length."""
    fold = lambda xs, start, n: f"aggregate(slice({xs}, {start} + 1, {n}), 0, (a, x) -> {add})"
    sums = lambda xs: f"transform(sequence(0, (size({xs}) - 1) DIV {CHUNK}), c -> {fold(xs, f'CAST(c AS INT) * {CHUNK}', CHUNK)})"
    inside = lambda xs, starts: f"transform({xs}, (o, i) -> aggregate(slice({xs}, CAST(i DIV {CHUNK} AS INT) * {CHUNK} + 1, i % {CHUNK}), get({starts}, CAST(i DIV {CHUNK} AS INT)), (a, x) -> {add}))"
    ahead = f"transform(two, (o, i) -> {fold('two', '0', 'i')})"
    return let(sums(values), "one", let(sums("one"), "two", let(ahead, "far", let(inside("one", "far"), "near", inside(values, "near")))))


def blocks(text: str) -> str:
    """The text in pieces of BLOCK code points: reaching a place in it by `cut` then costs no more than a piece."""
    return f"regexp_extract_all({text}, '(?s).{{1,{BLOCK}}}', 0)"


def cut(held: str, start: str, n: str) -> str:
    """n code points of a text in blocks, from start (0 is the first) on."""
    first = f"CAST(({start}) DIV {BLOCK} AS INT)"
    return f"substr(array_join(slice({held}, {first} + 1, CAST(({start} + {n}) DIV {BLOCK} AS INT) - {first} + 1), ''), ({start}) % {BLOCK} + 1, {n})"


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def proposals(text: str, pattern: str) -> str:
    """array<struct<start, end, found>> of a pattern's leftmost matches: the texts between them, and they, give the places."""
    spot = "transform(found, (f, i) -> named_struct('start', get(ends, i) + length(get(gaps, i)), 'end', get(ends, i) + get(steps, i), 'found', f))"
    steps = let("transform(found, (f, i) -> length(get(gaps, i)) + length(f))", "steps", let(running("steps", "a + x"), "ends", spot))
    some = let(f"split({text}, {quoted(pattern)}, -1)", "gaps", steps)
    return let(f"regexp_extract_all({text}, {quoted(pattern)}, 0)", "found", f"IF(size(found) > 0, {some}, CAST(array() AS array<struct<start:int,end:int,found:string>>))")


def score(held: str, kind: Kind, span: str) -> str:
    begin = f"greatest({span}.start - {NEAR}, 0)"
    near = f"lower(concat({cut(held, begin, f'({span}.start - {begin})')}, ' ', {cut(held, f'{span}.end', str(NEAR))}))"
    return let(near, "near", f"round(least(1.0D, {kind.score}D + IF(near RLIKE {quoted(kind.words)}, 0.3D, 0.0D)) - IF(near RLIKE {quoted(NOT_PERSONAL)}, 0.3D, 0.0D), 2)")


def spans_of(text: str, kind: Kind) -> str:
    """The confirmed spans of one kind; matches that fail are dropped without another try."""
    none = f"CAST(array() AS {SPAN})"
    one = f"named_struct('kind', '{kind.name}', 'start', p.start, 'end', p.end, 'score', {score('held', kind, 'p')})"
    scored = f"IF(size(ps) > 0, {let(blocks(text), 'held', f'transform(ps, p -> {one})')}, {none})"
    found = let(f"filter({proposals(text, kind.pattern)}, q -> {valid(kind.name, 'q.found')})", "ps", scored)
    kept = found if kind.base else f"filter({found}, s -> s.score >= {LEAST_SCORE}D)"
    return f"IF({text} RLIKE {quoted(kind.hint)}, {kept}, {none})"


def find_pii(docs: DataFrame, text_col: str = "text", out: str = "spans") -> DataFrame:
    """Adds the spans (kind, start, end, score) of each text, by kind as in KINDS and then by start; replaces a column of that name.

    A null or empty text has none. Rows are judged one by one: repeated rows
    get the same spans, other columns don't matter, an empty table stays empty.
    """
    text = f"coalesce(`{text_col}`, '')"
    return docs.withColumn(out, F.expr(f"concat({', '.join(spans_of(text, k) for k in KINDS)})"))


def redacted(text: str, spans: str) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    gap = cut("held", "get(done, i)", "(s.start - get(done, i))")
    parts = f"transform(every, (s, i) -> IF(s.start >= get(done, i), concat({gap}, '[', upper(s.kind), ']'), ''))"
    whole = let("greatest(element_at(done, -1), element_at(every, -1).end)", "last", f"concat(array_join({parts}, ''), {cut('held', 'last', f'(length({text}) - last)')})")
    reach = let("transform(every, s -> s.end)", "stops", running("stops", "greatest(a, x)"))  # up to where the spans before each one go
    first = f"array_sort(transform({spans}, s -> named_struct('start', s.start, 'end', s.end, 'kind', s.kind)))"
    return f"IF(size({spans}) > 0, {let(first, 'every', let(reach, 'done', let(blocks(text), 'held', whole)))}, {text})"


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the personal data in their texts replaced; null texts stay null."""
    found = find_pii(docs, text_col, "__spans")
    return found.withColumn(text_col, F.expr(redacted(f"`{text_col}`", "__spans"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_checked_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    of_kind = lambda name: F.filter("spans", lambda s: s["kind"] == name)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


QUERIES = {"op7_checked_spans": op7_checked_spans}


def _spans_sql(kind: str, pattern: str, test: str) -> str:
    pattern = pattern.replace("'", "''")
    return f"""{kind} AS (SELECT doc_id, '{kind}:' || (b - 1) || ':' || (b - 1 + length(m)) AS span, b FROM (
  SELECT doc_id, unnest(m) AS m, unnest(list_transform(range(1, len(m) + 1), lambda i: CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + COALESCE(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) + 1 AS BIGINT))) AS b
  FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g FROM docs)) WHERE {test})"""


def oracle() -> str:
    """DuckDB SQL of op7's base spans; spans of the further kinds are tested against a brute-force version, and the given tables hold none."""
    d = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn_sql = f"list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(reverse({d}), i, 1) AS INT) ELSE (2 * CAST(substr(reverse({d}), i, 1) AS INT)) // 10 + (2 * CAST(substr(reverse({d}), i, 1) AS INT)) % 10 END)) % 10 = 0"
    parts = [
        _spans_sql("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        _spans_sql("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda x: CAST(x AS DOUBLE) > 255)) = 0"),
        _spans_sql("card", r"[0-9](?:[\x20-]?[0-9])+", f"CASE WHEN length({d}) BETWEEN 16 AND 19 THEN {luhn_sql} ELSE false END"),
        _spans_sql("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({d}) BETWEEN 8 AND 15"),
    ]
    union = " UNION ALL ".join(f"SELECT doc_id, {i} AS k, span, b FROM {name}" for i, name in enumerate(BASE))
    counts = ", ".join(f"COALESCE(count(*) FILTER (WHERE k = {i}), 0) AS n_{name}" for i, name in enumerate(BASE))
    return f"""WITH docs AS (SELECT doc_id, COALESCE(text, '') AS t FROM documents), {', '.join(parts)},
every AS ({union}), found AS (SELECT doc_id, {counts}, string_agg(span, ',' ORDER BY k, b) AS spans FROM every GROUP BY doc_id)
SELECT doc_id, {', '.join(f'COALESCE(n_{n}, 0) AS n_{n}' for n in BASE)}, sha256(COALESCE(spans, '')) AS base_sha256, COALESCE(spans, '') AS spans FROM docs LEFT JOIN found USING (doc_id)"""


ORACLE_SQL = {"op7_checked_spans": oracle()}
