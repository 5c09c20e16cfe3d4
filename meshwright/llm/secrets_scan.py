"""Secret scan: fixed patterns, and sliding-window Shannon entropy over candidate strings.

DataFrame functions only. The positions of all matches of a pattern follow from
the lengths of the matches and of the gaps between them. The entropy of a window
is log2(W) - S / W with S the sum of c * log2(c) over its character counts c; a step to
the next window changes two counts, and S by four table values. The table is in
millionths of a bit, as integers, so the running sum is exact. Counts are packed,
twelve characters to a long, so a step costs the same in every alphabet; the
counts of six kinds of characters, in one more long, tell each window's character
class, which sets the entropy that it needs.

No pattern repeats a group, which Java would match by recursion.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns in their order, the number of characters that a match (assign: its value) needs at least.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_CHARS = 6
KINDS = ("assign", "access", "hex", "entropy")
# The entropy scan: candidates, their characters, the window.
CANDIDATE = r"[A-Za-z0-9+/_=-]{24,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 24
#: The classes of windows, the first that fits counts: a pattern of all its characters, and the bits a character that count as random there (null: never).
CLASSES = (
    ("decimal", "^[0-9]+$", None),
    ("hex", "^[0-9a-f]+$|^[0-9A-F]+$", 3.05),
    ("letters", "^[A-Za-z]+$", 4.2),
    ("one case", "^[0-9a-z]+$|^[0-9A-Z]+$", 3.75),
    ("mixed", "", 3.95),
)
#: Candidates that are never secrets: words, numbers, ruled lines and the usual placeholders,
ALLOWED = r"^[A-Z]?[a-z]+$|^[A-Z]+$|^[0-9]+$|^[-_=+/]+$|EXAMPLE|ABCDEFGHIJKLMNOPQRSTUVWXYZ|abcdefghijklmnopqrstuvwxyz|0123456789"
#: and words that single marks join: what the first pattern matches and the second doesn't.
JOINED_WORDS, DOUBLE_MARK = r"^[A-Za-z][A-Za-z/_-]*[A-Za-z]$", r"[-_/][-_/]"

_PART = [round(c * math.log2(c) * 1e6) if c else 0 for c in range(WINDOW + 1)]


def _most(bits: float) -> int:
    """The largest S that a window of at least ``bits`` a character has."""
    return math.floor((math.log2(WINDOW) - bits) * WINDOW * 1e6)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


SPAN = "array<struct<start:int,end:int,found:string>>"


BLOCK = 512


def _located(text: str, pattern: str) -> Column:
    """SQL: the (start, end, found) of all matches of a pattern in a column, in order, in code points, end exclusive.

    Gaps and matches are added up by blocks first, then within each block, so that
    no array grows by one element at a time over a very long text.
    """
    p = _quoted(pattern)
    length = "length(x['0']) + coalesce(length(x['1']), 0)"
    inside = f"""aggregate(k, named_struct('at', get(starts, i), 'out', cast(array() as {SPAN})), (a, x) -> named_struct(
          'at', a.at + {length},
          'out', CASE WHEN x['1'] IS NULL THEN a.out ELSE concat(a.out, array(named_struct('start', a.at + length(x['0']), 'end', a.at + {length}, 'found', x['1']))) END), a -> a.out)"""
    starts = f"""aggregate(blocks, named_struct('at', 0, 'out', cast(array() as array<int>)), (a, k) -> named_struct(
          'at', a.at + aggregate(k, 0, (n, x) -> n + {length}), 'out', concat(a.out, array(a.at))), a -> a.out)"""
    return F.expr(f"""
      CASE WHEN {text} RLIKE {p} THEN
        get(transform(array(arrays_zip(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0))), z ->
        get(transform(array(transform(sequence(0, (size(z) - 1) div {BLOCK}), b -> slice(z, cast(b * {BLOCK} + 1 as int), {BLOCK}))), blocks ->
        get(transform(array({starts}), starts -> flatten(transform(blocks, (k, i) -> {inside}))), 0)), 0)), 0)
      ELSE cast(array() as {SPAN}) END""")


KINDS_OF = ("ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "abcdef", "ghijklmnopqrstuvwxyz", "0123456789", "+/_=-")
PACKED = 12  # counts of five bits in a long


def _class_limit(g: str) -> str:
    """SQL: the largest S of a random window, from the packed counts of the kinds of its characters."""
    upper_hex, upper, lower_hex, lower, digit, mark = (31 << 5 * k for k in range(6))
    no = lambda *kinds: f"({g} & {sum(kinds)}L) = 0"
    tests = {
        "decimal": no(upper_hex, upper, lower_hex, lower, mark),
        "hex": f"{no(upper, lower, mark, upper_hex)} OR {no(upper, lower, mark, lower_hex)}",
        "letters": no(digit, mark),
        "one case": f"{no(mark, upper_hex, upper)} OR {no(mark, lower_hex, lower)}",
    }
    limit = {name: -1 if bits is None else _most(bits) for name, _, bits in CLASSES}
    return "CASE " + " ".join(f"WHEN {tests[n]} THEN {limit[n]}L" for n in tests) + f" ELSE {limit['mixed']}L END"


def _random_part(c: str) -> str:
    """SQL: (first, last), in characters of candidate ``c``: from the first random window to the end of the last; nulls if none is.

    A step puts the next character into the counts, takes out the one that the
    window leaves behind, and judges the window that stood before it.
    """
    table = ", ".join(f"{x}L" for x in _PART)
    kind = {ch: k for k, own in enumerate(KINDS_OF) for ch in own}
    kinds = ", ".join(f"{1 << 5 * kind[ch]}L" for ch in ALPHABET)
    codes = f"transform(regexp_extract_all({c}.found, '.', 0), h -> locate(h, '{ALPHABET}') - 1)"
    code, out = "get(v.codes, i - 1)", f"if(i > {WINDOW}, get(v.codes, i - {WINDOW} - 1), -1)"
    f = lambda n: f"get(v.part, {n})"
    unit = lambda k: f"shiftleft(1L, 5 * ({k} % {PACKED}))"
    count = lambda k: f"cast(shiftright(get(a.n, cast({k} div {PACKED} as int)), 5 * ({k} % {PACKED})) & 31L as int)"
    n_in, n_out = count("x.c"), count("x.o")
    hit = f"i > {WINDOW} AND a.s <= {_class_limit('a.g')}"
    # a window with both characters in it never holds more than 25 of one, so five bits are enough
    step = f"""get(transform(array(named_struct('c', {code}, 'o', {out})), x -> named_struct(
          'n', if(x.c IS NULL OR x.c = x.o, a.n, transform(a.n, (n, k) -> n + if(k = x.c div {PACKED}, {unit('x.c')}, 0L) - if(x.o >= 0 AND k = x.o div {PACKED}, {unit('x.o')}, 0L))),
          'g', if(x.c IS NULL, a.g, a.g + get(v.kinds, x.c) - if(x.o < 0, 0L, get(v.kinds, x.o))),
          's', a.s + CASE WHEN x.c IS NULL OR x.c = x.o THEN 0L
                     ELSE {f(f"{n_in} + 1")} - {f(n_in)} - if(x.o < 0, 0L, {f(n_out)} - {f(f"{n_out} - 1")}) END,
          'first', if({hit}, coalesce(a.first, i - 1 - {WINDOW}), a.first),
          'last', if({hit}, i - 1, a.last))), 0)"""
    return f"""
      get(transform(array(named_struct('codes', {codes}, 'part', array({table}), 'kinds', array({kinds}))), v -> aggregate(
        sequence(1, size(v.codes) + 1),
        named_struct('n', array_repeat(0L, {-(-len(ALPHABET) // PACKED)}), 'g', 0L, 's', 0L, 'first', cast(null as int), 'last', cast(null as int)),
        (a, i) -> {step},
        a -> named_struct('first', a.first, 'last', a.last))), 0)"""


def _allowed(c: str, matches) -> str:
    """SQL: whether a candidate is on the allow-list, by an engine's way to say that a pattern matches somewhere."""
    return f"{matches(c, ALLOWED)} OR ({matches(c, JOINED_WORDS)} AND NOT {matches(c, DOUBLE_MARK)})"


def _joined(spans: str, kinds: tuple[str, ...]) -> Column:
    """SQL: structs (start, kind, end) as text, by start and then kind."""
    names = ", ".join(f"'{k}'" for k in kinds)
    return F.expr(f"array_join(transform(array_sort({spans}), x -> concat_ws(':', get(array({names}), x.kind), x.start, x.end)), ',')")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of secrets: ``id`` and arrays of (start, end, found): ``assign``, ``access``, ``hex``, ``entropy``.

    Offsets are code points, the end is exclusive. Every pattern takes its leftmost
    matches that do not overlap; an assignment counts if its value has at least 6
    characters. An entropy span reaches from the first to the last window of 24
    characters in a candidate that has at least the entropy of its class: 3.05 bits
    a character for hex digits of one case, 3.75 for digits and letters of one
    case, 3.95 for others, 4.2 for letters alone; digits alone never count.
    Allow-listed candidates have none. Null and empty texts have no span, an empty
    table gives an empty one, a text of any length is scanned whole. Spans of one
    kind can't tie; null ids stay null; repeated rows come back once each; other
    columns are ignored, whatever their names.
    """
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    rows = rows.select("id", _located("text", ASSIGN).alias("assign"), _located("text", ACCESS).alias("access"), _located("text", HEX).alias("hex"), _located("text", CANDIDATE).alias("candidates"))
    value = f"length(regexp_extract(x.found, {_quoted('^(?:' + ASSIGN + ')$')}, 2)) >= {ASSIGN_CHARS}"
    rows = rows.withColumn("assign", F.expr(f"filter(assign, x -> {value})"))
    rows = rows.withColumn("candidates", F.expr(f"filter(candidates, x -> NOT ({_allowed('x.found', lambda c, p: f'{c} RLIKE {_quoted(p)}')}))"))
    rows = rows.withColumn("parts", F.expr(f"transform(candidates, c -> named_struct('c', c, 'p', {_random_part('c')}))"))
    entropy = "transform(filter(parts, x -> x.p.first IS NOT NULL), x -> named_struct('start', x.c.start + x.p.first, 'end', x.c.start + x.p.last, 'found', substring(x.c.found, x.p.first + 1, x.p.last - x.p.first)))"
    return rows.select("id", "assign", "access", "hex", F.expr(entropy).alias("entropy"))


def digest(found: DataFrame) -> DataFrame:
    """Counts, the SHA-256 of the base spans and all spans as text, for each row of ``scan``."""
    tag = lambda kind, k: f"transform({kind}, x -> named_struct('start', x.start, 'kind', {k}, 'end', x.end))"
    base = f"concat({tag('assign', 0)}, {tag('access', 1)}, {tag('hex', 2)})"
    count = lambda k: F.size(k).cast("long").alias(f"n_{k}")
    return found.select(F.col("id").alias("doc_id"), count("assign"), count("access"), count("hex"), F.sha2(_joined(base, KINDS[:3]), 256).alias("base_sha256"), _joined(f"concat({base}, {tag('entropy', 3)})", KINDS).alias("spans"))


def _oracle() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    at = lambda kind, k, p: f"""
      SELECT doc_id, {k} AS kind, found, CAST(sum(length(gap) + length(found)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS stop FROM (
        SELECT doc_id, unnest(f) AS found, unnest(g[1:len(f)]) AS gap, generate_subscripts(f, 1) AS i FROM (
          SELECT doc_id, regexp_extract_all(text, {q(p)}) AS f, string_split_regex(text, {q(p)}) AS g FROM d) WHERE len(f) > 0)"""  # noqa: E731
    table = "[" + ", ".join(map(str, _PART)) + "]"
    limits = " ".join(f"WHEN regexp_matches(substr(found, o + 1, {WINDOW}), {q(p)}) THEN {-1 if bits is None else _most(bits)}" for _, p, bits in CLASSES)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
base AS (
  SELECT doc_id, kind, stop - length(found) AS start, stop FROM ({at('assign', 0, ASSIGN)}) WHERE length(regexp_extract(found, {q('^(?:' + ASSIGN + ')$')}, 2)) >= {ASSIGN_CHARS}
  UNION ALL SELECT doc_id, kind, stop - length(found), stop FROM ({at('access', 1, ACCESS)})
  UNION ALL SELECT doc_id, kind, stop - length(found), stop FROM ({at('hex', 2, HEX)})
), cand AS (
  SELECT doc_id, found, stop - length(found) AS start, row_number() OVER () AS c FROM ({at('entropy', 3, CANDIDATE)}) WHERE NOT ({_allowed('found', lambda c, p: f'regexp_matches({c}, {q(p)})')})
), win AS (
  SELECT c, doc_id, start, found, unnest(range(0, length(found) - {WINDOW} + 1)) AS o FROM cand
), sums AS (
  SELECT c, o, sum(({table})[n + 1]) AS s FROM (SELECT c, o, ch, count(*) AS n FROM (SELECT c, o, unnest(string_split(substr(found, o + 1, {WINDOW}), '')) AS ch FROM win) GROUP BY c, o, ch) GROUP BY c, o
), entropy AS (
  SELECT any_value(cand.doc_id) AS doc_id, 3 AS kind, any_value(cand.start) + min(o) AS start, any_value(cand.start) + max(o) + {WINDOW} AS stop
  FROM sums JOIN cand USING (c) WHERE s <= CASE {limits} END GROUP BY c
), spans AS (
  SELECT *, (['assign', 'access', 'hex', 'entropy'])[kind + 1] || ':' || start || ':' || stop AS t FROM (SELECT * FROM base UNION ALL SELECT * FROM entropy)
)
SELECT d.doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
  sha256(coalesce(string_agg(t, ',' ORDER BY start, kind) FILTER (WHERE kind < 3), '')) AS base_sha256, coalesce(string_agg(t, ',' ORDER BY start, kind), '') AS spans
FROM d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id
"""


ORACLE = _oracle()
