"""Secret scans: three base patterns, and sliding-window entropy over candidate strings, in DataFrame functions alone."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Items of an array whose running values are worked out at once.
RUN = 64
#: kind: (pattern, group whose length counts, its least length)
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: Strings whose entropy is measured; for each character class its pattern, window and least bits a character.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
CLASSES = (("hex", r"^[0-9A-Fa-f]+$", 16, 3.0), ("mixed", r"^(?=.*[0-9])(?=.*[A-Za-z])", 20, 3.9))
#: Strings that look random and are none: alphabets, examples, UUIDs, paths. Repeated groups are possessive, as the
#: others take a stack frame for each repeat.
ALLOWED = (r"(?i)example|sample|placeholder|xxxx|abcdefgh|12345678|01234567", r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", r"^[A-Za-z]*+(?:/[A-Za-z0-9_-]{1,16})++/?$", r"(?i)^[a-z]++(?:[_-][a-z]++)++[0-9]{0,4}$")


def _quoted(text: str) -> str:
    """A SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """SQL for body, with value worked out once under a name."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _running(items: str, value: str, merge: str) -> str:
    """SQL for the running values, from 0 on, of merge (of a and b) over value (of item x), each with its own item
    included. Arrays grow by copies, so runs of RUN items are worked out by themselves, then their last values."""
    into = lambda b: merge.replace("$b", b)
    none = "cast(array() AS array<int>)"
    runs = f"transform(sequence(0, cast((size({items}) - 1) div {RUN} AS int)), k -> slice({items}, k * {RUN} + 1, {RUN}))"
    inner = f"transform({runs}, run -> aggregate(run, struct(0 AS a, {none} AS done), (s, x) -> {_let('v', value, f'struct({into("v")} AS a, concat(s.done, array({into("v")})) AS done)')}, s -> s.done))"
    outer = f"aggregate(inner, struct(0 AS a, {none} AS done), (s, y) -> {_let('v', 'element_at(y, -1)', f'struct({into("v")} AS a, concat(s.done, array(s.a)) AS done)')}, s -> s.done)"
    body = f"flatten(transform(inner, (y, k) -> {_let('s', 'struct(before[k] AS a)', f'transform(y, v -> {into("v")})')}))"
    return f"CASE WHEN size({items}) = 0 THEN {none} ELSE {_let('inner', inner, _let('before', outer, body))} END"


def _matches(text: str, pattern: str, group: int) -> str:
    """SQL for the matches of a pattern, in order, as an array of (start, end, part): ends are exclusive, in code points;
    part is the group's text. Ends are the running sums of the lengths of what splitting by the same pattern leaves
    and of the matches: both find the same leftmost, non-overlapping matches."""
    p = _quoted(pattern)
    steps = f"zip_with(slice(split({text}, {p}, -1), 1, size(found)), found, (g, m) -> length(g) + length(m))"
    part = "m" if group == 0 else "parts[i]"
    spans = f"transform(found, (m, i) -> struct(ends[i] - length(m) AS start, ends[i] AS end, {part} AS part))"
    if group:
        spans = _let("parts", f"regexp_extract_all({text}, {p}, {group})", spans)
    spans = _let("ends", _let("steps", steps, _running("steps", "x", "s.a + $b")), spans)
    return _let("found", f"regexp_extract_all({text}, {p}, 0)", f"CASE WHEN size(found) > 0 THEN {spans} ELSE cast(array() AS array<struct<start: int, end: int, part: string>>) END")


def _entropy(text: str, window: int) -> str:
    """SQL for the largest entropy, in bits, of `window` characters in a row of a text. The counts of its characters
    within the window, and the sum of c log c over them, are kept as the window slides: what leaves takes its count
    down by one, what enters up by one. Sums are whole numbers of 2 ** -40, so that no error adds up."""
    one = 2**40
    log = f"array({', '.join(f'{round(c * math.log2(c) * one) if c else 0}L' for c in range(window + 2))})"
    come, gone = "codes[i]", f"get(codes, i - {window})"
    enter = f"{log}[s.counts[{come}] + 1] - {log}[s.counts[{come}]]"
    leave = f"{log}[s.counts[{gone}] - 1] - {log}[s.counts[{gone}]]"
    total = f"s.sum + CASE WHEN {gone} IS NULL THEN {enter} WHEN {gone} = {come} THEN 0L ELSE {enter} + {leave} END"
    counts = f"CASE WHEN {gone} = {come} THEN s.counts ELSE transform(s.counts, (c, k) -> CASE WHEN k = {come} THEN c + 1 WHEN k = {gone} THEN c - 1 ELSE c END) END"
    step = _let("t", total, f"struct(t AS sum, CASE WHEN i >= {window - 1} THEN least(s.low, t) ELSE s.low END AS low, {counts} AS counts)")
    lowest = f"aggregate(sequence(0, size(codes) - 1), struct(0L AS sum, {2**62}L AS low, array_repeat(0, size(kinds)) AS counts), (s, i) -> {step}, s -> s.low)"
    codes = "transform(chars, c -> cast(array_position(kinds, c) AS int) - 1)"
    least = _let("chars", f"split({text}, '')", _let("kinds", "array_distinct(chars)", _let("codes", codes, lowest)))
    return f"(log2({window}) - ({least}) / {float(one) * window}D)"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", candidate: str = CANDIDATE, classes: Sequence[tuple] = CLASSES, allowed: Sequence[str] = ALLOWED) -> DataFrame:
    """id_col and spans, an array of (start, rank, kind, end) in the order of start, then kind (rank: assign, access,
    hex, entropy), of each row; ends are exclusive, in code points. There is no shuffle.

    Base kinds are found leftmost and without overlap within a kind, and then dropped where too short. A candidate
    string is an `entropy` span if it overlaps no base span, no allowed pattern is found in it and, for the first
    character class whose pattern it has, a window's entropy reaches the class's (within 1e-9). Work grows with the
    text's length, whatever the length and number of its strings: base spans are looked up by halving. Null texts count
    as empty and have no spans; repeated rows are scanned each; empty tables give no rows; other columns are not read."""
    df = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    kinds = [f"transform(filter({_matches('t', p, group)}, x -> length(x.part) >= {least}), x -> struct(x.start AS start, {rank} AS rank, '{kind}' AS kind, x.end AS end))" for rank, (kind, (p, group, least)) in enumerate(BASE.items())]
    refused = " OR ".join(f"regexp_like(x.part, {_quoted(p)})" for p in allowed) or "false"
    random = "CASE " + " ".join(f"WHEN regexp_like(x.part, {_quoted(p)}) THEN length(x.part) >= {w} AND {_entropy('x.part', w)} >= {bits - 1e-9}D" for _, p, w, bits in classes) + " ELSE false END"
    # Of the base spans that start before a string's end, the furthest end tells whether any reaches into it.
    half = "cast((r.low + r.high) div 2 AS int)"
    before = f"aggregate(sequence(1, cast(ceil(log2(size(base) + 1)) AS int)), struct(0 AS low, size(base) AS high), (r, j) -> CASE WHEN r.low >= r.high THEN r WHEN base[{half}].start < x.end THEN struct({half} + 1 AS low, r.high AS high) ELSE struct(r.low AS low, {half} AS high) END, r -> r.low)"
    met = f"size(base) > 0 AND {_let('n', before, 'n > 0 AND reach[n - 1] > x.start')}"
    more = f"transform(filter({_matches('t', candidate, 0)}, x -> NOT ({met}) AND NOT ({refused}) AND ({random})), x -> struct(x.start AS start, {len(BASE)} AS rank, 'entropy' AS kind, x.end AS end))"
    spans = _let("base", f"sort_array(concat({', '.join(kinds)}))", _let("reach", _running("base", "x.end", "greatest(s.a, $b)"), f"sort_array(concat(base, {more}))"))
    return df.select(F.col("id").alias(id_col), F.expr(spans).alias("spans"))


def listed(spans: str, only_base: bool = False) -> Column:
    """kind:start:end of spans, comma-joined."""
    some = f"filter({spans}, x -> x.rank < {len(BASE)})" if only_base else spans
    return F.expr(f"array_join(transform({some}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')")
