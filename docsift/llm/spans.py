"""Positions of regular expression matches with SQL functions only.

Spark's functions give the matches of a pattern and the pieces between them, but no
positions; the positions are running sums of their lengths."""

from __future__ import annotations

PART = 256


def running_sum(array: str) -> str:
    """SQL for the running sums of an array of bigint, by parts of ``PART`` so that long
    arrays aren't copied for every element."""
    zero = "cast(array() as array<bigint>)"
    sums = f"aggregate(p, {zero}, (a, x) -> concat(a, array(coalesce(try_element_at(a, -1), 0L) + x)))"
    parts = f"transform(sequence(0, cast((size({array}) - 1) / {PART} as int)), i -> slice({array}, i * {PART} + 1, {PART}))"
    local = f"transform({parts}, p -> {sums})"
    return (
        f"CASE WHEN size({array}) = 0 THEN {zero} ELSE aggregate({local}, named_struct('base', 0L, 'out', array({zero})), "
        f"(s, l) -> named_struct('base', s.base + element_at(l, -1), 'out', concat(s.out, array(transform(l, x -> x + s.base)))), "
        "s -> flatten(s.out)) END"
    )


def quoted(pattern: str) -> str:
    """A raw SQL string literal."""
    if '"' not in pattern:
        return f'r"{pattern}"'
    if "'" not in pattern:
        return f"r'{pattern}'"
    return "concat(" + ", ".join("r'\"'" if p == '"' else f'r"{p}"' for p in _apart(pattern)) + ")"


def _apart(text: str):
    rest = text.split('"')
    for i, p in enumerate(rest):
        if i:
            yield '"'
        if p:
            yield p


def add_matches(df, name: str, text: str, pattern: str, group: int = 0):
    """Adds the array column ``name`` of (start, stop, value) of all matches of ``pattern`` in
    the column ``text``, in code points; value is the match or the given group of it. Texts
    without a match take one scan."""
    from pyspark.sql import functions as F

    p = quoted(pattern)
    m, v, e = f"__{name}_m", f"__{name}_v", f"__{name}_e"
    has = f"{text} rlike {p}"
    none = "cast(array() as array<string>)"
    df = df.withColumn(m, F.expr(f"CASE WHEN {has} THEN regexp_extract_all({text}, {p}, 0) ELSE {none} END"))
    if group:
        df = df.withColumn(v, F.expr(f"CASE WHEN size({m}) > 0 THEN regexp_extract_all({text}, {p}, {group}) ELSE {none} END"))
    pieces = f"split({text}, {p}, -1)"
    lengths = f"zip_with(slice({pieces}, 1, size({m})), {m}, (a, b) -> cast(length(a) + length(b) as bigint))"
    df = df.withColumn(e, F.expr(f"CASE WHEN size({m}) > 0 THEN {lengths} ELSE cast(array() as array<bigint>) END"))
    df = df.withColumn(e, F.expr(running_sum(e)))
    spans = f"transform({m}, (x, i) -> named_struct('start', get({e}, i) - length(x), 'stop', get({e}, i), 'value', {f'get({v}, i)' if group else 'x'}))"
    return df.withColumn(name, F.expr(spans)).drop(m, v, e)
