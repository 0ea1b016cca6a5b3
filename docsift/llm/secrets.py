"""Operator 3: secrets by patterns and by sliding-window entropy, with SQL functions only.

Base kinds are assignments, access keys and hex strings. The method looks at every run of 20
or more token characters: a window of ``WINDOW`` characters slides over it, and at each step
one character enters and one leaves. With g(c) = c log2 c, the entropy is log2 W - sum g(count)
/ W, so only the two changed terms of the sum are touched: the step's increment follows from
the counts of these two characters among the window's others, and the sums are running sums of
the increments. g is a table of integers, so sums are exact; the work is linear in a run. The threshold depends on the run's character class:
hex digits, a mixture with letters and digits, or letters without digits; digits alone are no
secret. Windows over the threshold are merged. Windows that touch a string of ``KNOWN``, and
spans inside a base span, are left out; the rest of such a run is judged like any other.

There is no shuffle: each row is judged on its own."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spans import add_matches, quoted, running_sum

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"  # whole runs of hex digits, of 24 characters or more

WINDOW = 20
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
# A character of a known string has the code after the alphabet's.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
BLANK = len(ALPHABET)
# Least bits a character in a window, by character class (fixed values).
HEX_BITS, MIXED_BITS = 3.0, 3.75
# Of 20 characters 17 must differ, which words and names joined without digits don't reach.
LETTER_BITS = 4.0
# Runs that look random but are known, for the SQL twin, which leaves out the whole run (fixed values).
ALLOWED = (
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"(?i)example|placeholder|changeme|redacted|dummy|sample|lorem",
    r"(?i)0123456789|123456789|abcdefghij|qwertyuiop",
    r"(?i)^(https?|www|data|image|application|sha(1|256|512)-)",
)
# The same strings with their ends: a UUID or an integrity digest that is the whole run, a word that
# no letter adjoins, a sequence, the first word of an address or media type (fixed values).
KNOWN = (
    r"(?i:^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$)",
    r"^sha1-(?:[0-9a-f]{40}|[A-Za-z0-9+/]{27}=)$",
    r"^sha256-(?:[0-9a-f]{64}|[A-Za-z0-9+/]{43}=)$",
    r"^sha512-(?:[0-9a-f]{128}|[A-Za-z0-9+/]{86}==)$",
    r"(?<![A-Za-z])(?i:example|placeholder|changeme|redacted|dummy|sample|lorem)(?![A-Za-z])",
    r"(?i:0?123456789|abcdefghij|qwertyuiop)",
    r"(?i:^(?:https?|www|data|image|application)(?![A-Za-z0-9]))",
)
SCALE = 1_000_000


def _table(window: int) -> list[int]:
    return [0] + [round(c * math.log2(c) * SCALE) for c in range(1, window + 1)]


def most(bits: float, window: int) -> int:
    """The largest sum of g that still has ``bits`` of entropy."""
    return math.floor((math.log2(window) - bits) * window * SCALE)


def _windows(codes: str, limit: str, window: int) -> str:
    """SQL for the merged (start, stop) of windows of an array of character codes that reach
    ``limit`` and hold no code of ``BLANK``."""
    g = _table(window)
    step = "array(" + ", ".join(f"{g[c + 1] - g[c]}L" for c in range(window)) + ")"  # of a count that grows from c
    among = lambda first, n, c: f"size(filter(slice({codes}, {first}, {n}), x -> x = {c}))"
    enters = f"get({step}, {among(f'greatest(i - {window - 1}, 0) + 1', f'least(i, {window - 1})', 'c')})"
    leaves = f"IF(i >= {window}, get({step}, {among(f'i - {window - 1}', window, f'get({codes}, i - {window})')} - 1), 0L)"
    named = lambda value, name, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"
    whole = f"NOT array_contains(slice({codes}, i - {window - 2}, {window}), {BLANK})"
    ends = f"filter(sequence(0, size({codes}) - 1), i -> i >= {window - 1} AND get(s, i) <= {limit} AND {whole})"
    first = f"filter(p, (x, k) -> k = 0 OR x - get(p, k - 1) > {window})"
    last = f"filter(p, (x, k) -> k = size(p) - 1 OR get(p, k + 1) - x > {window})"
    spans = f"transform(f, (x, k) -> named_struct('start', cast(x - {window - 1} as bigint), 'stop', cast(get(l, k) + 1 as bigint)))"
    regions = named(first, "f", named(last, "l", spans))
    return named(f"transform({codes}, (c, i) -> {enters} - {leaves})", "d", named(running_sum("d"), "s", named(ends, "p", regions)))


def scan_secrets(docs: DataFrame, window: int = WINDOW, allowed: tuple[str, ...] = KNOWN) -> DataFrame:
    """One row for each row of ``docs (doc_id, text)``: doc_id and the arrays ``base`` and
    ``entropy`` of (start, kind number in ``KINDS``, stop), sorted, in code points with the
    end exclusive.

    A null or empty text has none; a null id is kept; rows that repeat give equal rows; other
    columns are ignored; an empty table gives an empty one. A very long text is one task's work,
    linear in its length."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    df = add_matches(df, "assign", "text", ASSIGN, group=2)
    df = add_matches(df, "access", "text", ACCESS)
    df = add_matches(df, "hex", "text", HEX)
    df = add_matches(df, "run", "text", RUN)
    rows = lambda name, k, cond: f"transform(filter({name}, x -> {cond}), x -> named_struct('start', x.start, 'kind', {k}, 'stop', x.stop))"
    base = "array_sort(concat({}, {}, {}))".format(
        rows("assign", 0, "length(x.value) >= 6"), rows("access", 1, "length(x.value) >= 20"), rows("hex", 2, "true")
    )
    df = df.withColumn("base", F.expr(base))
    hexed = "x.value rlike '^([0-9a-f]+|[0-9A-F]+)$'"
    limit = (
        f"CASE WHEN NOT x.value rlike '[0-9]' THEN {most(LETTER_BITS, window)}L "
        f"WHEN {hexed} THEN {most(HEX_BITS, window)}L ELSE {most(MIXED_BITS, window)}L END"
    )
    shown = "x.value"
    if allowed:
        p = quoted("|".join(allowed))
        # pieces between known strings, and a blank for each character of these
        blank = f"zip_with(split(x.value, {p}, -1), regexp_extract_all(x.value, {p}, 0), (a, m) -> concat(a, repeat(' ', coalesce(length(m), 0))))"
        shown = f"IF(x.value rlike {p}, array_join({blank}, ''), x.value)"
    runs = f"transform(filter(run, x -> x.value rlike '[A-Za-z]'), x -> named_struct('start', x.start, 'limit', {limit}, "
    runs += f"'codes', transform(slice(split({shown}, ''), 1, length(x.value)), c -> locate(c, '{ALPHABET} ') - 1)))"
    df = df.withColumn("runs", F.expr(runs))
    spans = f"flatten(transform(runs, r -> transform({_windows('r.codes', 'r.limit', window)}, w -> named_struct('start', r.start + w.start, 'kind', 3, 'stop', r.start + w.stop))))"
    df = df.withColumn("entropy", F.expr(spans))
    inside = "exists(base, b -> b.start <= x.start AND x.stop <= b.stop)"
    return df.select("doc_id", "base", F.expr(f"filter(entropy, x -> NOT {inside})").alias("entropy"))


def secret_digests(found: DataFrame) -> DataFrame:
    """Counts, digest and text of the spans of ``scan_secrets``."""
    names = F.array(*(F.lit(k) for k in KINDS))
    shown = lambda a: F.array_join(
        F.transform(a, lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start.cast("string"), s.stop.cast("string"))), ","
    )
    count = lambda k: F.size(F.filter("base", lambda s: s.kind == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])),
        F.sha2(shown(F.col("base")), 256).alias("base_sha256"),
        shown(F.array_sort(F.concat("base", "entropy"))).alias("spans"),
    )
