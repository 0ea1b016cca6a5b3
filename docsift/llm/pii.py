"""Operator 9: personal data by bootstrapped contextual extraction.

Base spans (e-mail, IP, card and phone numbers) are found by patterns and checks. They are the
seeds, the first positive instances. A lexical pattern is a context of words (lower case, digits
as 0, without punctuation at the edges): ``L``, the two words before, or ``B``, the word before
and the word after. A pattern with ``MIN_SEEDS`` different positive instances is looked up in all
texts; whatever fills its slot is an instance: between the words of a B up to ``SLOT`` words (the
nearest right word counts), after an L one word and, if it has a digit, those after it that have digits and no letter. So instances may be of several words, or have
no digit. Spark scores the graph of patterns and instances:

* an instance is contradicted if all its words are ordinary: seen elsewhere at least
  ``ELSEWHERE`` times, and more often than in slots;
* a pattern scores positive / (positive + contradicted + ``UNKNOWN`` * others), by occurrences in
  its slot. From ``CONFIDENT`` on, its instances that aren't contradicted become positive.

A pattern's slots are counted first: one whose positive occurrences can't reach ``CONFIDENT``
even if nothing were contradicted isn't looked into (yet: they may grow).

New positive instances are looked up in all texts in turn; their contexts are patterns like
those of seeds, and their occurrences are the spans of kind ``context``, of those that start at
one place the shortest. The rounds end when
there is no new pattern and no new instance. Both are looked up by 64-bit hashes.

Edges are summed before they are shuffled, so a pattern in a third of the documents is a row
for each of its instances; tables joined on a pattern, an instance or a word are written first,
so that both sides of the join are plain and AQE splits a hot one. Patterns and instances travel to
the tasks in blocks of ``BLOCK``, each for one scan of the texts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.session import ship_package

from .common import U64, chain, mix, remove, seed, text_key, written
from .words import SPACE, chunks, grams, hash_spans, texts_of

KINDS = ("email", "ip", "card", "phone", "context")
MIN_SEEDS, CONFIDENT, UNKNOWN, ELSEWHERE, SLOT = 5, 0.9, 0.1, 5, 4
BLOCK = 4_000_000
CHUNK = 1 << 20  # bytes of text at once

# Greedy runs are possessive or anchored, which changes no match but keeps every scan linear.
_AT = re.compile(r"@")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Bytes: punctuation that isn't part of a word at its edges; lower case; lower case with digits as 0.
_EDGE = np.zeros(256, dtype=bool)
_EDGE[list(b"\"'`()[]{}<>.,;:!?|*#$%&=")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SHAPE = _LOWER.copy()
_SHAPE[48:58] = 48
_DIGITS = np.zeros(256, dtype=bool)
_DIGITS[48:58] = True
_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, in linear time: every @
    is tried with the whole run before it."""
    done = 0
    for at in _AT.finditer(text):
        a = at.start()
        if a < done:
            continue
        start = a
        while start > done and _LOCAL_END.match(text, start - 1):
            start -= 1
        if start < a and (m := _DOMAIN.match(text, a)):
            yield start, m.end()
            done = m.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base kinds, sorted."""
    out = [(a, 0, e) for a, e in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


@dataclass
class Tokens:
    """Words of a chunk of texts, without punctuation at their edges (which may leave none)."""

    row: np.ndarray
    start: np.ndarray  # bytes in the chunk
    stop: np.ndarray
    core: np.ndarray  # hash in lower case
    shape: np.ndarray  # hash in lower case with digits as 0
    digit: np.ndarray  # has a digit
    number: np.ndarray  # has a digit and no letter
    char: np.ndarray  # characters before each byte of the chunk
    offsets: np.ndarray

    def place(self, byte: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Characters before a byte in its text."""
        return self.char[byte] - self.char[self.offsets[row]]

    def __len__(self) -> int:
        return len(self.row)


def tokens_of(offsets: np.ndarray, data: np.ndarray) -> Tokens:
    word, edge = ~SPACE[data], np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before, after = np.zeros_like(word), np.zeros_like(word)
    before[1:], after[:-1] = word[:-1], word[1:]
    start = np.flatnonzero(word & (~before | edge[:-1]))
    stop = np.flatnonzero(word & (~after | edge[1:])) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    inner = np.flatnonzero(word & ~_EDGE[data])
    i, j = np.searchsorted(inner, start), np.searchsorted(inner, stop)
    some = j > i
    if len(inner):
        start = np.where(some, inner[np.minimum(i, len(inner) - 1)], start)
        stop = np.where(some, inner[np.maximum(j - 1, 0)] + 1, start)
    else:
        stop = start
    digits, letters = (np.concatenate([[0], np.cumsum(x[data])]) for x in (_DIGITS, _LETTERS))
    digit = digits[stop] > digits[start]
    char = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return Tokens(
        row, start, stop, hash_spans(_LOWER[data], start, stop), hash_spans(_SHAPE[data], start, stop),
        digit, digit & (letters[stop] == letters[start]), char, offsets,
    )


_L, _B = seed(901), seed(902)


def _pattern(kind: np.uint64, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return chain(chain(np.full(len(one), kind), one), two)


def contexts(t: Tokens, first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which, pattern) of spans of tokens ``first .. last``."""
    n = len(t)
    at = np.flatnonzero((first >= 2) & (t.row[np.maximum(first - 2, 0)] == t.row[first]))
    yield at, _pattern(_L, t.shape[first[at] - 2], t.shape[first[at] - 1])
    inside = (first >= 1) & (last + 1 < n)
    at = np.flatnonzero(inside & (t.row[np.maximum(first - 1, 0)] == t.row[np.minimum(last + 1, n - 1)]))
    yield at, _pattern(_B, t.shape[first[at] - 1], t.shape[last[at] + 1])


def _instances(t: Tokens) -> list[np.ndarray]:
    """Hashes of the runs of 1 .. SLOT words from each token; 0 where the run leaves the text or
    has no characters."""
    full = t.stop > t.start
    out = []
    for n in range(1, SLOT + 1):
        h = np.zeros(len(t), dtype=U64)
        g = grams(t.core, n)
        ok = t.row[: len(g)] == t.row[n - 1 :] if len(g) else np.zeros(0, dtype=bool)
        some = np.zeros(len(g), dtype=bool)
        for k in range(n):
            some |= full[k : k + len(g)]
        h[: len(g)] = np.where(ok & some, mix(g + U64(n)) | U64(1), U64(0))
        out.append(h)
    return out


class Lookup:
    """A set of 64-bit hashes, with a table of their first bits before the search."""

    def __init__(self, hashes: np.ndarray, bits: int = 20):
        self.sorted, self.shift = np.sort(hashes), U64(64 - bits)
        self.table = np.zeros(1 << bits, dtype=bool)
        self.table[(self.sorted >> self.shift).astype(np.int64)] = True

    def hits(self, h: np.ndarray) -> np.ndarray:
        """Positions in ``h`` of members."""
        if not len(self.sorted):
            return np.zeros(0, dtype=np.int64)
        at = np.flatnonzero(self.table[(h >> self.shift).astype(np.int64)])
        where = np.minimum(np.searchsorted(self.sorted, h[at]), len(self.sorted) - 1)
        return at[self.sorted[where] == h[at]]


def slots(t: Tokens, patterns: Lookup) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first token, number of tokens, pattern) of what fills the patterns' slots."""
    n = len(t)
    every = np.arange(n)
    out = []
    if n > 2:
        i = every[2:]
        i = i[t.row[i - 2] == t.row[i]]
        h = _pattern(_L, t.shape[i - 2], t.shape[i - 1])
        hit = patterns.hits(h)
        i, h = i[hit], h[hit]
        size = np.ones(len(i), dtype=np.int64)
        going = t.digit[i]
        for k in range(1, SLOT):
            at = np.minimum(i + k, n - 1)
            going = going & (i + k < n) & (t.row[at] == t.row[i]) & t.number[at]
            size += going
        out.append((i, size, h))
    for k in range(1, SLOT + 1):
        i = every[1 : n - k]
        i = i[t.row[i - 1] == t.row[i + k]] if len(i) else i
        h = _pattern(_B, t.shape[i - 1], t.shape[i + k])
        hit = patterns.hits(h)
        out.append((i[hit], np.full(len(hit), k), h[hit]))
    i, size, pattern = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((size, pattern, i))
    i, size, pattern = i[order], size[order], pattern[order]
    nearest = np.ones(len(i), dtype=bool)
    nearest[1:] = (i[1:] != i[:-1]) | (pattern[1:] != pattern[:-1])
    return i[nearest], size[nearest], pattern[nearest]


def _touched(t: Tokens, rows: np.ndarray, texts: list[str]) -> np.ndarray:
    """True for tokens of ``rows`` that touch a base span."""
    out = np.zeros(len(t), dtype=bool)
    span = np.searchsorted(t.row, np.arange(len(texts) + 1))
    for r in rows:
        found = base_spans(texts[r])
        if found:
            a, b = span[r], span[r + 1]
            lo, hi = t.place(t.start[a:b], t.row[a:b]), t.place(t.stop[a:b], t.row[a:b])
            for start, _, stop in found:
                out[a:b] |= (lo < stop) & (hi > start)
    return out


_FOUND = (
    "doc_id long, tkey long, base array<struct<start: long, kind: int, stop: long>>, "
    "links array<struct<pattern: long, instance: long>>"
)
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("tkey", pa.int64()),
    ("base", pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64())]))),
    ("links", pa.list_(pa.struct([("pattern", pa.int64()), ("instance", pa.int64())]))),
])


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base spans of each row, and the patterns around them."""
    for b in batches:
        texts = texts_of(b.column("text"))
        for first in range(0, b.num_rows, 1000):
            part, rows = b.slice(first, 1000), []
            some = texts.slice(first, 1000).to_pylist()
            for doc_id, tkey, text in zip(part.column("doc_id").to_pylist(), part.column("tkey").to_pylist(), some, strict=True):
                base = base_spans(text)
                rows.append({
                    "doc_id": doc_id, "tkey": tkey, "base": [{"start": a, "kind": k, "stop": e} for a, k, e in base],
                    "links": _links(text, base) if base else [],
                })
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


def _links(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    t = tokens_of(np.array([0, len(raw)]), raw)
    # A span's tokens: those that it overlaps, punctuation at their edges included.
    lead = np.flatnonzero(~SPACE[raw] & np.r_[True, SPACE[raw[:-1]]])
    byte = np.searchsorted(t.char, [x for a, _, e in base for x in (a, e - 1)], "right") - 1
    token = np.searchsorted(lead, byte, "right") - 1
    out = []
    for which, pattern in contexts(t, token[0::2], token[1::2]):
        for k, p in zip(which, pattern.view(np.int64), strict=True):
            a, _, e = base[k]
            out.append({"pattern": int(p), "instance": xxhash.xxh3_64_intdigest(text[a:e].lower().encode()) - 2**63})
    return out


# Rows of a scan: what they are, and its numbers.
FILLER, WORD, OCCURRENCE, CONTEXT = range(4)
_ROWS = "kind int, doc_id long, tkey long, a long, b long, n long, words array<long>"
_ROWS_ARROW = pa.schema([
    ("kind", pa.int32()), ("doc_id", pa.int64()), ("tkey", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()),
    ("words", pa.list_(pa.int64())),
])


def _rows(kind: int, size: int, **columns) -> pa.RecordBatch:
    out = []
    for f in _ROWS_ARROW:
        v = pa.array(np.full(size, kind, dtype=np.int32)) if f.name == "kind" else columns.get(f.name)
        if isinstance(v, np.ndarray):
            v = pa.array(v.view(np.int64) if v.dtype == U64 else v.astype(np.int64))
        out.append(pa.nulls(size, f.type) if v is None else v.cast(f.type))
    return pa.RecordBatch.from_arrays(out, schema=_ROWS_ARROW)


def _scan(patterns: np.ndarray, instances: np.ndarray):
    """What fills the slots of ``patterns``, and where ``instances`` occur and in which contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, known = Lookup(patterns), Lookup(instances)
        for b in batches:
            column = texts_of(b.column("text"))
            for first, offsets, data in chunks(column, CHUNK):
                t = tokens_of(offsets, data)
                if not len(t):
                    continue
                texts, runs = column.slice(first, len(offsets) - 1), _instances(t)
                i, size, pattern = slots(t, wanted)
                spans = [(at := known.hits(h), np.full(len(at), n + 1)) for n, h in enumerate(runs)]
                o, length = (np.concatenate(x) for x in zip(*spans, strict=True))
                rows = np.unique(np.concatenate([t.row[i], t.row[o]]))
                if not len(rows):
                    continue
                seeded = np.concatenate([[0], np.cumsum(_touched(t, rows, texts.to_pylist()))])
                i, size, pattern = (x[seeded[i] == seeded[i + size]] for x in (i, size, pattern))
                instance = np.array(runs)[size - 1, i]
                ok = instance != 0
                i, size, pattern, instance = i[ok], size[ok], pattern[ok], instance[ok]
                order = np.lexsort((instance, pattern))
                i, size, pattern, instance = i[order], size[order], pattern[order], instance[order]
                new = np.ones(len(i), dtype=bool)
                new[1:] = (pattern[1:] != pattern[:-1]) | (instance[1:] != instance[:-1])
                one = np.flatnonzero(new)
                flat = np.repeat(i[one], size[one]) + _within(size[one])
                ends = np.concatenate([[0], np.cumsum(size[one])])
                words = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(t.core[flat].view(np.int64)))
                times = np.diff(np.append(one, len(i)))
                yield _rows(FILLER, len(one), a=pattern[one], b=instance[one], n=times, words=words)
                inside = np.unique(np.repeat(i, size) + _within(size))
                word, n = np.unique(t.core[inside], return_counts=True)
                yield _rows(WORD, len(word), a=word, n=n)
                ok = seeded[o] == seeded[o + length]
                o, length = o[ok], length[ok]
                row, last = t.row[o], o + length - 1
                name = {c: b.column(c).take(pa.array(row + first)) for c in ("doc_id", "tkey")}
                yield _rows(OCCURRENCE, len(o), a=t.place(t.start[o], row), b=t.place(t.stop[last], row), **name)
                instance = np.array(runs)[length - 1, o]
                for which, pattern in contexts(t, o, last):
                    yield _rows(CONTEXT, len(which), a=pattern, b=instance[which], n=np.ones(len(which)))

    return run


def _within(size: np.ndarray) -> np.ndarray:
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


def _slot_counts(patterns: np.ndarray):
    """(pattern, slots) of each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = Lookup(patterns)
        for b in batches:
            for _, offsets, data in chunks(texts_of(b.column("text")), CHUNK):
                t = tokens_of(offsets, data)
                pattern, n = np.unique(slots(t, wanted)[2], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pattern.view(np.int64)), pa.array(n.astype(np.int64))], ["pattern", "slots"])

    return run


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for _, offsets, data in chunks(texts_of(b.column("text")), 4 * CHUNK):
            word, n = np.unique(tokens_of(offsets, data).core, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])


def _hash_blocks(column: DataFrame, block: int) -> Iterator[np.ndarray]:
    """The hashes of a one-column table, a bounded block at a time."""
    rows = []
    for r in column.toLocalIterator():
        rows.append(r[0])
        if len(rows) == block:
            yield np.array(rows, dtype=np.int64).view(U64)
            rows = []
    if rows:
        yield np.array(rows, dtype=np.int64).view(U64)


def bootstrap(base: DataFrame, links: DataFrame, min_seeds: int = MIN_SEEDS, confident: float = CONFIDENT, unknown: float = UNKNOWN,
              elsewhere: int = ELSEWHERE, block: int = BLOCK) -> tuple[DataFrame | None, list[str]]:
    """(doc_id, tkey, start, stop) of the unseen identifiers in ``base (doc_id, tkey, text)``, from the
    seeds' ``links (pattern, instance)``; None if no pattern is looked up. And scratch tables."""
    scratches: list[str] = []

    def plain(df: DataFrame, name: str) -> DataFrame:
        table, at = written(df, name)
        scratches.append(at)
        return table

    def union(tables: list[DataFrame]) -> DataFrame:
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        return out

    texts = base.select("text")
    positive = seeds = plain(links.groupBy("pattern", "instance").agg(F.count("*").alias("n")), "seeds")
    none = np.zeros(0, dtype=U64)
    scans, counted, looked = [], [], []
    accepted = searched = totals = None
    while True:
        enough = plain(
            positive.groupBy("pattern").agg(F.count("*").alias("instances"), F.sum("n").alias("n"))
            .where(F.col("instances") >= min_seeds).select("pattern", "n"),
            "enough",
        )
        uncounted = enough.join(union(counted), "pattern", "left_anti") if counted else enough
        for block_of in _hash_blocks(uncounted.select("pattern"), block):
            found = texts.mapInArrow(_slot_counts(block_of), "pattern long, slots long")
            counted.append(plain(found.groupBy("pattern").agg(F.sum("slots").alias("slots")), "slots"))
        if not counted:
            break
        others = F.greatest(F.col("slots") - F.col("n"), F.lit(0))
        able = enough.join(union(counted), "pattern").where(F.col("n") >= confident * (F.col("n") + unknown * others)).select("pattern")
        fresh = plain(able.join(union(looked), "pattern", "left_anti") if looked else able, "patterns")
        new = accepted if searched is None or accepted is None else accepted.join(searched, "instance", "left_anti")
        patterns, names = _hash_blocks(fresh, block), _hash_blocks(new, block) if new is not None else iter(())
        rounds = []
        while True:
            p, q = next(patterns, none), next(names, none)
            if not len(p) and not len(q):
                break
            rounds.append(plain(base.mapInArrow(_scan(p, q), _ROWS), "scan"))
        if not rounds:
            break
        if totals is None:
            totals = plain(texts.mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
        scans += rounds
        looked.append(fresh)
        searched = accepted
        every = union(scans)
        seen = every.where(F.col("kind") == CONTEXT).groupBy(F.col("a").alias("pattern"), F.col("b").alias("instance")).agg(F.sum("n").alias("n"))
        positive = plain(seeds.unionByName(seen), "contexts")
        edges = plain(
            every.where(F.col("kind") == FILLER).groupBy(F.col("a").alias("pattern"), F.col("b").alias("instance"))
            .agg(F.sum("n").alias("n"), F.first("words").alias("words")),
            "edges",
        )
        inside = plain(every.where(F.col("kind") == WORD).groupBy(F.col("a").alias("word")).agg(F.sum("n").alias("inside")), "inside")
        away = F.col("n") - F.col("inside")
        ordinary = plain(inside.join(totals, "word").where((away >= elsewhere) & (away > F.col("inside"))).select("word"), "ordinary")
        fillers = plain(edges.groupBy("instance").agg(F.first("words").alias("words")).select("instance", F.explode("words").alias("word")), "fillers")
        rare = plain(fillers.join(ordinary, "word", "left_anti").select("instance").distinct().withColumn("rare", F.lit(True)), "rare")
        ours = F.lit(None).cast("boolean").alias("ours")
        judged = edges.select("pattern", "instance", "n").join(rare, "instance", "left")
        judged = plain(judged.select("*", ours) if accepted is None else judged.join(accepted.withColumn("ours", F.lit(True)), "instance", "left"), "judged")
        # Occurrences and different instances by pattern: of seeds, accepted ones, contradicted ones and others.
        zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
        good = F.col("ours").isNotNull()
        rows = judged.select(
            "pattern", F.when(good, F.col("n")).otherwise(zero).alias("good"), F.when(good, one).otherwise(zero).alias("instances"),
            F.when(~good & F.col("rare").isNull(), F.col("n")).otherwise(zero).alias("wrong"),
            F.when(~good & F.col("rare").isNotNull(), F.col("n")).otherwise(zero).alias("open"),
        ).unionByName(
            seeds.join(union(looked), "pattern", "left_semi").select("pattern", F.col("n").alias("good"), one.alias("instances"), zero.alias("wrong"), zero.alias("open"))
        )
        sums = rows.groupBy("pattern").agg(*(F.sum(c).alias(c) for c in ("good", "instances", "wrong", "open")))
        share = F.col("good") / (F.col("good") + F.col("wrong") + unknown * F.col("open"))
        sure = plain(sums.where((share >= confident) & (F.col("instances") >= min_seeds)).select("pattern"), "sure")
        found = judged.where("rare").join(sure, "pattern", "left_semi").select("instance")
        accepted = plain((found if accepted is None else found.unionByName(accepted)).distinct(), "accepted")
    spans = None
    for scan in scans:
        part = scan.where(F.col("kind") == OCCURRENCE).select("doc_id", "tkey", F.col("a").alias("start"), F.col("b").alias("stop"))
        spans = part if spans is None else spans.unionByName(part)
    return spans, scratches


def personal_data(docs: DataFrame, **options) -> DataFrame:
    """One row for each row of ``docs (doc_id, text)``: doc_id and the array ``spans`` of
    (start, kind number in ``KINDS``, stop), sorted, in characters with the end exclusive.

    A null or empty text has none. A null id is kept as null; equal rows get equal results, and
    count once for each pattern and instance. Other columns are ignored; an empty table gives no
    rows. A very long text is one task's work, in linear memory."""
    ship_package(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tkey", text_key())
    found, found_at = written(base.mapInArrow(_seeds, _FOUND), "pii")
    extra, scratches = bootstrap(base, found.select(F.inline("links")), **options)
    rows = found.select("doc_id", "tkey", "base")
    none = F.expr("cast(array() as array<struct<start: bigint, kind: int, stop: bigint>>)")
    if extra is None:
        remove(docs.sparkSession, *scratches)
        return rows.select("doc_id", F.array_sort("base").alias("spans"))
    extra = extra.groupBy("doc_id", "tkey", "start").agg(F.min("stop").alias("stop"))
    more = F.collect_list(F.struct("start", F.lit(4).alias("kind"), "stop")).alias("more")
    spans = written(extra.groupBy("doc_id", "tkey").agg(more).select(F.struct("doc_id", "tkey").alias("key"), "more"), "spans")[0]
    remove(docs.sparkSession, *scratches)
    out = rows.join(spans, F.struct("doc_id", "tkey").eqNullSafe(F.col("key")), "left")
    return out.select("doc_id", F.array_sort(F.concat("base", F.coalesce("more", none))).alias("spans"))


def span_digests(found: DataFrame) -> DataFrame:
    """Counts, digest and text of the spans of ``personal_data``."""
    names = F.array(*(F.lit(k) for k in KINDS))
    shown = lambda a: F.array_join(
        F.transform(a, lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start.cast("string"), s.stop.cast("string"))), ","
    )
    count = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long")
    base = F.filter("spans", lambda s: s.kind < 4)
    return found.select(
        "doc_id",
        *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])),
        F.sha2(shown(base), 256).alias("base_sha256"),
        shown(F.col("spans")).alias("spans"),
    )
