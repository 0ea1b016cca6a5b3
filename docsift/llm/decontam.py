"""Operator 5: benchmark decontamination by q-gram lemma filtering.

Texts and benchmark items are compared without regard to case and to the length of
white space. An item of m characters may differ by e = rate * m edits. An edit spoils
at most q of the item's m - q + 1 q-grams, so a region of a text within e edits shares
at least T = m - q + 1 - q * e of them with it, on diagonals (text position minus item
position) that span at most e. Diagonals are dealt into bands of 2 (e + 1), each
overlapping the next by half, so some band holds all T. A band counts the text positions
that share a q-gram with it, each once, so repeated q-grams don't add up. Bands with T or
more are verified by a semi-global alignment limited to the band widened by e on both sides.

An item too short for this (under ``min_chars``, or q, characters) must occur exactly, and
with no letter or digit beside a letter or digit at its ends.

Rulers and other repeats: an item's positions of one q-gram are kept by blocks of e + 1, each
with its least and greatest remainder, which tells its (one or two) bands at any text
position. Text positions are taken in slices of ``SLICE`` entries, and wide bands are aligned
in pieces of ``PIECE`` diagonals, so memory is bounded for any text.

The benchmark is the stated query set. Its items travel to all tasks, which index a block of
``block_chars`` characters at a time; texts are scanned once for each ``pass_chars`` characters of
benchmark, without a shuffle."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.session import ship_package

from .common import U64, matching, text_key
from .words import chunks, texts_of

Q, RATE, MIN_CHARS = 10, 0.08, 40
BLOCK_CHARS, PASS_CHARS = 4_000_000, 64_000_000
SLICE, PIECE, CELLS = 1 << 21, 1 << 15, 1 << 20
_TABLE_BITS = 22
_P = U64(0x9E3779B97F4A7C15)

_WHITE = np.zeros(33, dtype=bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def normal(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters, text number, position in its text) after lower-casing and with runs of
    white space as one space."""
    lengths = np.array([len(t) for t in texts])
    u = np.frombuffer("".join(map(_lower, texts)).encode("utf-32-le"), dtype="<u4")
    row = np.repeat(np.arange(len(texts)), lengths)
    at = np.arange(len(u)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    white = _WHITE[np.minimum(u, 32)] & (u <= 32)
    keep = np.ones(len(u), dtype=bool)
    keep[1:] = ~(white[1:] & white[:-1] & (row[1:] == row[:-1]))
    u = np.where(white, np.uint32(32), u)[keep]
    return u, row[keep], at[keep]


def _qgrams(u: np.ndarray, q: int) -> np.ndarray:
    """Polynomial hashes of all runs of q characters, by doubling."""
    size = len(u) - q + 1
    if size <= 0:
        return np.zeros(0, dtype=U64)
    out, done, power, width, factor = None, 0, u.astype(U64) + U64(1), 1, _P
    while True:
        if q & width:
            piece = power[done : done + size]
            out = piece.copy() if out is None else out * factor + piece
            done += width
        if done == q:
            return out * _P
        power = power[:-width] * factor + power[width:]
        factor, width = U64(int(factor) ** 2 % 2**64), 2 * width


class Index:
    """q-grams of a block of benchmark items (item_id, text)."""

    def __init__(self, items: list[tuple[int, str]], q: int, rate: float, min_chars: int):
        self.q = q
        rows, short = [], []
        for i, text in items:
            u = normal([text.strip(" \t\n\v\f\r")])[0]
            if len(u) >= max(min_chars, q):
                rows.append((i, u))
            elif len(u):
                short.append((i, u))
        self.short = Short(short)
        self.ids = np.array([i for i, _ in rows], dtype=np.int64)
        self.chars = [u for _, u in rows]
        self.m = np.array([len(u) for u in self.chars], dtype=np.int64)
        self.e = np.minimum((rate * self.m).astype(np.int64), (self.m - q) // q)
        self.least = self.m - q + 1 - q * self.e
        grams = [_qgrams(u, q) for u in self.chars]
        flat = np.concatenate(grams) if grams else np.zeros(0, dtype=U64)
        item = np.repeat(np.arange(len(rows)), [len(g) for g in grams])
        pos = np.concatenate([np.arange(len(g)) for g in grams]) if grams else item
        step = self.e[item] + 1
        block, rest = pos // step, pos % step
        order = np.lexsort((rest, block, item, flat))
        flat, item, block, rest = flat[order], item[order], block[order], rest[order]
        new = np.ones(len(flat), dtype=bool)
        new[1:] = (flat[1:] != flat[:-1]) | (item[1:] != item[:-1]) | (block[1:] != block[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(flat)) - 1 if len(first) else first
        # Postings (item, block, least and greatest remainder), by q-gram.
        self.item, self.block, self.low, self.high = item[first], block[first], rest[first], rest[last]
        self.gram, self.start, self.count = np.unique(flat[first], return_index=True, return_counts=True)
        self.table = np.zeros(1 << _TABLE_BITS, dtype=bool)
        self.table[(self.gram >> U64(64 - _TABLE_BITS)).astype(np.int64)] = True

    def _counted(self, at: np.ndarray, where: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, item, band, text positions) from the text positions ``at`` of q-grams ``where``."""
        n = self.count[where]
        posting = np.repeat(self.start[where] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        i, item = np.repeat(at, n), self.item[posting]
        step = self.e[item] + 1
        band, rest = i // step - self.block[posting], i % step
        near, far = self.low[posting] <= rest, self.high[posting] > rest
        # A diagonal's band and the one before it, which overlaps.
        wide = np.concatenate([band[near], band[near] - 1, band[far] - 1, band[far] - 2])
        i = np.concatenate([i[near], i[near], i[far], i[far]])
        item = np.concatenate([item[near], item[near], item[far], item[far]])
        order = np.lexsort((i, wide, item))
        i, item, wide = i[order], item[order], wide[order]
        once = np.ones(len(i), dtype=bool)
        once[1:] = (i[1:] != i[:-1]) | (item[1:] != item[:-1]) | (wide[1:] != wide[:-1])
        i, item, wide = i[once], item[once], wide[once]
        return _summed(row[i], item, wide, np.ones(len(i), dtype=np.int64))

    def bands(self, u: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Rows (text, item, first diagonal, last diagonal + 1) of the diagonal ranges that hold
        enough q-grams, diagonals counted in ``u``; overlapping bands are merged."""
        none = np.zeros((0, 4), dtype=np.int64)
        if not len(self.gram) or len(u) < self.q:
            return none
        h = _qgrams(u, self.q)
        at = np.flatnonzero(self.table[(h >> U64(64 - _TABLE_BITS)).astype(np.int64)] & (row[: len(h)] == row[self.q - 1 :]))
        where = np.minimum(np.searchsorted(self.gram, h[at]), len(self.gram) - 1)
        true = self.gram[where] == h[at]
        at, where = at[true], where[true]
        if not len(at):
            return none
        slices = np.cumsum(self.count[where]) // SLICE
        cuts = np.r_[0, np.flatnonzero(np.diff(slices)) + 1, len(at)]
        counted = [self._counted(at[a:b], where[a:b], row) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        text, item, band, hits = _summed(*(np.concatenate(x) for x in zip(*counted, strict=True)))
        ok = hits >= self.least[item]
        text, item, band = text[ok], item[ok], band[ok]
        if not len(text):
            return none
        joint = np.ones(len(text), dtype=bool)
        joint[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (band[1:] > band[:-1] + 1)
        first = np.flatnonzero(joint)
        last = np.append(first[1:], len(text)) - 1
        step = self.e[item[first]] + 1
        return np.stack([text[first], item[first], band[first] * step, (band[last] + 2) * step], axis=1)


def _summed(text, item, band, n) -> tuple[np.ndarray, ...]:
    order = np.lexsort((band, item, text))
    text, item, band, n = text[order], item[order], band[order], n[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])
    first = np.flatnonzero(new)
    return text[first], item[first], band[first], np.add.reduceat(n, first) if len(first) else n


@functools.cache
def _alnum() -> np.ndarray:
    return np.array([chr(i).isalnum() for i in range(0x110000)])


class Short:
    """Items that must occur exactly: hashes of all runs of an item's length that start at an
    edge of a word, from one array of prefix sums, and a comparison of characters."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.by_length: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i, u in items:
            self.by_length.setdefault(len(u), []).append((i, u))

    def find(self, u: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Rows (item_id, first character, last character + 1) in ``u``."""
        none = np.zeros((0, 3), dtype=np.int64)
        if not self.by_length or not len(u):
            return none
        word = _alnum()[u]
        edge = np.ones(len(u) + 1, dtype=bool)  # no letter or digit on both sides
        edge[1:-1] = ~(word[1:] & word[:-1]) | (row[1:] != row[:-1])
        power = _powers(len(u), _P)
        sums = np.cumsum(np.r_[U64(0), (u.astype(U64) + U64(1)) * power[:-1]], dtype=U64)
        starts, found = np.flatnonzero(edge[:-1]), [none]
        inverse = _powers(len(u), U64(pow(int(_P), -1, 2**64)))
        for length, items in self.by_length.items():
            if length > len(u):
                continue
            at = starts[starts + length <= len(u)]
            at = at[edge[at + length] & (row[at] == row[at + length - 1])]
            # The sum of u[at + j] * P^(at + j), against P^at times an item's hash; P is odd, so
            # dividing by P^at is a product with its inverse.
            hashes = np.array([((c.astype(U64) + U64(1)) * power[:length]).sum(dtype=U64) for _, c in items], dtype=U64)
            order = np.argsort(hashes, kind="stable")
            here = (sums[at + length] - sums[at]) * inverse[at]
            left, right = (np.searchsorted(hashes[order], here, side) for side in ("left", "right"))
            for some in np.flatnonzero(right > left):
                for k in order[left[some] : right[some]]:
                    if (u[at[some] : at[some] + length] == items[k][1]).all():
                        found.append(np.array([[items[k][0], at[some], at[some] + length]], dtype=np.int64))
        return np.concatenate(found)


def _powers(n: int, of: np.uint64) -> np.ndarray:
    return np.cumprod(np.r_[U64(1), np.full(n, of)], dtype=U64)


def align(u: np.ndarray, ends: np.ndarray, chars: list[np.ndarray], lo: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Banded semi-global alignment, all candidates at once: each item against the text
    characters ``u`` of its region ``ends[c] = (first, last + 1)``, on diagonals
    ``lo[c] .. lo[c] + width[c]``. Returns (edits, start, end) for each."""
    n, most, wide = len(chars), max(map(len, chars)), int(width.max())
    m = np.array([len(c) for c in chars])
    items = np.zeros((n, most), dtype=np.uint32)
    for i, c in enumerate(chars):
        items[i, : len(c)] = c
    k = np.arange(wide)
    unit = np.int64(1) << 40  # edits above, start position below
    far = unit << 20
    outside = k[None, :] >= width[:, None]
    value = np.where(outside, far, lo[:, None] + k[None, :] + (np.int64(1) << 30))
    out = np.zeros((n, 3), dtype=np.int64)
    for i in range(1, most + 1):
        j = lo[:, None] + (i - 1) + k[None, :]
        inside = (j >= ends[:, :1]) & (j < ends[:, 1:])
        differ = ~inside | (u[np.clip(j, 0, len(u) - 1)] != items[:, i - 1 : i])
        cur = value + differ * unit
        cur[:, :-1] = np.minimum(cur[:, :-1], value[:, 1:] + unit)
        cur = np.minimum.accumulate(cur - k * unit, axis=1) + k * unit
        value = np.where(outside, far, cur)
        for c in np.flatnonzero(m == i):
            best = int(np.argmin(value[c]))
            out[c] = value[c, best] >> 40, (value[c, best] & (unit - 1)) - (1 << 30), lo[c] + i + best
    return out


def _verified(index: Index, bands: np.ndarray, u: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Rows (text, item, edits, start, end): the nearest occurrence within each band."""
    text, item, lo, hi = bands.T
    pieces = -(-(hi - lo) // PIECE)
    band = np.repeat(np.arange(len(bands)), pieces)
    nth = np.arange(len(band)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    lo = lo[band] + nth * PIECE
    hi = np.minimum(lo + PIECE, hi[band])
    e = index.e[item[band]]
    width = hi - lo + 2 * e
    order = np.argsort(width, kind="stable")
    best = np.empty((len(band), 3), dtype=np.int64)
    a = 0
    while a < len(order):
        n = np.arange(1, min(256, len(order) - a) + 1)
        b = a + max(1, int((n * width[order[a : a + 256]] <= CELLS).sum()))
        some = order[a:b]
        t = text[band[some]]
        ends = np.stack([span[t], span[t + 1]], axis=1)
        best[some] = align(u, ends, [index.chars[i] for i in item[band[some]]], lo[some] - e[some], width[some])
        a = b
    order = np.lexsort((best[:, 2], best[:, 1], best[:, 0], band))
    first = order[np.r_[True, band[order][1:] != band[order][:-1]]]
    found = np.column_stack([text, item, best[first]])
    return found[found[:, 2] <= index.e[item]]


def _scan(blocks: list, options: tuple):
    names = ["doc_id", "tkey", "item_id", "start", "end", "edits"]

    def found(index: Index, texts: list[str]) -> tuple[np.ndarray, ...]:
        u, row, at = normal(texts)
        bands = index.bands(u, row)
        exact = index.short.find(u, row)
        span = np.searchsorted(row, np.arange(len(texts) + 1))
        hits = _verified(index, bands, u, span) if len(bands) else np.zeros((0, 5), dtype=np.int64)
        text, item, edits, start, end = hits.T
        start, end = np.maximum(start, span[text]), np.minimum(end, span[text + 1])
        name, a, b = exact.T
        text, start, end = np.r_[text, row[a]], np.r_[start, a], np.r_[end, b]
        return text, np.r_[index.ids[item], name], at[start], at[end - 1] + 1, np.r_[edits, np.zeros(len(a), dtype=np.int64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Index(blocks[0].value, *options) if len(blocks) == 1 else None
        for b in batches:
            column = texts_of(b.column("text"))
            for block in blocks:
                index = one or Index(block.value, *options)
                for first, offsets, _ in chunks(column, 2_000_000):
                    text, *rest = found(index, column.slice(first, len(offsets) - 1).to_pylist())
                    if len(text):
                        at = pa.array(text + first)
                        yield pa.RecordBatch.from_arrays(
                            [b.column("doc_id").take(at), b.column("tkey").take(at), *(pa.array(x.astype(np.int64)) for x in rest)], names
                        )

    return run


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[int, str]]]:
    """The items, a bounded block at a time."""
    block, size = [], 0
    rows = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    for r in rows.toLocalIterator(prefetchPartitions=False):
        if block and size + len(r.text) > limit:
            yield block
            block, size = [], 0
        block.append((r.item_id, r.text))
        size += len(r.text)
    if block:
        yield block


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE, min_chars: int = MIN_CHARS,
                    block_chars: int = BLOCK_CHARS, pass_chars: int = PASS_CHARS) -> DataFrame:
    """Rows (doc_id, tkey, item_id, start, end, edits): the part [start, end) of a text of
    ``docs (doc_id, text)``, in characters, is an item of ``benchmark (item_id, text)`` with
    at most ``rate`` edits a character. Of occurrences whose diagonals touch, the nearest; of
    items under ``min_chars`` characters every exact one, at edges of words.

    Null and empty texts and items match nothing. Equal items and repeated rows each give
    their own rows; a null id is kept as null, other columns are ignored, and an empty table
    gives no rows. A very long text is one task's work, in memory of about 60 bytes a character.
    The driver holds ``pass_chars`` characters of the benchmark at a time."""
    spark = docs.sparkSession
    ship_package(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tkey", text_key())
    schema = "doc_id long, tkey long, item_id long, start long, end long, edits long"
    passes, size = [[]], 0
    for items in _blocks(benchmark, block_chars):
        chars = sum(len(t) for _, t in items)
        if passes[-1] and size + chars > pass_chars:
            passes.append([])
            size = 0
        passes[-1].append(spark.sparkContext.broadcast(items))
        size += chars
    parts = [base.mapInArrow(_scan(blocks, (q, rate, min_chars)), schema) for blocks in passes if blocks]
    found = parts[0] if parts else spark.createDataFrame([], schema)
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item, columns unchanged."""
    leaks = benchmark_leaks(docs, benchmark, **options).select("doc_id", "tkey").distinct()
    return matching(docs, leaks, "left_anti")
