"""Words of Arrow text columns as numpy arrays.

A word is a maximal run of characters other than space and U+0009..U+000D, i.e.
``[^\\x20\\x09-\\x0D]+``. All six separators are single bytes in UTF-8, so words
are found and hashed on the UTF-8 bytes, a few million bytes at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import U64, chain, mix, seed

CHUNK_BYTES = 4_000_000
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=U64)


@dataclass
class Words:
    """Words of rows ``first .. first + rows`` of a batch."""

    first: int
    rows: int
    row: np.ndarray  # row within the chunk, for each word
    hash: np.ndarray  # 64-bit hash of each word's bytes
    at: np.ndarray  # first word of each row, and the number of words
    offsets: np.ndarray  # first byte of each row, and the number of bytes
    data: np.ndarray  # the rows' UTF-8 bytes

    def spans(self, n: int) -> np.ndarray:
        """True where ``n`` consecutive words, from this one, are in one row."""
        m = len(self.row)
        if m < n:
            return np.zeros(0, dtype=bool)
        return self.row[: m - n + 1] == self.row[n - 1 :]


def texts_of(column: pa.Array) -> pa.Array:
    """A text column as large strings, with null as the empty text."""
    return pc.fill_null(column, "").cast(pa.large_string())


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets from 0, bytes) for runs of whole rows of about ``limit`` bytes."""
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        b = min(b, n)
        yield a, offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]
        a = b


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes a step."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eights = np.lib.stride_tricks.as_strided(padded.view(np.uint8)[:8].view("<u8"), shape=(len(data) + 1,), strides=(1,))
    left = ends - starts
    h = mix(left.astype(U64) + seed(7))
    live, pos, rest = np.arange(len(starts)), starts.copy(), left.copy()
    steps = 0
    while len(live):
        k = eights[pos] & _KEEP[np.minimum(rest, 8)]
        h[live] = chain(h[live], k)
        more = rest > 8
        live, pos, rest = live[more], pos[more] + 8, rest[more] - 8
        steps += 1
        if steps == 64 and len(live):  # a few giant words: hash their tails at once
            import xxhash

            tails = [xxhash.xxh3_64_intdigest(data[p : p + r].tobytes()) for p, r in zip(pos, rest, strict=True)]
            h[live] = chain(h[live], np.array(tails, dtype=U64))
            break
    return h


def word_chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Words]:
    for first, offsets, data in chunks(texts, limit):
        rows = len(offsets) - 1
        word = ~SPACE[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        before = np.empty_like(word)
        before[:1] = False
        before[1:] = word[:-1]
        starts = np.flatnonzero(word & (~before | edge[:-1]))
        after = np.empty_like(word)
        after[-1:] = False
        after[:-1] = word[1:]
        ends = np.flatnonzero(word & (~after | edge[1:])) + 1
        at = np.searchsorted(starts, offsets)
        row = np.repeat(np.arange(rows), np.diff(at))
        yield Words(first, rows, row, hash_spans(data, starts, ends), at, offsets, data)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive items, by doubling."""
    size = len(h) - n + 1
    if size <= 0:
        return np.zeros(0, dtype=U64)
    out, done, power, width = None, 0, h, 1
    while True:
        if n & width:
            piece = power[done : done + size]
            out = piece.copy() if out is None else chain(out, piece)
            done += width
        if done == n:
            return out
        power = chain(power[:-width], power[width:])
        width *= 2
