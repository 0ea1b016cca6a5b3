"""Byte-pair encoding of Arrow text columns with the tokenizers library.

The library's byte-level pre-tokenizer never lets a token cross certain places: before a
single space or line feed between characters that aren't white space, after such a line
feed, and between an ASCII letter and a punctuation mark. Texts are cut there into short
units; each distinct unit is encoded by the library once per worker, and texts are put
together from the units' ids. The ids equal those of encoding each text whole."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from .common import U64
from .words import chunks, hash_spans

CHUNK_BYTES = 2_000_000
CACHE_UNITS, CACHE_IDS = 1_500_000, 16_000_000  # memory only: a full cache is begun anew

_VISIBLE = np.zeros(256, dtype=bool)  # bytes that may stand before a cut
_VISIBLE[0x21:0x7F] = True
_VISIBLE[0x80:] = True
_OPENING = np.zeros(256, dtype=bool)  # and after it: no lead byte of a block with white space
_OPENING[0x21:0x7F] = True
_OPENING[0xC3:] = True
_OPENING[[0xE1, 0xE2, 0xE3]] = False
_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[list(b".,;:!?")] = True
_ODD_BYTE = np.zeros(256, dtype=bool)  # white space, or a lead byte of a block with some
_ODD_BYTE[:0x21] = True
_ODD_BYTE[[0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = True


def _cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions where units begin."""
    n = len(data)
    before = np.zeros(n + 3, dtype=np.uint8)
    before[3:] = data
    one, two, three = before[2 : n + 2], before[1 : n + 1], before[:n]  # 1, 2 and 3 bytes back
    ends = _VISIBLE[one] & ~((one >= 0x80) & ((two == 0xC2) | (three >= 0xE1) & (three <= 0xE3)))
    after = np.zeros(n + 1, dtype=np.uint8)
    after[:n] = data
    gap = ((data == 0x20) | (data == 0x0A)) & ends & _OPENING[after[1:]]
    start = np.zeros(n + 1, dtype=bool)
    start[:n] = gap | (_MARK[data] & _LETTER[one])
    start[1:] |= gap & (data == 0x0A)
    start[offsets] = True
    return np.flatnonzero(start)


class Encoder:
    """``ids(column)`` gives token ids of texts; one for each worker process."""

    _kept: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = True  # their strings in a text are ordinary text
        self.dtype = np.uint16 if self.lib.get_vocab_size() <= 1 << 16 else np.uint32
        feed = self.lib.encode("\n", add_special_tokens=False).ids
        self.feed = feed[0] if len(feed) == 1 else None
        self._clear()

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def _clear(self):
        self.hash = np.zeros(0, dtype=U64)
        self.start = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int64)
        self.pool = np.zeros(0, dtype=self.dtype)

    def _encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, number of ids of each unit, place of its first). Units without white space but a space
        before them go to the library as lines of one text; the others one by one."""
        odd = _ODD_BYTE[data]
        odd[starts[data[starts] == 0x20]] = False
        sums = np.append(0, np.cumsum(odd))
        plain = (sums[ends] == sums[starts]) & ((ends - starts > 1) | (data[starts] != 0x20)) & (self.feed is not None)
        size = np.zeros(len(starts), dtype=np.int64)
        easy, rest = np.flatnonzero(plain), np.flatnonzero(~plain)
        texts = []
        for k in range(0, len(easy), 4000):
            part = easy[k : k + 4000]
            length = ends[part] - starts[part] + 1  # with a line feed
            at = np.repeat(starts[part] - (np.cumsum(length) - length), length) + np.arange(length.sum())
            line = data[np.minimum(at, len(data) - 1)]
            line[np.cumsum(length) - 1] = 0x0A
            texts.append(line[:-1].tobytes().decode())
        flat = []
        for k, e in zip(range(0, len(easy), 4000), self.lib.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            got = np.array(e.ids, dtype=self.dtype)
            feeds = np.flatnonzero(got == self.feed)
            part = easy[k : k + 4000]
            if len(feeds) != len(part) - 1:
                raise RuntimeError("the tokenizer joins a line feed with other characters")
            size[part] = np.diff(np.concatenate([[-1], feeds, [len(got)]])) - 1
            flat.append(got[got != self.feed])
        raw = [data[starts[i] : ends[i]].tobytes().decode() for i in rest]
        for i, e in zip(rest, self.lib.encode_batch_fast(raw, add_special_tokens=False), strict=True):
            size[i] = len(e.ids)
            flat.append(np.array(e.ids, dtype=self.dtype))
        order = np.concatenate([easy, rest])
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.cumsum(size[order]) - size[order]
        ids = np.concatenate(flat) if flat else np.zeros(0, dtype=self.dtype)
        return ids, size, place

    def chunk_ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, number of ids of each row)."""
        rows = len(offsets) - 1
        if not len(data):
            return np.zeros(0, dtype=self.dtype), np.zeros(rows, dtype=np.int64)
        cut = _cuts(data, offsets)
        starts = cut[cut < len(data)]
        ends = np.append(starts[1:], len(data))
        h = hash_spans(data, starts, ends)
        unique, sample, of = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hash, unique)
        known = at < len(self.hash)
        known[known] = self.hash[at[known]] == unique[known]
        if not known.all():
            if len(self.hash) > CACHE_UNITS or len(self.pool) > CACHE_IDS:
                self._clear()
                known[:] = False
                at[:] = 0
            new = np.flatnonzero(~known)
            ids, size, place = self._encode(data, starts[sample[new]], ends[sample[new]])
            where = at[new]
            self.start = np.insert(self.start, where, len(self.pool) + place)
            self.size = np.insert(self.size, where, size)
            self.hash = np.insert(self.hash, where, unique[new])
            self.pool = np.concatenate([self.pool, ids])
            at = np.searchsorted(self.hash, unique)
        unit = at[of]
        size = self.size[unit]
        total = np.append(0, np.cumsum(size))
        ids = self.pool[np.repeat(self.start[unit] - total[:-1], size) + np.arange(total[-1])]
        return ids, np.diff(total[np.searchsorted(starts, offsets)])

    def ids(self, column: pa.Array):
        """(first row, ids, number of ids of each row) for runs of rows; null is empty."""
        from .words import texts_of

        for first, offsets, data in chunks(texts_of(column), CHUNK_BYTES):
            yield first, *self.chunk_ids(data, offsets)
