"""The nearest rows of many queries in one task, and how the two sides reach it.

``Nearest`` compares rows, given a chunk at a time, with a block of queries. Products in single precision
tell which rows may be among a query's k nearest: those are put aside (``width`` places a query) and cut to the k best
when there are many, so a query costs little beyond its products. What is left is settled by distances from
differences, ranked by the distance rounded to 1e-9, then by id, as everywhere.

``streamed`` brings blocks of queries and their rows to the tasks: a task takes its queries first and then sees
all their rows pass, so it gives a query's k best once, whatever the number of rows, and holds one chunk of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANK_DECIMALS = 9
ROWS, QUERIES = 256, 1024
# Numbers in a temporary array of differences.
NUMBERS = 1 << 21
# Rows that pass a block of queries at once.
CHUNK = 1 << 14
# Places that a task has for rows put aside.
PLACES = 1 << 24
# Squared lengths up to which products fit single precision.
MOST_LENGTH = 1e15


def places(ordered: np.ndarray) -> np.ndarray:
    """The place of each entry in its run of equal entries."""
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, dtype=np.int64)
    return np.arange(len(ordered)) - np.repeat(first, np.diff(np.append(first, len(ordered))))


def ranked(query: np.ndarray, key: np.ndarray, k: int, names: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, query, place) of the ``k`` best entries of each query, by (key, name), in order."""
    order = np.lexsort((key, query))
    same = (query[order][1:] == query[order][:-1]) & (key[order][1:] == key[order][:-1])
    if same.any():  # names decide between equal keys alone
        tied = order[np.append(same, False) | np.append(False, same)]
        rank = np.zeros(len(query), dtype=np.int64)
        rank[tied] = np.unique(names(tied).astype(str), return_inverse=True)[1]
        order = np.lexsort((rank, key, query))
    query = query[order]
    place = places(query)
    best = place < k
    return order[best], query[best], place[best]


def by_pairs(x: np.ndarray, q: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Squared distances of rows ``x[row]`` and ``q[col]``, from differences."""
    out = np.empty(len(row))
    step = max(1, NUMBERS // max(1, q.shape[1]))
    for a in range(0, len(row), step):
        d = x[row[a : a + step]] - q[col[a : a + step]]
        out[a : a + step] = np.einsum("ij,ij->i", d, d)
    return out


def width_of(k: int) -> int:
    return 4 * k + 64 + ROWS


def most_queries(k: int) -> int:
    """Queries of a block, for the places put aside."""
    return max(1, PLACES // width_of(k))


def true_places(mask: np.ndarray) -> np.ndarray:
    """``flatnonzero`` of a mask with few true places, whose size is a multiple of 8."""
    words = np.flatnonzero(mask.view(np.uint64) != 0)
    at, byte = np.nonzero(mask.reshape(-1, 8)[words])
    return words[at] * 8 + byte


class Nearest:
    """The k nearest rows of each of the queries ``q``, by (squared distance rounded, id). ``most``, if given, is
    a bound of each query's k-th distance, or of the distances wanted. Squared lengths are under ``MOST_LENGTH``."""

    def __init__(self, q: np.ndarray, k: int, most: np.ndarray | None = None):
        n, dim = q.shape
        self.q, self.k, self.centre = q, k, q.mean(axis=0) if n else np.zeros(dim)
        y = q - self.centre
        self.length, self.far = np.einsum("ij,ij->i", y, y), float(np.einsum("ij,ij->i", q, q).max(initial=0))
        self.y = np.concatenate([y, np.ones((n, 1))], axis=1).astype(np.float32)
        self.limit = np.full(n, np.inf) if most is None else np.array(most, dtype=np.float64)
        self.count, self.slack = np.zeros(n, dtype=np.int64), np.zeros(n)
        # Rows put aside: minus the products, which rise with the distance, and numbers.
        self.value = np.empty((n, width_of(k)), dtype=np.float32)
        self.row = np.empty((n, width_of(k)), dtype=np.int32)
        # Rows settled: places in ``names``, distances and ranking keys, nearest first.
        self.key, self.dist = np.full((n, k), np.inf), np.full((n, k), np.inf)
        self.name = np.full((n, k), -1, dtype=np.int64)
        self.names: list[np.ndarray] = []
        self.marks: list[np.ndarray] = []
        self.known = 0

    def start(self, vectors: Callable[[np.ndarray], np.ndarray], names: np.ndarray, tags: np.ndarray | None = None) -> None:
        """A chunk of rows: ``vectors`` gives those of some numbers, ``names`` their ids by number; ``tags`` are numbers
        that are kept with them."""
        self.vectors, self.ids, self.numbers = vectors, names, np.zeros(len(names), dtype=np.int32) if tags is None else tags

    def add(self, x: np.ndarray, first: int = 0, at: np.ndarray | None = None) -> None:
        """Compare rows ``x`` of the chunk, numbered from ``first``, with all queries or those ``at``."""
        at = np.arange(len(self.q)) if at is None else at
        mask = np.zeros(ROWS * QUERIES, dtype=bool)
        step = -(-len(x) // max(1, -(-len(x) // ROWS)))  # even tiles
        for a in range(0, len(x), max(1, step)):
            rows = x[a : a + step]
            far = float(np.einsum("ij,ij->i", rows, rows).max())
            rows = rows - self.centre
            length = np.einsum("ij,ij->i", rows, rows)
            rows = np.concatenate([rows, -0.5 * length[:, None]], axis=1).astype(np.float32)
            for b in range(0, len(at), QUERIES):
                self._tile(rows, float(length.max()), far, first + a, at[b : b + QUERIES], mask)

    def _tile(self, rows, top, far, first, at, mask) -> None:
        got = self.y[at] @ rows.T
        slack = 1e-9 + 2.0**-22 * (rows.shape[1] + 8) * (np.sqrt(top * self.length[at]) + top) + 1e-13 * (far + self.far)
        self.slack[at] = np.maximum(self.slack[at], slack)
        least = ((self.length[at] - self.limit[at]) / 2 - 2 * slack).astype(np.float32)
        least = np.nextafter(least, np.float32(-np.inf))
        size = -(-got.size // 8) * 8
        mask[got.size : size] = False
        np.greater_equal(got, least[:, None], out=mask[: got.size].reshape(got.shape))
        near = true_places(mask[:size])
        if not len(near):
            return
        col, row = np.divmod(near, got.shape[1])
        who = at[col]
        place = self.count[who] + places(col)
        self.value[who, place] = -got.reshape(-1)[near]
        self.row[who, place] = first + row
        self.count[at] += np.bincount(col, minlength=len(at))
        full = at[self.count[at] > 4 * self.k + 64]
        if len(full):
            self._cut(full)
            crowded = full[self.count[full] > 4 * self.k + 64]
            if len(crowded):  # single precision, or equal distances, leave too many
                self._settle(crowded)

    def _cut(self, at: np.ndarray) -> None:
        """Of the rows put aside for queries ``at`` (k or more each), those that may be among the k nearest."""
        for a in range(0, len(at), QUERIES):
            some = at[a : a + QUERIES]
            wide = int(self.count[some].max())
            value, row = self.value[some, :wide], self.row[some, :wide]
            value[np.arange(wide)[None, :] >= self.count[some][:, None]] = np.inf
            last = np.partition(value, self.k - 1, axis=1)[:, self.k - 1].astype(np.float64)
            bound = np.nextafter((last + 2 * self.slack[some]).astype(np.float32), np.float32(np.inf))
            self.limit[some] = np.minimum(self.limit[some], self.length[some] + 2 * (last + self.slack[some]))
            col, place = np.nonzero(value <= bound[:, None])
            to = places(col)
            self.value[some[col], to], self.row[some[col], to] = value[col, place], row[col, place]
            self.count[some] = np.bincount(col, minlength=len(some))

    def settle(self) -> None:
        """Take the rows put aside into the result; ends the chunk."""
        self._cut(np.flatnonzero(self.count > self.k))
        at = np.flatnonzero(self.count)
        for a in range(0, len(at), QUERIES):
            self._settle(at[a : a + QUERIES])
        if len(at):  # names of earlier chunks that are still in use
            used = np.isfinite(self.key)
            alive, place = np.unique(self.name[used], return_inverse=True)
            self.names, self.marks, self.known = [np.concatenate(self.names)[alive]], [np.concatenate(self.marks)[alive]], len(alive)
            self.name[used] = place

    def _settle(self, at: np.ndarray) -> None:
        count = self.count[at]
        col = np.repeat(np.arange(len(at)), count)
        place = np.arange(len(col)) - np.repeat(np.cumsum(count) - count, count)
        who = at[col]
        self.count[at] = 0
        low = self.length[who] + 2 * (self.value[who, place].astype(np.float64) - 2 * self.slack[who])
        near = low <= self.limit[who] + 1e-9
        col, who, row = col[near], who[near], self.row[who[near], place[near]]
        if not len(col):
            return
        numbers, inside = np.unique(row, return_inverse=True)
        dist = by_pairs(self.vectors(numbers), self.q, inside, who)
        near = dist <= self.limit[who] + 1e-9
        col, inside, dist = col[near], inside[near], dist[near]
        self.names.append(self.ids[numbers])
        self.marks.append(self.numbers[numbers])
        name, self.known = inside + self.known, self.known + len(numbers)
        held, where = np.nonzero(np.isfinite(self.key[at]))
        query = np.concatenate([held, col])
        dist = np.concatenate([self.dist[at[held], where], dist])
        name = np.concatenate([self.name[at[held], where], name])
        key = np.round(dist, RANK_DECIMALS)
        order, query, rank = ranked(query, key, self.k, lambda some: np.concatenate(self.names)[name[some]])
        self.key[at], self.dist[at] = np.inf, np.inf
        self.key[at[query], rank], self.dist[at[query], rank], self.name[at[query], rank] = key[order], dist[order], name[order]
        self.limit[at] = np.minimum(self.limit[at], self.key[at, self.k - 1] + 10.0**-RANK_DECIMALS)

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, dist, key) of all kept rows, by query and nearest first."""
        q, r = np.nonzero(np.isfinite(self.key))
        names = np.concatenate(self.names) if self.names else np.zeros(0, dtype=object)
        return q, names[self.name[q, r]], self.dist[q, r], self.key[q, r]

    def tags(self) -> np.ndarray:
        """The tags of the rows of ``result``."""
        return np.concatenate(self.marks)[self.name[np.isfinite(self.key)]] if self.marks else np.zeros(0, dtype=np.int32)


def block_count(spark, rows: int, most: int) -> int:
    """Blocks of at most ``most`` of ``rows`` queries, as many in every round of the session's tasks."""
    tasks, least = max(1, spark.sparkContext.defaultParallelism), -(-max(rows, 1) // most)
    return max(least, min(-(-max(rows, 1) // 64), -(-least // tasks) * tasks))


def streamed(queries: DataFrame, rows: DataFrame, blocks: int, order: list[str], begin: Callable, chunk: Callable, end: Callable, schema, most: int = CHUNK) -> DataFrame:
    """``begin(queries)``, ``chunk(state, rows)`` and ``end(state)`` for each of the ``blocks`` (column ``_b`` from 0 of both
    tables): tables of Arrow, the rows in ``order``, up to about ``most`` at once; ``end`` gives batches of ``schema``."""
    # Not null: Spark's Arrow writer takes time with the square of a batch for columns of many nulls.
    none = lambda t: F.array().cast(t) if isinstance(t, T.ArrayType) else F.lit("" if isinstance(t, T.StringType) else bytearray() if isinstance(t, T.BinaryType) else 0).cast(t)
    empty = lambda df, other: [*(F.col(c) for c in df.columns), *(none(f.dataType).alias(f.name) for f in other.schema if f.name not in df.columns)]
    both = queries.select(F.lit(0).alias("_s"), *empty(queries, rows)).unionByName(rows.select(F.lit(1).alias("_s"), *empty(rows, queries)))
    both = both.repartitionById(blocks, "_b").sortWithinPartitions("_b", "_s", *order)

    def parts(batches) -> Iterator[tuple[int, int, pa.RecordBatch]]:
        for b in batches:
            if b.num_rows:
                key = np.stack([b.column(n).to_numpy() for n in ("_b", "_s")], axis=1)
                cut = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1), b.num_rows]
                yield from ((*key[a], b.slice(a, z - a)) for a, z in zip(cut[:-1], cut[1:], strict=True))

    def run(batches):
        block, side, held, state = None, 0, [], None

        def passed():
            nonlocal state, held
            if held:
                t, held = pa.Table.from_batches(held).combine_chunks(), []
                if side == 0:
                    state = begin(t)
                elif state is not None:
                    chunk(state, t)

        for b, s, t in parts(batches):
            if b != block or s != side or (s == 1 and sum(x.num_rows for x in held) >= most):
                passed()
                if b != block:
                    if state is not None:
                        yield from end(state)
                    block, state = b, None
                side = s
            held.append(t)
        passed()
        if state is not None:
            yield from end(state)

    return both.mapInArrow(run, schema)
