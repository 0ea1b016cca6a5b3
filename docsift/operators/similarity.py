"""All-pairs similarity (dot product, diagonal included) as a pruned self join.

Rows lie in lists, balls around pivots (``balls``). The product of a row of list i and one of
list j is at most ``(longest_i^2 + longest_j^2 - gap^2) / 2``, where the gap is the least
distance the balls leave. With ``min_sim`` a pair of lists under it is never formed. With
``k`` a first pass joins every list with itself, which gives each row a k-th best product
or none; a list then meets only lists that can beat the least of its rows'. Both are exact.

A cell is two blocks of ``max_block_rows`` rows at most, or more in a large table, so that the copies of
a row don't grow with it (``knn.block_rows``). Their products are computed tile by
tile. It emits only what was asked for: pairs with ``sim >= min_sim``, or the best ``k``
partners per row (ties by partner id), finished by ``row_number() <= k``. A request for
neither is refused, and so is one that most pairs answer, as a sample of rows shows: the
N x N matrix is not a result. ``pair_share`` reports the share of pairs that is computed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsift.operators.balls import MAX_LISTS, Balls, assigned, gaps, join_cells, pivots, rows_per_cell
from docsift.operators.knn import TILE_ROWS, TopK, block_rows, matrix_of
from docsift.session import materialised, ship_package

DEFAULT_MAX_BLOCK_ROWS = 20_000
LISTS_PER_BLOCK = 4
# Blocks grow with the table up to this (and to what a cell's bytes allow).
MOST_BLOCK_ROWS = 50_000
# More pairs than this, of which a sample of rows says that more than this share is asked for, are refused.
REFUSE_PAIRS, REFUSE_SHARE, REFUSE_SAMPLE = 100_000, 0.5, 1000
SCHEMA = "id_a string, id_b string, sim double"


class TooMany(ValueError):
    """Most pairs were asked for."""


def pairs_above(a: np.ndarray, b: np.ndarray, min_sim: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, column, similarity) of the pairs of at least ``min_sim``, tile by tile."""
    for i in range(0, len(a), TILE_ROWS):
        for j in range(0, len(b), TILE_ROWS):
            s = a[i : i + TILE_ROWS] @ b[j : j + TILE_ROWS].T
            at = np.flatnonzero(s >= min_sim)  # few of many: far faster than by row and column
            r, c = np.divmod(at, s.shape[1])
            yield r + i, c + j, s.ravel()[at]


def _cell(min_sim: float | None, k: int | None, dim: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = [np.asarray(t.column("id").to_pylist(), dtype=object) for t in (left, right)]
        x = [matrix_of(t.column("embedding"), dim) for t in (left, right)]
        out = [(ids[0][:0], ids[0][:0], np.zeros(0))]
        if len(ids[0]) and len(ids[1]):
            itself = all(left.column(u)[0].as_py() == left.column(v)[0].as_py() for u, v in (("_ci", "_cj"), ("_x", "_y")))
            for mine, theirs in [(0, 1)] if itself else [(0, 1), (1, 0)]:
                if k is None:
                    out += [(ids[mine][r], ids[theirs][c], s) for r, c, s in pairs_above(x[mine], x[theirs], min_sim)]
                else:
                    best = TopK(k, len(ids[mine]), "dot", None if min_sim is None else -min_sim)
                    best.add(x[theirs], ids[theirs], x[mine], np.arange(len(ids[mine])))
                    at, partner, dist, _ = best.result()
                    out.append((ids[mine][at], partner, -dist))
        a, b, s = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"id_a": pa.array(a.tolist(), pa.string()), "id_b": pa.array(b.tolist(), pa.string()), "sim": s})

    return run


def _refuse(sample: np.ndarray, n: int, min_sim: float) -> None:
    if n * n > REFUSE_PAIRS and len(sample):
        found = sum(len(r) for r, _, _ in pairs_above(sample, sample, min_sim))
        if found > REFUSE_SHARE * len(sample) ** 2:
            raise TooMany(f"more than half of all pairs have a similarity of {min_sim} or more: the N x N matrix is not produced")


class _Lists:
    """Rows in lists, with the most that a product of two lists' rows can be."""

    def __init__(self, v: DataFrame, n: int, lists: int, max_block_rows: int):
        self.centres = pivots(v, "id", lists)
        self.rows = materialised(assigned(v, self.centres))
        self.balls = Balls.of(self.rows, len(self.centres))
        longest = self.balls.long**2
        self.bound = (longest[:, None] + longest[None, :] - gaps(self.centres, self.balls, self.balls) ** 2) / 2
        self.bound += 1e-9 * (1 + np.abs(self.bound))
        self.blocks = self.balls.blocks(min(max_block_rows, rows_per_cell(self.centres.shape[1], 64 << 20)))
        self.used = (self.balls.rows[:, None] > 0) & (self.balls.rows[None, :] > 0)

    def kept(self, min_sim: float) -> np.ndarray:
        """Unordered pairs of lists (i <= j) that can hold a product of ``min_sim``."""
        return np.triu(self.used & (self.bound >= min_sim))

    def share(self, keep: np.ndarray) -> float:
        n = self.balls.rows.astype(np.float64)
        both = np.triu(keep | keep.T, 1)
        return float((2 * (n[:, None] * n[None, :])[both].sum() + (n * n)[np.diag(keep)].sum()) / max(1.0, n.sum() ** 2))

    def join(self, keep: np.ndarray, cell) -> DataFrame:
        wanted = ["id", "embedding"]
        return join_cells(self.rows, self.rows, keep, self.blocks, self.blocks, (wanted, wanted), ("id", "id"), cell, SCHEMA, same=True)


def _lists_of(v: DataFrame, lists: int | None, max_block_rows: int) -> _Lists:
    n = v.count()
    max_block_rows = block_rows(n, max_block_rows, MOST_BLOCK_ROWS)
    if lists is None:
        lists = 1 if n <= max_block_rows else math.ceil(LISTS_PER_BLOCK * n / max_block_rows)
    return _Lists(v, n, min(MAX_LISTS, lists), max_block_rows)


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("id_a").orderBy(F.round(F.col("sim"), 9).desc(), F.col("id_b"))
    return pairs.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)


def similarity_pairs(vectors: DataFrame, min_sim: float | None = None, k: int | None = None, lists: int | None = None,
                     max_block_rows: int = DEFAULT_MAX_BLOCK_ROWS) -> DataFrame:
    """[id_a, id_b, sim] for pairs of rows of ``vectors`` [id, embedding]; ``lists`` are as many as
    the rows take if not given (one up to ``max_block_rows`` rows)."""
    if min_sim is None and k is None:
        raise ValueError("give min_sim and/or k: the full N x N matrix is not produced")
    if k is not None and int(k) < 1:
        raise ValueError("k must be >= 1")
    ship_package(vectors.sparkSession)
    v = vectors.select("id", "embedding")
    if v.isEmpty():
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    parts = _lists_of(v, lists, max_block_rows)
    dim = parts.centres.shape[1]
    least = -math.inf if min_sim is None else min_sim
    if k is None:
        _refuse(pivots(v, "id", REFUSE_SAMPLE), int(parts.balls.rows.sum()), min_sim)
        return parts.join(parts.kept(least), _cell(min_sim, None, dim))
    k = int(k)
    itself = np.diag(parts.balls.rows > 0)
    first = _ranked(parts.join(itself, _cell(min_sim, k, dim)), k)
    if len(parts.centres) == 1:
        return first.drop("_r")
    first = materialised(first)
    # The least k-th best product of a list's rows; a row without k partners yet can use any.
    full = first.filter(F.col("_r") == k).select(F.col("id_a").alias("id"), "sim")
    floor = parts.rows.select("id", "_list").join(full, "id", "left").groupBy("_list")
    floor = floor.agg(F.min(F.coalesce("sim", F.lit(-math.inf))).alias("sim"))
    needed = np.full(len(parts.centres), math.inf)
    for r in floor.collect():  # a row a list
        needed[r["_list"]] = max(least, r["sim"] - 1e-8)
    keep = np.triu(parts.used & ((parts.bound >= needed[:, None]) | (parts.bound >= needed[None, :])), 1)
    rest = parts.join(keep, _cell(min_sim, k, dim))
    return _ranked(first.drop("_r").unionByName(rest), k).drop("_r")


def pair_share(vectors: DataFrame, min_sim: float, lists: int | None = None, max_block_rows: int = DEFAULT_MAX_BLOCK_ROWS) -> float:
    """The share of all ordered pairs that ``similarity_pairs`` computes for ``min_sim``."""
    parts = _lists_of(vectors.select("id", "embedding"), lists, max_block_rows)
    return parts.share(parts.kept(min_sim))
