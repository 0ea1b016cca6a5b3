"""Operator 11: embedding whitening from a bit-sliced scatter matrix.

Each entry becomes an integer, ``floor(scale * c) + offset``. The fit list is every
distinct integer vector once (a grouped key, so copies cost one row). Its scatter is
exact: every dimension is shifted by its least value, the bits of its integers are
packed across rows into words (64 rows a word), and the cross-product of two
dimensions is the sum over their bit planes of ``2 ** (a + b) * popcount(A & B)``.
Tasks emit one exact integer for each pair of dimensions, cut into 32-bit limbs, and
Spark adds the limbs. The covariance ``(n * T - s s') / n^2`` is centred in integers, so
nothing is lost before ``eigh``.

The driver holds numbers by dimension only: the least values, the scatter (dimension
squared) and the components, which tasks get in their function. Vectors stay in tasks,
a slice of rows at a time. The scatter's shuffle is a row a task and pair of dimensions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.session import ship_package

from .common import remove, written

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
# Numbers in a slice of rows, and rows whose planes are multiplied at once (64 words a plane).
SLICE_NUMBERS = 1 << 19
PLANE_ROWS = 4096
LIMBS = 5
# Integers beyond this don't take part in floating sums exactly.
LONG = 2**63 - 1

OUTPUT = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def _integers(column: pa.Array, dim: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(row numbers, integer matrix, least length) of slices of the usable vectors of a
    list column; shorter vectors are filled with zero entries."""
    lists = column.cast(pa.large_list(pa.float64()))
    offsets = lists.offsets.to_numpy()
    if not len(lists):
        return
    values = lists.values.to_numpy(zero_copy_only=False)
    fine = np.isfinite(values)  # a null entry reads as NaN
    bad = np.concatenate([[0], np.cumsum(~fine)])
    usable = np.asarray(lists.is_valid()) & (bad[offsets[1:]] == bad[offsets[:-1]])
    rows, lengths = np.flatnonzero(usable), np.diff(offsets)
    if not len(rows):
        return
    width = int(lengths[rows].max()) if dim is None else dim
    step = max(1, SLICE_NUMBERS // max(1, width))
    for a in range(0, len(rows), step):
        some = rows[a : a + step]
        size = lengths[some]
        x = np.full((len(some), width), OFFSET, dtype=np.int64)
        at = np.repeat(np.arange(len(some)), size)
        pos = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
        c = np.floor(SCALE * values[np.repeat(offsets[some], size) + pos])
        if len(c) and np.abs(c).max() >= 2.0**62:
            raise ValueError("an entry is too large for a long after scaling")
        x[at, pos] = c.astype(np.int64) + OFFSET
        yield some, x, int(size.min())


def _least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dimension, least integer, least length) of a task; dimension -1 marks its rows."""
    low, short = np.zeros(0, dtype=np.int64), None
    for b in batches:
        for _, x, size in _integers(b.column("embedding")):
            short = size if short is None else min(short, size)
            mine = x.min(axis=0)
            if len(mine) < len(low):
                mine, low = low, mine
            mine[: len(low)] = np.minimum(mine[: len(low)], low)
            low = mine
    if short is not None:
        dims = np.arange(-1, len(low), dtype=np.int32)
        low = np.concatenate([[0], low])
        yield pa.RecordBatch.from_arrays(
            [pa.array(dims), pa.array(low), pa.array(np.full(len(low), short, dtype=np.int32))], ["dim", "low", "short"]
        )


def _keys(low: np.ndarray):
    """Every vector as bytes: its shifted integers, little-endian, in 4 bytes each if all fit, else in 8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, x, _ in _integers(b.column("embedding"), len(low)):
                y = x - low
                small = (y < 2**32).all(axis=1)
                keys = np.empty(len(y), dtype=object)
                for fits, kind in ((True, "<u4"), (False, "<u8")):
                    at = np.flatnonzero(small == fits)
                    keys[at] = [r.tobytes() for r in y[at].astype(kind)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary())], ["key"])

    return run


def _shifted(column: pa.Array, dim: int, rows: int) -> Iterator[np.ndarray]:
    """Shifted integer matrices (uint64) of at most ``rows`` rows, from the keys."""
    keys = column.to_pylist()
    for a in range(0, len(keys), rows):
        some = keys[a : a + rows]
        y = np.empty((len(some), dim), dtype=np.uint64)
        small = np.array([len(k) == 4 * dim for k in some])
        for fits, kind in ((True, "<u4"), (False, "<u8")):
            at = np.flatnonzero(small == fits)
            if len(at):
                y[at] = np.frombuffer(b"".join(some[i] for i in at), dtype=kind).reshape(len(at), dim)
        yield y


def bit_planes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(planes, dimension, bit) of an unsigned matrix: the bits of one dimension across
    rows, 64 rows a word; planes without a bit are left out. Planes are by dimension."""
    rows, dim = y.shape
    words = -(-rows // 64)
    planes, dims, bits = [], [], []
    columns = np.zeros((dim, words * 64), dtype=np.uint64)
    columns[:, :rows] = y.T
    for bit in range(int(y.max()).bit_length() if y.size else 0):
        packed = np.packbits(((columns >> np.uint64(bit)) & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little").view("<u8")
        some = np.flatnonzero(packed.any(axis=1))
        planes.append(packed[some])
        dims.append(some)
        bits.append(np.full(len(some), bit))
    if not planes:
        return np.zeros((0, words), dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    dims, bits = np.concatenate(dims), np.concatenate(bits)
    order = np.lexsort((bits, dims))
    return np.concatenate(planes)[order], dims[order], bits[order]


def scatter(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact (cross-products, sums) of an unsigned matrix, as Python integers: weighted
    popcounts of the ANDs of bit planes. Cross-products below the diagonal stay 0."""
    dim = y.shape[1]
    planes, dims, bits = bit_planes(y)
    cross, total = np.zeros((dim, dim), dtype=object), np.zeros(dim, dtype=object)
    small = bool(len(bits)) and 2 * int(bits.max()) + 1 + (len(y) * len(bits)).bit_length() < 63
    kind = np.int64 if small else object
    weight = np.array([1 << int(b) for b in bits], dtype=kind)
    np.add.at(total, dims, np.bitwise_count(planes).sum(axis=1, dtype=np.int64).astype(kind) * weight)
    first = np.flatnonzero(np.r_[True, dims[1:] != dims[:-1]]) if len(dims) else np.zeros(0, dtype=np.int64)
    out = np.zeros((dim, dim), dtype=kind)
    for k, plane in enumerate(planes):
        a = int(first[np.searchsorted(first, k, "right") - 1])  # planes of this and later dimensions
        counts = np.bitwise_count(planes[a:] & plane).sum(axis=1, dtype=np.uint32).astype(kind)
        sums = np.add.reduceat(counts * weight[a:], first[first >= a] - a)
        out[dims[k], dims[first[first >= a]]] += sums * weight[k]
    cross += out
    return cross, total


def _scatter_rows(dim: int):
    """A task's (i, j, limbs) for i <= j, the sums as j = -1 and the number of rows as i = j = -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cross, total, n = np.zeros((dim, dim), dtype=object), np.zeros(dim, dtype=object), 0
        for b in batches:
            for y in _shifted(b.column("key"), dim, PLANE_ROWS):
                c, t = scatter(y)
                cross, total, n = cross + c, total + t, n + len(y)
        if n:
            i, j = np.triu_indices(dim)
            values = np.concatenate([cross[i, j], total, [n]])
            rows = [np.concatenate([i, np.arange(dim), [-1]]), np.concatenate([j, np.full(dim, -1), [-1]])]
            limbs = [((values >> 32 * k) & 0xFFFFFFFF).astype(np.int64) for k in range(LIMBS)]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(r.astype(np.int32)) for r in rows), *map(pa.array, limbs)],
                ["i", "j", *(f"l{k}" for k in range(LIMBS))],
            )

    return run


def components_of(n: int, cross: np.ndarray, total: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, unit components as columns, explained shares), largest first, from exact
    integer sums; eigenvalues that are 0 in double precision are left out."""
    full = cross + cross.T
    full[np.diag_indices(len(total))] //= 2
    v = np.array([[int(c) / (n * n) for c in row] for row in n * full - np.outer(total, total)], dtype=np.float64)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    some = min(most, int((values > len(v) * np.finfo(float).eps * max(values[0], 0)).sum())) if len(v) else 0
    trace = float(np.trace(v))
    return values[:some], vectors[:, :some], values[:some] / trace if some else values[:0]


def _projected(centred: np.ndarray, vectors: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Whitened rows from ``n * x - S``."""
    return (centred / n) @ vectors / np.sqrt(values)


def _centred(x: np.ndarray, low: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """``n * x - S`` exactly: as int64 where that is wide enough, else as Python integers.
    ``total`` are the sums of ``x - low``, to which the shift makes no difference."""
    y = x - low
    if n * int(y.max(initial=0)) < 2**62 and int(np.max(total, initial=0)) < 2**62:
        return n * y - total.astype(np.int64)
    return n * y.astype(object) - total


def _moments(dim: int, low, n: int, total, vectors, values):
    """A task's sums of whitened rows and of their products: (i, j, value), j = -1 for sums."""
    k = len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = np.zeros(k), np.zeros((k, k))
        for b in batches:
            for y in _shifted(b.column("key"), dim, max(1, SLICE_NUMBERS // dim)):
                w = _projected(_centred(y.astype(np.int64), 0, n, total).astype(np.float64), vectors, values, n)
                one += w.sum(axis=0)
                two += w.T @ w
        i, j = np.indices((k, k)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[i, np.arange(k)].astype(np.int32)), pa.array(np.r_[j, np.full(k, -1)].astype(np.int32)), pa.array(np.r_[two.ravel(), one])],
            ["i", "j", "value"],
        )

    return run


def _squares(d: np.ndarray) -> pa.Array:
    """Row sums of squares, exact; null where a long can't hold one."""
    top = int(np.abs(d).max(initial=0))
    if top * top * max(1, d.shape[1]) <= LONG:
        d = d.astype(np.int64)
        return pa.array((d * d).sum(axis=1))
    sums = (d.astype(object) ** 2).sum(axis=1)
    return pa.array([int(s) if s <= LONG else None for s in sums], pa.int64())


def _whitened(low, n: int, total, vectors, values, explained, error: float):
    k = len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, x, _ in _integers(b.column("embedding"), len(low)):
                d = _centred(x, low, n, total)
                w = _projected(d.astype(np.float64), vectors, values, n)
                each = pa.array(np.repeat(np.arange(len(rows)), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("vec_id").take(pa.array(rows)).take(each),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                        pa.array(np.full(len(rows) * k, n, dtype=np.int64)),
                        _squares(d).take(each),
                        pa.array(w.ravel()),
                        pa.array(np.tile(explained, len(rows))),
                        pa.array(np.full(len(rows) * k, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return run


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each row
    of ``rows (vec_id, embedding)`` and each of its ``components`` largest principal
    components.

    Rows whose vector is null or has a null or non-finite entry are left out; a null vec_id
    is kept as it is. A shorter vector counts as filled with zeros up to the longest. Repeated
    rows each give their rows, and count once in the fit; n is the size of the fit list.
    Components without variance can't be whitened and are left out, so equal vectors (or one)
    give no rows, as does an empty table. ``deviation`` is null where a long can't hold it, which
    takes about 10 million vectors. Other columns are not used. An entry beyond 7e16 raises."""
    spark = rows.sparkSession
    ship_package(spark)
    vectors = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    least = vectors.select("embedding").mapInArrow(_least, "dim int, low long, short int")
    least = least.groupBy("dim").agg(F.min("low"), F.min("short")).orderBy("dim").collect()  # a row a dimension
    empty = spark.createDataFrame([], OUTPUT)
    if len(least) < 2:
        return empty
    low = np.array([r[1] for r in least[1:]], dtype=np.int64)
    low[least[0][2] :] = np.minimum(low[least[0][2] :], OFFSET)
    dim = len(low)
    keys = vectors.select("embedding").mapInArrow(_keys(low), "key binary").distinct()
    fit, path = written(keys, "whitening-fit")
    limbs = [f"l{k}" for k in range(LIMBS)]
    sums = (
        fit.mapInArrow(_scatter_rows(dim), "i int, j int, " + ", ".join(f"{name} long" for name in limbs))
        .groupBy("i", "j").agg(*(F.sum(name).alias(name) for name in limbs))
    ).toArrow()  # a row a pair of dimensions
    i, j = (sums.column(c).to_numpy() for c in "ij")
    value = sum(sums.column(name).to_numpy().astype(object) << 32 * k for k, name in enumerate(limbs))
    cross, total = np.zeros((dim, dim), dtype=object), np.zeros(dim, dtype=object)
    pair, single = j >= 0, (j < 0) & (i >= 0)
    cross[i[pair], j[pair]] = value[pair]
    total[i[single]] = value[single]
    n = int(value[i < 0][0])
    values, axes, explained = components_of(n, cross, total, components)
    if not len(values):
        remove(spark, path)
        return empty
    moments = (
        fit.mapInArrow(_moments(dim, low, n, total, axes, values), "i int, j int, value double")
        .groupBy("i", "j").agg(F.sum("value").alias("value"))
    ).toPandas()  # components squared
    remove(spark, path)
    k = len(values)
    one, two = np.zeros(k), np.zeros((k, k))
    diagonal = moments["j"] < 0
    one[moments["i"][diagonal]] = moments["value"][diagonal] / n
    two[moments["i"][~diagonal], moments["j"][~diagonal]] = moments["value"][~diagonal] / n
    error = float(np.abs(two - np.outer(one, one) - np.eye(k)).max())
    return vectors.mapInArrow(_whitened(low, n, total, axes, values, explained, error), OUTPUT)
