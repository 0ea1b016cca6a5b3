"""K2 for coarse lists: long lists are split and empty ones dropped, without assigning all again.

A list that grew past a bound is split by 2-means over a sample of its own vectors, all such
lists side by side, a group a list. Its vectors are then assigned anew. Any other vector is
nearest to its own centroid among the old ones, so only the new centroids can be nearer: it
is compared with those alone, and not at all if its distance is under half the way from its
centroid to the nearest new one (triangle inequality). Vectors of a dropped list are assigned
anew too. So the result is that of assigning every vector to the new centroids, in one scan
a round, without a shuffle of vectors but for the samples.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.operators.ann import MAX_CENTROID_BYTES, IvfIndex
from docsift.operators.knn import matrix_of
from docsift.operators.quantiser import RANK_DECIMALS, CentroidTree, by_differences
from docsift.session import materialised, ship_package

# Vectors of a list, of least id hash, that its two halves are fitted on.
SAMPLE = 512
# A list is long with this many times the square root of the table's rows.
LONG = 4
LLOYD_ROUNDS = 12
# Rounds of splits in one upkeep; a list still long then is split by the next one.
ROUNDS = 8


def two_means(x: np.ndarray) -> np.ndarray | None:
    """Two centres of the rows, or None if all are alike."""
    far = x[np.argmax(((x - x.mean(axis=0)) ** 2).sum(axis=1))]
    centres = np.stack([far, x[np.argmax(((x - far) ** 2).sum(axis=1))]])
    if (centres[0] == centres[1]).all():
        return None
    for _ in range(LLOYD_ROUNDS):
        own = np.argmin(((x[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2), axis=1)
        if own.min() == own.max():
            break
        after = np.stack([x[own == i].mean(axis=0) for i in (0, 1)])
        if (after == centres).all():
            break
        centres = after
    return centres


def _halves(vectors: DataFrame, sizes: np.ndarray, long: np.ndarray) -> dict[int, np.ndarray]:
    """The two centres of each of the ``long`` lists that has unlike vectors in its sample."""
    spark, dim = vectors.sparkSession, int(vectors.select(F.size("embedding")).first()[0])
    shares = [(int(i), min(1 << 30, math.ceil((1 << 30) * SAMPLE / sizes[i]))) for i in long]
    share = spark.createDataFrame(shares, "list_id int, share long")  # a row a list
    mine = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.col("share")
    some = vectors.join(F.broadcast(share), "list_id").filter(mine).select("list_id", "id", "embedding")

    def split(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        centres = two_means(matrix_of(table.column("embedding"), dim))
        found = [] if centres is None else [table.column("list_id")[0].as_py()]
        pair = [[] if centres is None else [centres[i].tolist()] for i in (0, 1)]
        kind = pa.list_(pa.float64())
        return pa.table({"list_id": pa.array(found, pa.int32()), "a": pa.array(pair[0], kind), "b": pa.array(pair[1], kind)})

    rows = some.groupBy("list_id").applyInArrow(split, "list_id int, a array<double>, b array<double>").collect()  # a row a list
    return {r["list_id"]: np.array([r["a"], r["b"]]) for r in rows}


def _moved(vectors: DataFrame, centroids: np.ndarray, name: np.ndarray, fresh: np.ndarray) -> DataFrame:
    """``vectors [id, embedding, list_id]`` with their list among ``centroids``: ``name`` is the
    new number of each old list that stays (-1: it doesn't), ``fresh`` the numbers, rising, of
    new centroids."""
    if centroids.nbytes > MAX_CENTROID_BYTES:
        raise ValueError(f"{len(centroids)} centroids take more than {MAX_CENTROID_BYTES} bytes: use fewer lists")
    spark, (_, dim) = vectors.sparkSession, centroids.shape
    ship_package(spark)
    apart = np.full(len(centroids), np.inf)  # from each centroid to the nearest new one
    if len(fresh):
        nearest = fresh[CentroidTree(centroids[fresh]).nearest(centroids)]
        apart = np.sqrt(by_differences(centroids, centroids, nearest)[:, 0])
    shared = spark.sparkContext.broadcast((centroids, name, fresh, apart))

    def run(batches):
        centroids, name, fresh, apart = shared.value
        every, added = CentroidTree(centroids), CentroidTree(centroids[fresh]) if len(fresh) else None
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix_of(b.column("embedding"), dim)
            own = name[b.column("list_id").to_numpy()]
            homeless = np.flatnonzero(own < 0)
            if len(homeless):
                own[homeless] = every.nearest(x[homeless])[:, 0]
            if added is not None:
                dist = by_differences(x, centroids, own[:, None])[:, 0]
                beyond = np.maximum(apart[own] - np.sqrt(dist), 0.0)
                near = beyond**2 - dist <= 4 * 10.0**-RANK_DECIMALS
                near[homeless] = False
                rows = np.flatnonzero(near)
                if len(rows):
                    other = fresh[added.nearest(x[rows])[:, 0]]
                    theirs = np.round(by_differences(x[rows], centroids, other[:, None])[:, 0], RANK_DECIMALS)
                    mine = np.round(dist[rows], RANK_DECIMALS)
                    better = (theirs < mine) | ((theirs == mine) & (other < own[rows]))
                    own[rows[better]] = other[better]
            at = b.schema.get_field_index("list_id")
            yield b.set_column(at, b.schema.field(at), pa.array(own.astype(np.int32)))

    return vectors.select("id", "embedding", "list_id").mapInArrow(run, vectors.select("id", "embedding", "list_id").schema)


def balanced(index: IvfIndex, most: int | None = None, least: int = 1, rounds: int = ROUNDS) -> IvfIndex:
    """``index`` without lists of more than ``most`` vectors (default: ``LONG`` times the square
    root of all) or fewer than ``least``, whose vectors go to the nearest other list; itself if
    there is nothing to do. One half of a split list keeps its number, the other gets a new one;
    numbers close up where lists are dropped. A list whose sample holds one vector only, over
    and over, stays whole. ``nprobe`` is carried over: fit it again."""
    n = int(index.sizes.sum())
    most = max(1, LONG * math.isqrt(n) if most is None else most)
    whole: set[int] = set()
    for step in range(rounds):
        sizes = index.sizes
        long = np.array([i for i in np.flatnonzero(sizes > most) if i not in whole], dtype=np.int64)
        drop = sizes < least if step == 0 else np.zeros(len(sizes), dtype=bool)
        if drop.all():  # the longest list stays
            drop[np.argmax(sizes)] = False
        halves = _halves(index.vectors, sizes, long) if len(long) else {}
        if not halves and not drop.any():
            break
        centroids, extra = index.centroids.copy(), []
        for i, (a, b) in sorted(halves.items()):
            centroids[i] = a
            extra.append(b)
        stays = ~drop
        closed = np.cumsum(stays) - 1
        after = np.concatenate([centroids[stays], np.array(extra).reshape(-1, centroids.shape[1])])
        split = np.array(sorted(halves), dtype=np.int64)
        name = np.where(stays, closed, -1)
        name[split] = -1
        fresh = np.concatenate([closed[split], np.arange(int(stays.sum()), len(after))])
        # A whole list is so by its number in the next round.
        whole = {int(closed[i]) for i in whole | (set(long.tolist()) - set(halves)) if stays[i]}
        index = IvfIndex.over(materialised(_moved(index.vectors, after, name, fresh)), after, index.nprobe)
    return index
