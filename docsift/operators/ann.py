"""Approximate nearest neighbours through coarse lists (IVF).

Build (K3): ``pyspark.ml`` KMeans (k-means||, distributed) over a bounded sample of the vectors
(``TRAIN_ROWS`` a list, of least id hash) gives ``nlist`` centroids, unless they are given; every
vector is assigned to its nearest one (``list_id``), once, by a tree of two levels
(``quantiser``). Centroids and list sizes (a row a list) are all that the driver holds. Vectors
written ``partitionBy('list_id')`` let a search read only the lists it probes.

Search (K4 + J7): each query probes its nearest lists, as many as its setting says and at
least until their sizes sum to k (or ``ef_search``, if given): so it gets min(k, n) rows, as
the exact search does. Queries of one block go to all tasks with their probes; the table is
scanned once after list pruning, and each row meets only the queries that probe its list. No
shuffle of vectors, so a hot list is scanned by many tasks. More queries than a block never
pass the driver: near lists form groups (about the square root of the number of lists), a query goes
once to each group that it probes, with its lists there, and meets the group's vectors in cells
bounded by bytes. Probing every list equals the exact search.

Upkeep (K2): ``carry_lists`` keeps the list of every vector that hasn't changed and assigns the
others; the result is that of assigning all.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsift.operators.balls import rows_per_cell
from docsift.operators.knn import (
    BLOCK_BYTES,
    SALTS,
    TopK,
    _union,
    arrow_type,
    block_rows,
    final_rank,
    knn,
    matrix_of,
    max_dist_of,
    partial_schema,
    query_blocks,
)
from docsift.operators.quantiser import NUMBERS, RANK_DECIMALS, CentroidTree, by_differences, squared
from docsift.schema import check_k
from docsift.session import materialised, ship_package


# Vectors that KMeans is trained on, for each list.
TRAIN_ROWS = 256
# Rows that a task keeps for its queries, and queries that are routed at once.
MOST_ROWS, ROUTE_ROWS = 2_000_000, 2048
# Queries of a cell, while there are few.
LEAST_QUERIES = 1024
# Centroids up to this size travel to all executors; beyond it, quantise again (fewer lists).
MAX_CENTROID_BYTES = 1 << 30


def nearest_lists(x: np.ndarray, centroids: np.ndarray, m: int | None = None) -> np.ndarray:
    """[n, m] list ids by ascending squared distance, ties by list id (all lists without ``m``)."""
    return CentroidTree(centroids).nearest(x, len(centroids) if m is None else m)


def assign_lists(df: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``df [.., embedding]`` with the ``list_id`` of the nearest centroid."""
    spark = df.sparkSession
    ship_package(spark)
    if centroids.nbytes > MAX_CENTROID_BYTES:
        raise ValueError(f"{len(centroids)} centroids take more than {MAX_CENTROID_BYTES} bytes: use fewer lists")
    shared = spark.sparkContext.broadcast(np.ascontiguousarray(centroids, dtype=np.float64))
    schema = T.StructType([*df.schema.fields, T.StructField("list_id", T.IntegerType(), False)])

    def run(batches):
        tree = CentroidTree(shared.value)
        for b in batches:
            if b.num_rows:
                lists = tree.nearest(matrix_of(b.column("embedding"), tree.centroids.shape[1]))[:, 0]
                yield b.append_column("list_id", pa.array(lists.astype(np.int32)))

    return df.mapInArrow(run, schema)


def carry_lists(vectors: DataFrame, old: DataFrame, centroids: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """K2: (lists, changed) of ``vectors [id, embedding]`` from the ``old`` ones [id, embedding,
    list_id] around the same centroids: a vector that is as it was keeps its list; the ``changed``
    ones [id, embedding], few after an edit, are materialised and assigned."""
    before = old.select("id", F.col("embedding").alias("_was"), "list_id")
    joined = vectors.select("id", "embedding").join(before, "id", "left")
    same = F.col("embedding").eqNullSafe(F.col("_was"))
    changed = materialised(joined.filter(~same).select("id", "embedding"))
    kept = joined.filter(same).select("id", "embedding", "list_id")
    return kept.unionByName(assign_lists(changed, centroids)), changed


@dataclass
class IvfIndex:
    centroids: np.ndarray
    vectors: DataFrame  # [id, embedding, list_id]
    sizes: np.ndarray  # rows of each list
    nprobe: int = 1  # lists a query probes at least; see fit_nprobe

    @property
    def nlist(self) -> int:
        return len(self.centroids)

    @staticmethod
    def over(vectors: DataFrame, centroids: np.ndarray, nprobe: int = 1) -> IvfIndex:
        """An index over assigned vectors; counts the lists."""
        sizes = np.zeros(len(centroids), dtype=np.int64)
        for r in vectors.groupBy("list_id").agg(F.count("*").alias("n")).collect():  # a row a list
            sizes[r["list_id"]] = r["n"]
        return IvfIndex(centroids, vectors, sizes, nprobe)

    def probes(self, q: np.ndarray, want: int, nprobe: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(lists of each query, nearest first; how many of them it probes): at least
        ``nprobe``, and enough for ``want`` rows."""
        tree, m = CentroidTree(self.centroids), max(1, nprobe)
        while True:
            lists = tree.nearest(q, m)
            filled = np.cumsum(self.sizes[lists], axis=1) < want
            if m >= self.nlist or not filled[:, -1].any():
                return lists, np.minimum(np.maximum(nprobe, filled.sum(axis=1) + 1), self.nlist)
            m *= 2

    def places(self, q: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """How many lists are nearer to row i of ``q`` than list ``lists[i]``."""
        out = np.empty(len(q), dtype=np.int64)
        every = np.arange(self.nlist)[None, :]
        for i in range(len(q)):
            d = np.round(by_differences(q[i : i + 1], self.centroids, every)[0] if self.nlist * q.shape[1] < NUMBERS
                         else squared(q[i : i + 1], self.centroids)[0], RANK_DECIMALS)
            mine = d[lists[i]]
            out[i] = (d < mine).sum() + (d[: lists[i]] == mine).sum()
        return out

    def write(self, path: str) -> None:
        """Vectors partitioned by list; AQE splits a hot list over several files."""
        self.vectors.hint("rebalance", "list_id").write.mode("overwrite").partitionBy("list_id").parquet(path)

    @staticmethod
    def read(spark, path: str, centroids: np.ndarray) -> IvfIndex:
        return IvfIndex.over(spark.read.parquet(path), centroids)


def build_ivf(vectors: DataFrame, nlist: int | None = None, seed: int = 42, max_iter: int = 20, centroids: np.ndarray | None = None) -> IvfIndex:
    """K3: coarse lists of ``vectors [id, embedding]`` around given centroids, or around
    ``nlist`` that KMeans finds."""
    v = vectors.select("id", "embedding")
    if centroids is None:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        v = materialised(v)
        n = v.count()
        k = max(1, min(int(nlist), n))
        some = v
        if n > k * TRAIN_ROWS:  # the vectors of a part of all id hashes
            some = v.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * k * TRAIN_ROWS / n))
        feats = materialised(some.select(array_to_vector("embedding").alias("features")))
        model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="features").fit(feats)
        centroids = np.asarray(model.clusterCenters(), dtype=np.float64)
    return IvfIndex.over(materialised(assign_lists(v, centroids)), centroids)


def lists_for(n: int) -> int:
    """Lists that grow with the table: the square root of its rows."""
    return max(1, math.isqrt(n))


def fit_nprobe(index: IvfIndex, k: int = 10, recall: float = 0.9, sample: int = 400) -> IvfIndex:
    """The index with the least ``nprobe`` that reaches ``recall`` at ``k`` against the exact search,
    measured on the ``sample`` vectors of least id hash, each without itself among its neighbours."""
    queries = index.vectors.orderBy(F.xxhash64("id"), "id").limit(sample).select(F.col("id").alias("query_id"), "embedding")
    queries = materialised(queries)
    q = {r["query_id"]: r["embedding"] for r in queries.collect()}  # sample rows
    if not q:
        return index
    hits = knn(index.vectors.select("id", "embedding"), queries, k + 1).where("query_id <> id")
    hits = hits.join(index.vectors.select("id", "list_id"), "id").select("query_id", "rank", "list_id").collect()  # sample x k rows
    matrix, at = np.asarray(list(q.values()), dtype=np.float64), {x: i for i, x in enumerate(q)}
    enough = index.probes(matrix, k)[1]
    first, seen = [], dict.fromkeys(q, 0)
    for h in sorted(hits, key=lambda h: h["rank"]):
        if seen[h["query_id"]] < k:
            seen[h["query_id"]] += 1
            first.append((at[h["query_id"]], h["list_id"]))
    rows = np.array([i for i, _ in first], dtype=np.int64)
    place = index.places(matrix[rows], np.array([x for _, x in first], dtype=np.int64)) if first else []
    needed = [1 if p < enough[i] else int(p) + 1 for p, i in zip(place, rows, strict=True)]
    needed.sort()
    return replace(index, nprobe=needed[math.ceil(recall * len(needed)) - 1] if needed else 1)


def _scanned(index: IvfIndex, qids: list, q: np.ndarray, k: int, nprobe: int, ef_search: int, max_dist: float | None, by_probe: bool, kind) -> DataFrame:
    """The candidates of one block of queries, by a scan of the lists that it probes."""
    out, dim, spark = arrow_type(kind), index.centroids.shape[1], index.vectors.sparkSession
    lists, count = index.probes(q, max(k, ef_search), nprobe)
    enough = count if nprobe <= 1 and ef_search <= k else index.probes(q, k)[1]
    query = np.repeat(np.arange(len(q)), count)
    probe = np.arange(len(query)) - np.repeat(np.cumsum(count) - count, count)
    listed = lists[query, probe]
    by_list = {int(x): np.flatnonzero(listed == x) for x in np.unique(listed)}
    block = spark.sparkContext.broadcast((np.asarray(qids, dtype=object), q, query, probe, by_list, enough))

    def run(batches):
        names, q, query, probe, by_list, enough = block.value
        best = TopK(k, len(query) if by_probe else len(q), "l2", max_dist)
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix_of(b.column("embedding"), dim)
            ids = np.asarray(b.column("id").to_pylist(), dtype=object)
            lid = b.column("list_id").to_numpy()
            for one in np.unique(lid):
                pairs = by_list.get(int(one))
                if pairs is not None:
                    rows = np.flatnonzero(lid == one)
                    best.add(x[rows], ids[rows], q[query[pairs]], pairs if by_probe else query[pairs], int(one))
        yield _found(best, names, query, probe, enough, by_probe, out)

    table = index.vectors.filter(F.col("list_id").isin([int(x) for x in by_list])).select("id", "embedding", "list_id")
    return table.mapInArrow(run, _found_schema(kind))


def _found_schema(kind) -> T.StructType:
    more = [T.StructField(n, T.IntegerType()) for n in ("probe", "enough", "list_id")]
    return T.StructType([*partial_schema(kind).fields, *more])


def _found(best: TopK, names: np.ndarray, query: np.ndarray, probe: np.ndarray, enough: np.ndarray, by_probe: bool, out: pa.DataType) -> pa.RecordBatch:
    """Rows of ``_found_schema``; a state is a pair (query, probe) or else a query, of which no probe is known."""
    at, ids, dist, key = best.result()
    who = query[at] if by_probe else at
    probes = pa.array(probe[at].astype(np.int32)) if by_probe else pa.nulls(len(at), pa.int32())
    columns = [
        pa.array(names[who].tolist(), out), pa.array(ids.tolist(), pa.string()), pa.array(dist), pa.array(key),
        probes, pa.array(enough[who].astype(np.int32)), pa.array(best.tags()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["query_id", "id", "dist", "key", "probe", "enough", "list_id"])


@dataclass
class ListGroups:
    """Groups of near lists; arrays by group and by list."""

    of_list: np.ndarray
    lists: np.ndarray  # lists of each group
    rows: np.ndarray  # vectors of each group

    @staticmethod
    def of(index: IvfIndex, rows: int = 0) -> ListGroups:
        """The groups of the centroids' tree, put together while they have at most ``rows`` vectors."""
        members: list[np.ndarray] = []
        for m in CentroidTree(index.centroids).members:
            if members and index.sizes[members[-1]].sum() + index.sizes[m].sum() <= rows:
                members[-1] = np.concatenate([members[-1], m])
            else:
                members.append(m)
        of_list = np.empty(index.nlist, dtype=np.int32)
        for g, m in enumerate(members):
            of_list[m] = g
        return ListGroups(of_list, np.array([len(m) for m in members]), np.array([int(index.sizes[m].sum()) for m in members]))


def routed(index: IvfIndex, groups: ListGroups, queries: DataFrame, want: int, least: int, nprobe: int) -> DataFrame:
    """A row for each query and group that it probes: [query_id, embedding, enough, _g, lists, probes];
    it probes lists for ``want`` rows, of which ``least`` rows take the first ``enough``."""
    spark = queries.sparkSession
    shared = spark.sparkContext.broadcast((replace(index, vectors=None), groups.of_list))
    kind, vector = queries.schema["query_id"].dataType, queries.schema["embedding"].dataType
    many = T.ArrayType(T.IntegerType())
    fields = [("query_id", kind), ("embedding", vector), ("enough", T.IntegerType()), ("_g", T.IntegerType()), ("lists", many), ("probes", many)]

    def run(batches):
        light, of_list = shared.value
        dim = light.centroids.shape[1]
        for whole in batches:
            for a in range(0, whole.num_rows, ROUTE_ROWS):
                b = whole.slice(a, ROUTE_ROWS)
                q = matrix_of(b.column("embedding"), dim)
                lists, count = light.probes(q, want, nprobe)
                enough = count if nprobe <= 1 and want == least else light.probes(q, least)[1]
                query = np.repeat(np.arange(len(q)), count)
                probe = np.arange(len(query)) - np.repeat(np.cumsum(count) - count, count)
                listed = lists[query, probe]
                order = np.lexsort((probe, of_list[listed], query))
                query, probe, listed = query[order], probe[order], listed[order]
                group = of_list[listed]
                first = np.flatnonzero(np.r_[True, (query[1:] != query[:-1]) | (group[1:] != group[:-1])])
                ends = pa.array(np.r_[first, len(query)].astype(np.int32))
                arrays = [pa.ListArray.from_arrays(ends, pa.array(v.astype(np.int32))) for v in (listed, probe)]
                at = pa.array(query[first])
                columns = [b.column("query_id").take(at), b.column("embedding").take(at), pa.array(enough[query[first]].astype(np.int32)), pa.array(group[first])]
                yield pa.RecordBatch.from_arrays([*columns, *arrays], [n for n, _ in fields])

    return queries.select("query_id", "embedding").mapInArrow(run, T.StructType([T.StructField(n, t) for n, t in fields]))


def in_cells(index: IvfIndex, queries: DataFrame, k: int, nprobe: int, ef_search: int = 0, max_dist: float | None = None, by_probe: bool = False,
             most_rows: int = MOST_ROWS, rows: DataFrame | None = None, decoded=None, cell_rows: int | None = None) -> DataFrame:
    """The candidates of any number of queries, both sides distributed. ``rows`` [id, list_id, ..] stand
    for the vectors of ``index`` (its own, if not given), and ``decoded`` makes a matrix of a table of them."""
    spark, dim = index.vectors.sparkSession, index.centroids.shape[1]
    kind = queries.schema["query_id"].dataType
    cell_rows = cell_rows or rows_per_cell(dim)
    # Few large groups: a query is in few cells, and each gives k rows of it. Many blocks of queries instead.
    out, groups = arrow_type(kind), ListGroups.of(index, 0 if by_probe else cell_rows // 2)
    rows = index.vectors.select("id", "embedding", "list_id") if rows is None else rows
    decoded = decoded or (lambda t: matrix_of(t.column("embedding"), dim))
    corpus_blocks = np.maximum(1, -(-groups.rows // cell_rows))
    # A cell keeps k rows a state: a query, or a pair of a query and one of the group's lists.
    states = groups.lists if by_probe else np.ones(len(groups.lists), dtype=np.int64)
    n = queries.count()
    query_rows = np.maximum(1, np.minimum(block_rows(n, LEAST_QUERIES, rows_per_cell(dim)), most_rows // (k * states)))
    query_blocks_ = np.maximum(1, -(-n // query_rows))
    ints = lambda **columns: F.broadcast(spark.createDataFrame(pa.table({n: np.asarray(v, dtype=np.int32) for n, v in columns.items()})))
    numbers = np.arange(len(groups.rows))
    blocks = ints(_g=numbers, _cb=corpus_blocks, _qb=query_blocks_)
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    block = lambda name, n: F.pmod(F.xxhash64(name), F.col(n)).cast("int")
    key = ["_g", "_x", "_y"]
    mine = routed(index, groups, queries, max(k, ef_search), k, nprobe).join(blocks, "_g")
    mine = mine.withColumn("_y", block("query_id", "_qb")).withColumn("_x", upto("_cb")).select(*key, "query_id", "embedding", "enough", "lists", "probes")
    placed = ints(list_id=np.arange(index.nlist), _g=groups.of_list, _cb=corpus_blocks[groups.of_list], _qb=query_blocks_[groups.of_list])
    theirs = rows.join(placed, "list_id").withColumn("_x", block("id", "_cb")).withColumn("_y", upto("_qb")).select(*key, *rows.columns)

    def cell(q: pa.Table, c: pa.Table) -> pa.Table:
        names = np.asarray(q.column("query_id").to_pylist(), dtype=object)
        lists = q.column("lists").combine_chunks()
        query = np.repeat(np.arange(len(names)), lists.value_lengths().to_numpy())
        listed, probe = (v.flatten().to_numpy() for v in (lists, q.column("probes").combine_chunks()))
        best = TopK(k, len(query) if by_probe else len(names), "l2", max_dist)
        if q.num_rows and c.num_rows:
            y = matrix_of(q.column("embedding"), dim)
            ids, lid = np.asarray(c.column("id").to_pylist(), dtype=object), c.column("list_id").to_numpy()
            by_list, near = np.argsort(listed, kind="stable"), listed
            start, end = (np.searchsorted(near[by_list], np.unique(lid), side=s) for s in ("left", "right"))
            for one, a, b in zip(np.unique(lid), start, end, strict=True):
                if b > a:
                    pairs, some = by_list[a:b], np.flatnonzero(lid == one)
                    best.add(decoded(c.take(pa.array(some))), ids[some], y[query[pairs]], pairs if by_probe else query[pairs], int(one))
        enough = q.column("enough").to_numpy()
        return pa.Table.from_batches([_found(best, names, query, probe, enough, by_probe, out)])

    return mine.groupBy(*key).cogroup(theirs.groupBy(*key)).applyInArrow(cell, _found_schema(kind))


def _candidates(index: IvfIndex, queries: DataFrame, k: int, nprobe: int, ef_search: int, max_dist: float | None, by_probe: bool,
                block_bytes: int, most_rows: int) -> tuple[DataFrame, int]:
    """(candidates by scan, for one block of queries, or else in cells; queries of the block, or 0)."""
    kind = queries.schema["query_id"].dataType
    ship_package(index.vectors.sparkSession)
    # A task of the scan keeps k rows for each query, or for each of its probes.
    states = max(1, min(index.nlist, nprobe)) if by_probe else 1
    blocks = query_blocks(queries, min(block_bytes, max(1, most_rows // (k * states)) * index.centroids.shape[1] * 8))
    first = next(blocks, None)
    if first is None:
        return _union([], index.vectors, _found_schema(kind)), 0
    if next(blocks, None) is None:
        return _scanned(index, *first, k, nprobe, ef_search, max_dist, by_probe, kind), len(first[0])
    blocks.close()
    return in_cells(index, queries, k, nprobe, ef_search, max_dist, by_probe, most_rows), 0


def ann_candidates(index: IvfIndex, queries: DataFrame, k: int, nprobe: int = 1, ef_search: int = 0, max_dist: float | None = None,
                   block_bytes: int = BLOCK_BYTES, most_rows: int = MOST_ROWS) -> DataFrame:
    """[query_id, id, dist, key, probe, enough]: the k best rows of each list that a query
    probes (``probe`` 0 is its nearest list), partial by task; ``enough`` is the number of
    lists it needs for k rows. ``most_rows`` bounds what a task keeps, by smaller blocks."""
    found, _ = _candidates(index, queries, check_k(k), nprobe, ef_search, max_dist, True, block_bytes, most_rows)
    return found.drop("list_id")


def within_probes(candidates: DataFrame, k: int, nprobe: int, threshold: float = 0.0) -> DataFrame:
    """The search result at ``nprobe``, from the candidates of as many lists or more."""
    inside = candidates.filter(F.col("probe") < F.greatest(F.lit(nprobe), F.col("enough")))
    return final_rank(inside.select("query_id", "id", "dist", "key"), k, threshold)


def ann_search(index: IvfIndex, queries: DataFrame, k: int, threshold: float = 0.0, nprobe: int = 1, ef_search: int = 0) -> DataFrame:
    """K4: approximate top-k for queries [query_id, embedding] ->
    [query_id, id, dist, score, rank]. Probes ``nprobe`` lists, and more where they hold
    fewer than max(k, ef_search) rows."""
    k = check_k(k)
    found, few = _candidates(index, queries, k, nprobe, ef_search, max_dist_of(threshold), False, BLOCK_BYTES, MOST_ROWS)
    return final_rank(found.select("query_id", "id", "dist", "key"), k, threshold, salts=SALTS if 0 < few < SALTS else 1)
