"""Exact k-nearest neighbours by squared L2 distance.

The query side is cut into blocks of at most ``BLOCK_BYTES``. A block goes to every task,
and the corpus is scanned once against it with ``mapInArrow``, never shuffled. Distances
are computed tile by tile (rows x queries); each task carries the current k best rows of
every query, and a tile only adds rows that beat the k-th. So a task holds ``k`` rows a
query and one tile, whatever the sizes, and the only shuffle is ``tasks x queries x k``
small rows, ranked by ``row_number() <= k`` (limited before the shuffle). For few queries
that ranking has two steps, the first by query and a hash of the row, so no task ranks
all candidates of a query.

Queries beyond one block never pass the driver: ``knn_bounded`` keeps both sides distributed.
Pass one gives each query an upper bound of its k-th distance from a bounded sample of the
corpus. Both sides then lie in lists around pivots (``balls``), and a list of queries meets only
corpus lists that are near enough for the largest of its bounds (triangle inequality). Lists of queries that
meet the same lists are cut into blocks together; a task sees the rows of a block's lists pass and keeps
its k best (``nearest``), so a query gives k rows to the ranking, whatever the size of the corpus.

``knn_grid`` is the same for two distributed sides with a common key (J7): both are cut
into bounded blocks per key, and each pair of blocks meets once.

Ranking is by the distance rounded to 1e-9, then by id, so that distances within float
noise rank alike in every engine. Distances of kept rows are recomputed from differences.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsift.operators.nearest import CHUNK, MOST_LENGTH, Nearest, block_count, most_queries, streamed
from docsift.operators.nearest import places as _places
from docsift.schema import check_k
from docsift.session import ship_package

RANK_DECIMALS = 9
TILE_ROWS, TILE_QUERIES = 2048, 1024
BLOCK_BYTES = 16 << 20
SALTS = 64
# Blocks that a table has when it meets another one, until a block is as large as a cell may be.
BLOCKS = 16
# Numbers in a temporary array of differences.
NUMBERS = 1 << 21
DEFAULT_MAX_BLOCK_ROWS = 50_000


def arrow_type(dt: T.DataType) -> pa.DataType:
    types = {T.StringType: pa.string(), T.LongType: pa.int64(), T.IntegerType: pa.int32()}
    if type(dt) not in types:
        raise TypeError(f"query_id must be string, int or long, not {dt}")
    return types[type(dt)]


def partial_schema(qid_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", qid_type, False),
            T.StructField("id", T.StringType(), False),
            T.StructField("dist", T.DoubleType(), False),
            T.StructField("key", T.DoubleType(), False),
        ]
    )


def unit_rows(a: np.ndarray) -> np.ndarray:
    """Rows at unit length; zero rows stay zero."""
    return a / np.maximum(np.sqrt(np.einsum("ij,ij->i", a, a)), 1e-12)[:, None]


class TopK:
    """The k best corpus rows of each of ``n`` queries, by (key, id).

    ``metric``: l2 (squared distance), cosine (1 - similarity; a zero vector has similarity
    0 with everything; rows must be given at unit length) or dot (minus the product).
    ``most``, if given, is a bound of each query's k-th distance that is known before. A row may
    have a number (``tag``), which is kept with it."""

    def __init__(self, k: int, n: int, metric: str = "l2", max_dist: float | None = None, most: np.ndarray | None = None):
        self.k, self.metric, self.max_dist = k, metric, max_dist
        self.most = most
        self.key = np.full((n, k), np.inf)
        self.dist = np.full((n, k), np.inf)
        self.id = np.full((n, k), None, dtype=object)
        self.tag = np.zeros((n, k), dtype=np.int32)

    def size(self) -> int:
        return int(np.isfinite(self.key).sum())

    def add(self, x: np.ndarray, ids: np.ndarray, q: np.ndarray, at: np.ndarray, tag: int = 0) -> None:
        """Compare rows ``x`` named ``ids`` with queries ``q``, kept at rows ``at``."""
        if not len(x) or not len(q):
            return
        ends = [self._ends(q[b : b + TILE_QUERIES], 1.0) for b in range(0, len(q), TILE_QUERIES)]
        for a in range(0, len(x), TILE_ROWS):
            rows = x[a : a + TILE_ROWS]
            mine = self._ends(rows, None)
            for i, b in enumerate(range(0, len(q), TILE_QUERIES)):
                self._tile(rows, mine, ids[a : a + TILE_ROWS], q[b : b + TILE_QUERIES], ends[i], at[b : b + TILE_QUERIES], tag)

    def _ends(self, v: np.ndarray, last: float | None) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        """(vectors with one more number, the same in single precision or None, squared lengths): the
        products of rows and queries are then what falls with the distance (l2: x.q - x.x / 2)."""
        length = np.einsum("ij,ij->i", v, v)
        if self.metric == "l2":
            v = np.concatenate([v, (-0.5 * length if last is None else np.full(len(v), last))[:, None]], axis=1)
        small = v.astype(np.float32) if length.max(initial=0) < 1e15 else None
        return v, small, length

    def _near(self, x, q, at, single: bool) -> np.ndarray | None:
        """Places (row * queries + query) that may be among a query's k best; None if single
        precision leaves too many of them."""
        (xv, xs, xx), (qv, qs, qq) = x, q
        if single:
            got, unit = xs @ qs.T, 2.0**-22
        else:
            got, unit = xv @ qv.T, 2.0**-51
        top, far = xx.max(initial=0), qq.max(initial=0)
        size = math.sqrt(top * far) + (top if self.metric == "l2" else 0.0)
        slack = 1e-9 + unit * (xv.shape[1] + 8) * size + 1e-13 * (top + far)
        down = lambda v: np.nextafter((v - 2 * slack).astype(got.dtype), -np.inf, dtype=got.dtype)
        limit = self.key[at, self.k - 1]
        if self.most is not None:
            limit = np.minimum(limit, self.most[at])
        if self.max_dist is not None:
            limit = np.minimum(limit, self.max_dist)
        if self.metric == "l2":
            least = (qq - limit) / 2
        else:
            least = (1.0 if self.metric == "cosine" else 0.0) - limit
        most = 8 * self.k * len(qq) + len(xx)
        inside = got >= down(least)[None, :]
        if len(xx) > self.k and np.count_nonzero(inside) > most // 2:
            wide = np.flatnonzero(np.count_nonzero(inside, axis=0) > 2 * self.k)
            best = np.partition(got[:, wide], len(xx) - self.k, axis=0)[len(xx) - self.k]
            least = least.copy()
            least[wide] = np.maximum(least[wide], best.astype(np.float64) - 2 * slack)
            inside[:, wide] = got[:, wide] >= down(least[wide])[None, :]
            if single and np.count_nonzero(inside) > most:
                return None
        return np.flatnonzero(inside)

    def _exact(self, x, q, row, col) -> np.ndarray:
        out = np.empty(len(row))
        step = max(1, NUMBERS // max(1, x.shape[1]))
        for a in range(0, len(row), step):
            u, v = x[row[a : a + step]], q[col[a : a + step]]
            out[a : a + step] = ((u - v) ** 2).sum(axis=1) if self.metric == "l2" else (u * v).sum(axis=1)
        return out if self.metric == "l2" else (1.0 if self.metric == "cosine" else 0.0) - out

    def _tile(self, x, mine, ids, q, theirs, at, tag) -> None:
        near = None
        if mine[1] is not None and theirs[1] is not None:
            near = self._near(mine, theirs, at, True)
        if near is None:
            near = self._near(mine, theirs, at, False)
        row, col = np.divmod(near, len(q))
        exact = self._exact(x, q, row, col)
        if self.max_dist is not None:
            inside = exact <= self.max_dist
            row, col, exact = row[inside], col[inside], exact[inside]
        if not len(row):
            return
        if len(row) > 4 * self.k * len(q):  # many equal distances: the least names of the tile's rows first
            rank = np.unique(ids.astype(str), return_inverse=True)[1]
            order = np.lexsort((rank[row], np.round(exact, RANK_DECIMALS), col))
            order = order[_places(col[order]) < self.k]
            row, col, exact = row[order], col[order], exact[order]
        touched = np.unique(col)
        where, place = np.nonzero(np.isfinite(self.key[at[touched]]))
        held = at[touched[where]]
        query = np.concatenate([touched[where], col])
        dist = np.concatenate([self.dist[held, place], exact])
        names = np.concatenate([self.id[held, place], ids[row]])
        tags = np.concatenate([self.tag[held, place], np.full(len(row), tag, dtype=np.int32)])
        key = np.round(dist, RANK_DECIMALS)
        order = np.lexsort((key, query))
        same = (query[order][1:] == query[order][:-1]) & (key[order][1:] == key[order][:-1])
        if same.any():  # names decide between equal keys alone
            tied = order[np.append(same, False) | np.append(False, same)]
            rank = np.zeros(len(query), dtype=np.int64)
            rank[tied] = np.unique(names[tied].astype(str), return_inverse=True)[1]
            order = np.lexsort((rank, key, query))
        query = query[order]
        rank = _places(query)
        best = rank < self.k
        order, query, rank = order[best], query[best], rank[best]
        self.key[at[touched]] = np.inf
        self.key[at[query], rank] = key[order]
        self.dist[at[query], rank] = dist[order]
        self.id[at[query], rank] = names[order]
        self.tag[at[query], rank] = tags[order]

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, dist, key) of all kept rows."""
        q, r = np.nonzero(np.isfinite(self.key))
        return q, self.id[q, r], self.dist[q, r], self.key[q, r]

    def tags(self) -> np.ndarray:
        """The numbers of the rows of ``result``."""
        return self.tag[np.isfinite(self.key)]


def matrix_of(col: pa.Array, dim: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False)
    if col.null_count or len(flat) != len(col) * dim:
        raise ValueError(f"embeddings must be non-null arrays of length {dim}")
    return flat.astype(np.float64, copy=False).reshape(len(col), dim)


def final_rank(partial: DataFrame, k: int, threshold: float = 0.0, metric: str = "l2", salts: int = 1) -> DataFrame:
    """[query_id, id, dist, score, rank] from candidates [query_id, id, dist, key]."""
    if salts > 1:
        salted = partial.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
        first = Window.partitionBy("query_id", "_salt").orderBy("key", "id")
        partial = salted.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= k).drop("_r", "_salt")
    w = Window.partitionBy("query_id").orderBy("key", "id")
    ranked = partial.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    score = F.lit(1.0) - F.col("dist") if metric == "cosine" else F.lit(1.0) / (F.lit(1.0) + F.col("dist"))
    ranked = ranked.withColumn("score", score)
    if threshold and threshold > 0:
        # inclusive, applied to the k hits (it can only shrink them).
        ranked = ranked.filter(F.col("score") >= F.lit(float(threshold)))
    return ranked.select("query_id", "id", "dist", "score", "rank")


def max_dist_of(threshold: float, metric: str = "l2") -> float | None:
    # score >= t  <=>  dist <= 1/t - 1 (cosine: dist <= 1 - t); a small slack keeps the cut
    # exact, the final filter on score decides.
    if not threshold or threshold <= 0:
        return None
    return (1.0 - float(threshold) if metric == "cosine" else 1.0 / float(threshold) - 1.0) + 1e-9


def query_blocks(queries: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[list, np.ndarray]]:
    """(ids, matrix) of the queries [query_id, embedding], a bounded block at a time."""
    ids, rows = [], []
    for r in queries.select("query_id", "embedding").toLocalIterator():
        if rows and (len(rows) + 1) * len(rows[0]) * 8 > block_bytes:
            yield ids, np.asarray(rows, dtype=np.float64)
            ids, rows = [], []
        ids.append(r["query_id"])
        rows.append(r["embedding"])
    if rows:
        yield ids, np.asarray(rows, dtype=np.float64)


def _scan(corpus: DataFrame, qids: list, q: np.ndarray, k: int, max_dist: float | None, qid_type, metric: str) -> DataFrame:
    """Candidates of one query block: at most k rows a query and task."""
    spark = corpus.sparkSession
    ship_package(spark)
    q = np.ascontiguousarray(unit_rows(q) if metric == "cosine" else q, dtype=np.float64)
    block = spark.sparkContext.broadcast((np.asarray(qids, dtype=object), q))
    out = arrow_type(qid_type)

    def run(batches):
        names, queries = block.value
        best = TopK(k, len(queries), metric, max_dist)
        for b in batches:
            if b.num_rows:
                x = matrix_of(b.column("embedding"), queries.shape[1])
                x = unit_rows(x) if metric == "cosine" else x
                best.add(x, np.asarray(b.column("id").to_pylist(), dtype=object), queries, np.arange(len(queries)))
        yield partial_batch(names, best, out)

    return corpus.select("id", "embedding").mapInArrow(run, partial_schema(qid_type))


def partial_batch(names: np.ndarray, best: TopK, kind: pa.DataType) -> pa.RecordBatch:
    q, ids, dist, key = best.result()
    columns = [pa.array(names[q].tolist(), kind), pa.array(ids.tolist(), pa.string()), pa.array(dist), pa.array(key)]
    return pa.RecordBatch.from_arrays(columns, ["query_id", "id", "dist", "key"])


def block_rows(n: int, least: int, most: int) -> int:
    """Rows of a block of a table of ``n`` rows that meets another one block by block: ``least``, and
    more, up to ``most``, as the table grows, so that it has about ``BLOCKS`` blocks and a row is copied
    to as many. With a fixed number of rows the copies would grow with the square of the table."""
    return max(least, min(most, -(-n // BLOCKS)))


def _union(parts: list[DataFrame], corpus: DataFrame, schema: T.StructType) -> DataFrame:
    if not parts:
        return corpus.sparkSession.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def knn(corpus: DataFrame, queries: DataFrame, k: int, threshold: float = 0.0, metric: str = "l2",
        block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """T2 for many queries at once.

    ``corpus`` [id string, embedding array<float>], ``queries`` [query_id, embedding]. Returns
    [query_id, id, dist, score, rank], rank 1..k per query by ascending squared L2 distance,
    ties by id; ``score >= threshold`` kept (F5). k is capped by the corpus size."""
    k = check_k(k)
    kind = queries.schema["query_id"].dataType
    far = max_dist_of(threshold, metric)
    blocks = query_blocks(queries, block_bytes)
    first = next(blocks, None)
    if first is not None and next(blocks, None) is not None:  # more than one block
        blocks.close()
        return knn_bounded(corpus, queries, k, threshold, metric)
    found = [_scan(corpus, *first, k, far, kind, metric)] if first else []
    salts = SALTS if first and len(first[0]) < SALTS else 1
    return final_rank(_union(found, corpus, partial_schema(kind)), k, threshold, metric, salts)


def _upper_bounds(queries: DataFrame, sample: np.ndarray, k: int, metric: str) -> DataFrame:
    """``queries`` with ``_most``: their k-th distance within the sample (infinite if it has fewer rows)."""
    ship_package(queries.sparkSession)
    schema = T.StructType([*queries.schema.fields, T.StructField("_most", T.DoubleType())])
    names = np.arange(len(sample)).astype(str).astype(object)
    products = metric == "l2" and np.einsum("ij,ij->i", sample, sample).max(initial=0) < MOST_LENGTH

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            most = np.full(b.num_rows, np.inf)
            if len(sample) >= k:
                q = matrix_of(b.column("embedding"), sample.shape[1])
                for a in range(0, len(q), most_queries(k)):
                    y = q[a : a + most_queries(k)]
                    if products and np.einsum("ij,ij->i", y, y).max() < MOST_LENGTH:
                        best = Nearest(y, k)
                        best.start(lambda rows: sample[rows], names)
                        best.add(sample)
                        best.settle()
                    else:
                        best = TopK(k, len(y), metric)
                        best.add(sample, names, unit_rows(y) if metric == "cosine" else y, np.arange(len(y)))
                    most[a : a + most_queries(k)] = best.key[:, k - 1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(most)], schema.names)

    return queries.mapInArrow(run, schema)


def knn_bounded(corpus: DataFrame, queries: DataFrame, k: int, threshold: float = 0.0, metric: str = "l2", sample: int = 2048,
                lists: int | None = None, max_block_rows: int | None = None) -> DataFrame:
    """``knn`` with both sides distributed and list pairs pruned by bound; no query vector passes the
    driver but pivots. ``sample`` rows of least id hash give the bounds, ``lists`` rows the pivots. Blocks
    have ``max_block_rows`` rows while the tables are small, see ``block_rows``."""
    from docsift.operators.balls import MAX_LISTS, Balls, assigned, gaps, pivots, rows_per_cell
    from docsift.session import materialised

    k = check_k(k)
    kind = queries.schema["query_id"].dataType
    arrow_type(kind)
    unit = metric == "cosine"
    corpus, queries = corpus.select("id", "embedding"), queries.select("query_id", "embedding")
    known = corpus.orderBy(F.xxhash64("id"), "id").limit(max(sample, k)).collect()
    if not known:
        return final_rank(corpus.sparkSession.createDataFrame([], partial_schema(kind)), k, threshold, metric)
    known = np.asarray([r["embedding"] for r in known], dtype=np.float64)
    known = unit_rows(known) if unit else known
    dim = known.shape[1]
    cell_rows = rows_per_cell(dim)
    if lists is None:
        lists = min(MAX_LISTS, 2 * max(1, corpus.count() // (max_block_rows or cell_rows)))
    centres = pivots(corpus, "id", lists)
    centres = np.unique(unit_rows(centres), axis=0) if unit else centres
    right = materialised(assigned(corpus, centres, unit))
    left = materialised(assigned(_upper_bounds(queries, known, k, metric), centres, unit))
    rb, lb = Balls.of(right, len(centres)), Balls.of(left, len(centres), "_most")
    near = gaps(centres, lb, rb) ** 2
    if unit:
        # 1 - cos = distance^2 / 2 for unit vectors; a zero vector is at 1 from all, so its list isn't pruned.
        near = near / 2
        near[:, rb.short == 0] = 0.0
        near[lb.short == 0, :] = 0.0
    far = max_dist_of(threshold, metric)
    most = lb.extra + 1e-8 if far is None else np.minimum(lb.extra + 1e-8, far + 1e-8)
    keep = (lb.rows[:, None] > 0) & (rb.rows[None, :] > 0) & (near <= most[:, None])
    out, products = pa.string(), not unit and max(lb.long.max(initial=0), rb.long.max(initial=0)) ** 2 < MOST_LENGTH

    def begin(q: pa.Table):
        y = matrix_of(q.column("embedding"), dim)
        bound = q.column("_most").to_numpy() + 1e-8
        names = np.asarray(q.column("name").to_pylist(), dtype=object)
        if products:
            return names, y, Nearest(y, k, bound if far is None else np.minimum(bound, far))
        best = TopK(k, len(y), metric, far, bound)
        return names, unit_rows(y) if unit else y, best

    def chunk(state, c: pa.Table) -> None:
        _, y, best = state
        x, ids = matrix_of(c.column("embedding"), dim), np.asarray(c.column("name").to_pylist(), dtype=object)
        if products:
            best.start(lambda rows: x[rows], ids)
            best.add(x)
            best.settle()
        else:
            best.add(unit_rows(x) if unit else x, ids, y, np.arange(len(y)))

    def end(state):
        yield partial_batch(state[0], state[2], out)

    # Lists of queries that meet the same lists share blocks, and so do lists that the same blocks meet.
    full = np.flatnonzero(keep.any(axis=1))
    if not len(full):
        return final_rank(corpus.sparkSession.createDataFrame([], partial_schema(kind)), k, threshold, metric)
    met, own = np.unique(keep[full], axis=0, return_inverse=True)
    own = own.reshape(-1)
    # A block holds k rows a query as well, so it has fewer queries for a large k.
    size = block_rows(int(lb.rows.sum()), max_block_rows or 1, cell_rows)
    size = max(1, min(size, most_queries(k) if products else (1 << 20) // k))
    blocks = np.array([block_count(corpus.sparkSession, int(lb.rows[full[own == g]].sum()), size) for g in range(len(met))])
    first = np.cumsum(blocks) - blocks
    table = lambda **columns: F.broadcast(corpus.sparkSession.createDataFrame(pa.table({n: np.asarray(v, dtype=np.int32) for n, v in columns.items()})))
    to, which = np.nonzero(met)
    of_query = table(_list=full, _first=first[own], _n=blocks[own])
    of_row = table(_list=which, _first=first[to], _n=blocks[to])
    vector = "array<double>" if left.schema["embedding"].dataType != right.schema["embedding"].dataType else left.schema["embedding"].dataType
    mine = left.join(of_query, "_list").select(
        (F.col("_first") + F.pmod(F.xxhash64("query_id"), F.col("_n"))).cast("int").alias("_b"), F.col("query_id").cast("string").alias("name"),
        F.col("embedding").cast(vector).alias("embedding"), "_most",
    )
    theirs = right.join(of_row, "_list").select(
        F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_n") - 1)).alias("_b"), F.col("id").alias("name"), F.col("embedding").cast(vector).alias("embedding")
    )
    found = streamed(mine, theirs, int(blocks.sum()), [], begin, chunk, end, partial_schema(T.StringType()), CHUNK)
    return final_rank(found.withColumn("query_id", F.col("query_id").cast(kind)), k, threshold, metric)


def knn_vector(corpus: DataFrame, vector, k: int, threshold: float = 0.0, query_id: str = "q") -> DataFrame:
    """Q2 / T2 for one query vector given on the driver."""
    k = check_k(k)
    q = np.asarray(vector, dtype=np.float64).reshape(1, -1)
    found = _scan(corpus, [query_id], q, k, max_dist_of(threshold), T.StringType(), "l2")
    return final_rank(found, k, threshold, salts=SALTS)


def knn_grid(corpus: DataFrame, queries: DataFrame, k: int, threshold: float = 0.0, max_block_rows: int = DEFAULT_MAX_BLOCK_ROWS,
             max_query_rows: int = 4096, metric: str = "l2") -> DataFrame:
    """Top-k where both sides stay distributed.

    ``corpus`` [id, embedding, _key?] and ``queries`` [query_id, embedding, _key?]; with
    ``_key`` a query only meets corpus rows of the same key. Blocks come from the counts per
    key, so a hot key is split into many cells; they have the given rows while a key has few,
    see ``block_rows``."""
    k = check_k(k)
    ship_package(corpus.sparkSession)
    corpus = corpus if "_key" in corpus.columns else corpus.withColumn("_key", F.lit(0))
    queries = queries if "_key" in queries.columns else queries.withColumn("_key", F.lit(0))
    # As ``block_rows``: a query block holds k rows a query as well.
    grown = lambda n, least, most: F.greatest(F.lit(least), F.least(F.lit(max(least, most)), F.ceil(F.col(n) / BLOCKS)))
    blocks = lambda n, least, most: F.greatest(F.lit(1), F.ceil(F.col(n) / grown(n, least, most))).cast("int")
    plan = corpus.groupBy("_key").agg(F.count("*").alias("nc")).join(queries.groupBy("_key").agg(F.count("*").alias("nq")), "_key")
    plan = plan.select("_key", blocks("nc", max_block_rows, DEFAULT_MAX_BLOCK_ROWS).alias("cs"),
                       blocks("nq", max_query_rows, min(DEFAULT_MAX_BLOCK_ROWS, (1 << 20) // k)).alias("qs"))
    c = corpus.join(plan, "_key").select(
        "_key", F.pmod(F.xxhash64("id"), F.col("cs")).cast("int").alias("cb"), F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("qb"), "id", "embedding"
    )
    q = queries.join(plan, "_key").select(
        "_key", F.explode(F.sequence(F.lit(0), F.col("cs") - 1)).alias("cb"), F.pmod(F.xxhash64("query_id"), F.col("qs")).cast("int").alias("qb"),
        "query_id", F.col("embedding").alias("q_embedding"),
    )
    far = max_dist_of(threshold, metric)

    def cell(qpdf: pd.DataFrame, cpdf: pd.DataFrame) -> pd.DataFrame:
        best = TopK(k, len(qpdf), metric, far)
        if len(qpdf) and len(cpdf):
            x = np.stack(cpdf["embedding"].to_numpy()).astype(np.float64)
            y = np.stack(qpdf["q_embedding"].to_numpy()).astype(np.float64)
            if metric == "cosine":
                x, y = unit_rows(x), unit_rows(y)
            best.add(x, cpdf["id"].to_numpy(dtype=object), y, np.arange(len(y)))
        at, ids, dist, key = best.result()
        return pd.DataFrame({"query_id": qpdf["query_id"].to_numpy()[at], "id": ids, "dist": dist, "key": key})

    cells = ["_key", "cb", "qb"]
    kind = queries.schema["query_id"].dataType
    partial = q.groupBy(*cells).cogroup(c.groupBy(*cells)).applyInPandas(cell, partial_schema(kind))
    return final_rank(partial, k, threshold, metric)


def knn_sql(corpus: DataFrame, vector, k: int, threshold: float = 0.0) -> DataFrame:
    """One query with JVM higher-order functions only (cross-check path)."""
    from docsift.functions.vectors import squared_l2

    k = check_k(k)
    q = F.array(*[F.lit(float(x)) for x in vector])
    d = corpus.select(F.lit("q").alias("query_id"), "id", squared_l2(F.col("embedding"), q).alias("dist"))
    return final_rank(d.withColumn("key", F.round("dist", RANK_DECIMALS)), k, threshold, salts=SALTS)


def best_match(corpus: DataFrame, queries: DataFrame, **kw) -> DataFrame:
    """A5 / Q4: the best corpus row per query by cosine similarity (argmax; the smallest id
    wins a tie; a zero vector has similarity 0). Returns [query_id, id, similarity]."""
    top = knn(corpus, queries, 1, metric="cosine", **kw)
    return top.select("query_id", "id", F.col("score").alias("similarity"))
