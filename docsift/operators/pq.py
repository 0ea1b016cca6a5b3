"""K4 with product-quantised codes: lists are scanned by code, vectors are read for a shortlist.

Build: a bounded sample of the vectors (``TRAIN`` rows of least id hash) gives a book of ``CODES``
centroids for each of ``parts`` parts of a vector (Jegou et al., 2011). Every vector becomes a byte a part,
written by list beside the vectors.

Search: a code's distance to a query is the distance to the vector that it stands for, so a
sum of ``parts`` entries. Lists form groups of up to ``CELL_CODES`` codes; a query goes once to each group that it probes,
where a block of queries sees the group's codes pass (``nearest``) and each query gets its ``shortlist`` nearest of its lists, as one
row. The vectors of the shortlists pass the queries in the same way, and exact distances decide. ``fit`` measures how
long the shortlist must be for a recall against the exact search (T2)."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsift.operators.ann import LEAST_QUERIES, IvfIndex, ListGroups, fit_nprobe
from docsift.operators.knn import RANK_DECIMALS, TopK, arrow_type, block_rows, final_rank, knn, matrix_of, partial_schema
from docsift.operators.nearest import CHUNK, MOST_LENGTH, Nearest, block_count, by_pairs, most_queries, ranked, streamed
from docsift.operators.quantiser import squared
from docsift.schema import check_k
from docsift.session import materialised, scratch_path, ship_package

CODES, TRAIN, ROUNDS = 256, 16_384, 12
# Codes that a block of queries meets before its candidates are settled, queries that are routed at once, rows of a
# batch of shortlists, and entries of the shortlists of a block of queries.
CELL_CODES, ROUTE_ROWS, SHORT_ROWS, ENTRIES = 1 << 20, 2048, 1024, 1 << 22
# Rows whose parts are compared with a book at once.
TILE = 512


def nearest_codes_of(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The code of each row of one part, a tile of rows at a time."""
    return np.concatenate([np.argmin(squared(x[a : a + TILE], book), axis=1) for a in range(0, max(1, len(x)), TILE)])


def parts_of(x: np.ndarray, parts: int) -> np.ndarray:
    """[n, parts, width], filled with zeros."""
    width = -(-x.shape[1] // parts)
    return np.pad(x, ((0, 0), (0, parts * width - x.shape[1]))).reshape(len(x), parts, width)


def train_book(rows: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """[codes, width] centroids of one part, by Lloyd's rounds from evenly spaced rows."""
    n = len(rows)
    c = rows[np.linspace(0, n - 1, min(CODES, n)).astype(int)].copy()
    for _ in range(rounds):
        own = nearest_codes_of(rows, c)
        count = np.bincount(own, minlength=len(c))
        sums = np.stack([np.bincount(own, weights=v, minlength=len(c)) for v in rows.T], axis=1)
        c[count > 0] = sums[count > 0] / count[count > 0, None]
    return c


def train_books(x: np.ndarray, parts: int, rounds: int = ROUNDS, spark: SparkSession | None = None) -> np.ndarray:
    """[parts, codes, width] centroids of each part; with ``spark`` a part is a task."""
    rows = parts_of(x, parts)
    rows = [np.ascontiguousarray(rows[:, p]) for p in range(parts)]
    if spark is None:
        return np.stack([train_book(r, rounds) for r in rows])
    width = rows[0].shape[1]

    def run(batches):
        for b in batches:
            for p, v in zip(b.column("part").to_pylist(), b.column("rows").to_pylist(), strict=True):
                book = train_book(np.frombuffer(v).reshape(-1, width), rounds)
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([book.tobytes()], pa.binary())], ["part", "rows"])

    table = spark.createDataFrame([(p, bytearray(r.tobytes())) for p, r in enumerate(rows)], "part int, rows binary")
    found = table.repartitionById(parts, "part").mapInArrow(run, "part int, rows binary").collect()  # a book a part
    return np.stack([np.frombuffer(r["rows"]).reshape(-1, width) for r in sorted(found, key=lambda r: r["part"])])


def encode(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    """[n, parts] codes."""
    parts = len(books)
    x = parts_of(x, parts)
    return np.stack([nearest_codes_of(x[:, p], books[p]) for p in range(parts)], axis=1).astype(np.uint8)


def tables(q: np.ndarray, books: np.ndarray) -> np.ndarray:
    """[queries, parts, codes] squared distances of each part."""
    parts = len(books)
    q = parts_of(q, parts)
    return np.stack([squared(q[:, p], books[p]) for p in range(parts)], axis=1)


def decode(codes: np.ndarray, books: np.ndarray, dim: int) -> np.ndarray:
    """[n, dim] vectors that the codes stand for: a query's distance to one is the sum of its parts'."""
    return np.concatenate([books[p][codes[:, p]] for p in range(len(books))], axis=1)[:, :dim]


@dataclass
class PqIndex:
    ivf: IvfIndex
    books: np.ndarray
    codes: DataFrame  # [id, code, list_id]
    vectors: DataFrame  # [id, embedding, list_id], by list
    shortlist: int = 100

    @staticmethod
    def build(ivf: IvfIndex, parts: int | None = None, path: str | None = None) -> PqIndex:
        """Codes of the vectors of ``ivf``, written with them by list to ``path``."""
        spark = ivf.vectors.sparkSession
        ship_package(spark)
        path, dim = path or scratch_path(spark, "pq"), ivf.centroids.shape[1]
        parts = parts or max(1, dim // 4)
        sample = ivf.vectors.orderBy(F.xxhash64("id"), "id").limit(TRAIN).select("embedding").collect()  # TRAIN rows
        books = train_books(np.asarray([r["embedding"] for r in sample], dtype=np.float64).reshape(-1, dim), parts, spark=spark)

        def run(batches):
            for b in batches:
                if b.num_rows:
                    codes = [c.tobytes() for c in encode(matrix_of(b.column("embedding"), dim), books)]
                    yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(codes, pa.binary()), b.column("list_id")], ["id", "code", "list_id"])

        ivf.write(f"{path}/vectors")
        rows = ivf.vectors.select("id", "embedding", "list_id").mapInArrow(run, "id string, code binary, list_id int")
        rows.hint("rebalance", "list_id").write.partitionBy("list_id").parquet(f"{path}/codes")
        return PqIndex(
            ivf, books, spark.read.schema("id string, code binary, list_id int").parquet(f"{path}/codes"),
            spark.read.schema("id string, embedding array<float>, list_id int").parquet(f"{path}/vectors"),
        )

    def shortlists(self, queries: DataFrame, most: int) -> DataFrame:
        """[query_id, embedding, ids, near, lists]: a row for each query, with the ``most`` nearest by code in its lists."""
        ivf, books, spark = self.ivf, self.books, queries.sparkSession
        dim = ivf.centroids.shape[1]
        ship_package(spark)
        kind, vector = queries.schema["query_id"].dataType, queries.schema["embedding"].dataType
        arrow_type(kind)
        groups, n = ListGroups.of(ivf, CELL_CODES), queries.count()
        # The place of a list in its group, and the blocks of queries that meet a group.
        order = np.argsort(groups.of_list, kind="stable")
        start = np.concatenate([[0], np.cumsum(groups.lists)])
        place = np.empty(ivf.nlist, dtype=np.int64)
        place[order] = np.arange(ivf.nlist) - start[groups.of_list[order]]
        blocks = block_count(spark, n, min(block_rows(n, LEAST_QUERIES, CELL_CODES), most_queries(most)))
        shared = spark.sparkContext.broadcast((replace(ivf, vectors=None), groups.of_list, place, groups.lists))
        fields = [("name", T.StringType()), ("embedding", vector), ("_g", T.IntegerType()), ("probed", T.BinaryType())]

        def route(batches):
            light, of_list, place, lists_of = shared.value
            for whole in batches:
                for a in range(0, whole.num_rows, ROUTE_ROWS):
                    b = whole.slice(a, ROUTE_ROWS)
                    lists, count = light.probes(matrix_of(b.column("embedding"), dim), most, light.nprobe)
                    query = np.repeat(np.arange(b.num_rows), count)
                    listed = lists[np.arange(lists.shape[1])[None, :] < count[:, None]]
                    for g in np.unique(of_list[listed]):
                        mine = of_list[listed] == g
                        bits = np.zeros((b.num_rows, lists_of[g]), dtype=bool)
                        bits[query[mine], place[listed[mine]]] = True
                        some = np.flatnonzero(bits.any(axis=1))
                        packed = pa.array([v.tobytes() for v in np.packbits(bits[some], axis=1)], pa.binary())
                        columns = [b.column("name").take(pa.array(some)), b.column("embedding").take(pa.array(some)), pa.array(np.full(len(some), g, dtype=np.int32)), packed]
                        yield pa.RecordBatch.from_arrays(columns, [f for f, _ in fields])

        named = queries.select(F.col("query_id").cast("string").alias("name"), "embedding")
        mine = named.mapInArrow(route, T.StructType([T.StructField(f, t) for f, t in fields]))
        mine = mine.withColumn("_b", (F.col("_g") * blocks + F.pmod(F.xxhash64("name"), F.lit(blocks))).cast("int"))
        placed = F.broadcast(spark.createDataFrame(pa.table({"list_id": np.arange(ivf.nlist, dtype=np.int32), "_h": groups.of_list.astype(np.int32)})))
        theirs = self.codes.select("id", "code", "list_id").join(placed, "list_id")
        theirs = theirs.select(F.explode(F.sequence(F.col("_h") * blocks, F.col("_h") * blocks + blocks - 1)).alias("_b"), "id", "code", "list_id")
        products = all(np.abs(b).max(initial=0) ** 2 * dim < MOST_LENGTH for b in books)

        def begin(q: pa.Table):
            y, group = matrix_of(q.column("embedding"), dim), q.column("_g")[0].as_py()
            bits = np.frombuffer(b"".join(q.column("probed").to_pylist()), dtype=np.uint8).reshape(q.num_rows, -1)
            bits = np.ascontiguousarray(np.unpackbits(bits, axis=1, count=shared.value[3][group]).astype(bool).T)
            near = products and np.einsum("ij,ij->i", y, y).max() < MOST_LENGTH
            return q, y, bits, Nearest(y, most) if near else TopK(most, len(y))

        def chunk(state, c: pa.Table) -> None:
            _, y, bits, best = state
            codes = np.frombuffer(b"".join(c.column("code").to_pylist()), dtype=np.uint8).reshape(c.num_rows, -1)
            ids, lists = np.asarray(c.column("id").to_pylist(), dtype=object), c.column("list_id").to_numpy()
            if isinstance(best, Nearest):
                best.start(lambda rows: decode(codes[rows], books, dim), ids, lists)
            cut = [0, *(np.flatnonzero(lists[1:] != lists[:-1]) + 1), len(lists)]
            for a, z in zip(cut[:-1], cut[1:], strict=True):
                at = np.flatnonzero(bits[shared.value[2][lists[a]]])
                for i in range(a, z if len(at) else a, CHUNK):
                    x = decode(codes[i : min(z, i + CHUNK)], books, dim)
                    if isinstance(best, Nearest):
                        best.add(x, i, at)
                    else:
                        best.add(x, ids[i : min(z, i + CHUNK)], y[at], at, int(lists[a]))
            if isinstance(best, Nearest):
                best.settle()

        def end(state):
            q, _, _, best = state
            at, ids, dist, _ = best.result()
            ends = np.searchsorted(at, np.arange(q.num_rows + 1))
            tags = best.tags()
            for a in range(0, q.num_rows, SHORT_ROWS):
                z = min(q.num_rows, a + SHORT_ROWS)
                cut, part = pa.array((ends[a : z + 1] - ends[a]).astype(np.int32)), slice(ends[a], ends[z])
                lists = [pa.array(ids[part].tolist(), pa.string()), pa.array(dist[part]), pa.array(tags[part].astype(np.int32))]
                columns = [q.column(c).slice(a, z - a).combine_chunks() for c in ("name", "embedding")]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.ListArray.from_arrays(cut, v) for v in lists)], ["query_id", "embedding", "ids", "near", "lists"])

        many = [("ids", T.StringType()), ("near", T.DoubleType()), ("lists", T.IntegerType())]
        schema = T.StructType([T.StructField("query_id", T.StringType()), T.StructField("embedding", vector), *(T.StructField(f, T.ArrayType(t)) for f, t in many)])
        found = streamed(mine, theirs, blocks * len(groups.lists), ["list_id"], begin, chunk, end, schema, CELL_CODES)
        if len(groups.lists) > 1:  # the best of all groups
            one = found.select("query_id", "embedding", F.explode(F.arrays_zip("near", "ids", "lists")).alias("_e"))
            w = Window.partitionBy("query_id").orderBy(F.round("_e.near", RANK_DECIMALS), "_e.ids")
            one = one.withColumn("_p", F.row_number().over(w)).filter(F.col("_p") <= most)
            found = one.groupBy("query_id").agg(F.first("embedding").alias("embedding"), F.array_sort(F.collect_list(F.struct("_p", "_e"))).alias("_l"))
            found = found.select("query_id", "embedding", *(F.col(f"_l._e.{c}").alias(c) for c, _ in many))
        return found.withColumn("query_id", F.col("query_id").cast(kind))

    def nearest_codes(self, queries: DataFrame, most: int) -> DataFrame:
        """[query_id, id, list_id, near, place]: the ``most`` nearest by code of each query in its lists."""
        found = self.shortlists(queries, most).select("query_id", F.posexplode(F.arrays_zip("ids", "lists", "near")).alias("_p", "_e"))
        return found.select("query_id", F.col("_e.ids").alias("id"), F.col("_e.lists").alias("list_id"), F.col("_e.near").alias("near"), (F.col("_p") + 1).alias("place"))

    def search(self, queries: DataFrame, k: int, threshold: float = 0.0) -> DataFrame:
        """K4: approximate top-k for queries [query_id, embedding] -> [query_id, id, dist, score, rank];
        vectors are read from the folders of the shortlist, and distances computed for it alone."""
        k, spark, dim = check_k(k), queries.sparkSession, self.ivf.centroids.shape[1]
        kind, most = queries.schema["query_id"].dataType, max(k, self.shortlist)
        short = materialised(self.shortlists(queries, most).select(F.col("query_id").cast("string").alias("name"), "embedding", "ids", "lists"))

        def used(batches):
            seen = np.zeros(0, dtype=np.int32)
            for b in batches:
                seen = np.union1d(seen, b.column("lists").flatten().to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32))], ["list_id"])

        lists = [r["list_id"] for r in short.select("lists").mapInArrow(used, "list_id int").distinct().collect()]  # at most a row a list
        n = short.count()
        blocks = block_count(spark, n, min(block_rows(n, LEAST_QUERIES, ENTRIES), max(1, ENTRIES // most)))
        vector = "array<double>" if self.vectors.schema["embedding"].dataType != short.schema["embedding"].dataType else short.schema["embedding"].dataType
        mine = short.select(F.pmod(F.xxhash64("name"), F.lit(blocks)).cast("int").alias("_b"), "name", F.col("embedding").cast(vector).alias("embedding"), "ids", "lists")
        theirs = self.vectors.filter(F.col("list_id").isin(lists)).select(
            F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b"), F.col("id").alias("name"), F.col("embedding").cast(vector).alias("embedding"), "list_id"
        )

        def begin(q: pa.Table):
            lists = q.column("lists").combine_chunks()
            query = np.repeat(np.arange(q.num_rows), lists.value_lengths().to_numpy())
            order = np.argsort(lists.flatten().to_numpy(), kind="stable")  # of the entries, by list as the rows
            ids = q.column("ids").combine_chunks().flatten().take(pa.array(order))
            names = np.asarray(q.column("name").to_pylist(), dtype=object)
            return names, matrix_of(q.column("embedding"), dim), query[order], lists.flatten().to_numpy()[order], ids, []

        def chunk(state, c: pa.Table) -> None:
            _, y, query, lists, ids, found = state
            x, name, mine = matrix_of(c.column("embedding"), dim), c.column("name").combine_chunks(), c.column("list_id").to_numpy()
            a, z = np.searchsorted(lists, mine[0]), np.searchsorted(lists, mine[-1], side="right")
            code = name.dictionary_encode()
            row = np.argsort(code.indices.to_numpy(), kind="stable")  # an id may have several rows
            count = np.bincount(code.indices.to_numpy(), minlength=len(code.dictionary))
            at = pc.index_in(ids.slice(a, z - a), value_set=code.dictionary)
            entry = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
            which = at.drop_null().to_numpy()
            times = count[which]
            row = row[np.repeat((np.cumsum(count) - count)[which], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
            entry = np.repeat(entry, times) + a
            found.append((entry, by_pairs(x, y, row, query[entry])))

        def end(state):
            names, _, query, _, ids, found = state
            entry, dist = (np.concatenate(v) for v in zip(*found, strict=True)) if found else (np.zeros(0, dtype=np.int64), np.zeros(0))
            key = np.round(dist, RANK_DECIMALS)
            best, at, _ = ranked(query[entry], key, k, lambda some: np.asarray(ids.take(pa.array(entry[some])).to_pylist(), dtype=object))
            columns = [pa.array(names[at].tolist(), pa.string()), ids.take(pa.array(entry[best])), pa.array(dist[best]), pa.array(key[best])]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "id", "dist", "key"])

        found = streamed(mine, theirs, blocks, ["list_id"], begin, chunk, end, partial_schema(T.StringType()), CHUNK)
        return final_rank(found.withColumn("query_id", F.col("query_id").cast(kind)), k, threshold)

    def fit(self, k: int = 10, recall: float = 0.92, sample: int = 400) -> PqIndex:
        """The index with enough probes, and the least shortlist, for ``recall`` at ``k``, measured on the
        ``sample`` vectors of least id hash, each without itself among its neighbours."""
        ivf = fit_nprobe(self.ivf, k, (1 + recall) / 2, sample)
        index = replace(self, ivf=ivf)
        queries = ivf.vectors.orderBy(F.xxhash64("id"), "id").limit(sample).select(F.col("id").alias("query_id"), "embedding")
        queries = materialised(queries)
        exact = knn(ivf.vectors.select("id", "embedding"), queries, k + 1).where("query_id <> id")
        w = Window.partitionBy("query_id").orderBy("rank")
        exact = materialised(exact.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("query_id", "id"))
        most, total = 8 * k, exact.count()
        while True:
            places = exact.join(index.nearest_codes(queries, most), ["query_id", "id"]).select("place").collect()  # sample x k
            places = sorted(p["place"] for p in places)
            need = math.ceil(recall * total)
            if len(places) >= need or most >= int(self.ivf.sizes.sum()):
                break
            most *= 2
        return replace(index, shortlist=max(k + 1, places[min(need, len(places)) - 1]) if places else k)
