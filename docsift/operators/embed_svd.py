"""V6: an embedder trained on the corpus: signed hashing, document frequencies and a
randomised singular value decomposition (Halko et al., 2011).

A text is a sparse row over ``buckets``: each different token adds sign * (1 + ln count) * idf at its
bucket; bucket and sign are bits of a 64-bit hash, idf follows from the documents that hit the
bucket. Rows have length one. With X the rows of all documents, a task adds up X'(X R) for a
random R, Spark adds the tasks' rows by bucket, and the driver makes the result orthonormal;
``rounds`` more products sharpen it. The last pass gives the small matrix whose eigenvectors turn it
into the leading right singular vectors V with eigenvalues e of X'X, what most documents share.

The embedding is a random projection to ``dim`` numbers after these directions have been shrunk by
sqrt(m / (e + m)), m being the mean eigenvalue of all buckets: rare words keep their weight, and
common ones lose theirs as far as the corpus has them in common. Both steps are one matrix. The
driver holds buckets x components numbers, whatever the corpus; every document takes part."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsift.operators.embed import hashing_tokens
from docsift.schema import NORM_EPS, VECTOR_TYPE
from docsift.session import materialised, ship_package

COMPONENTS = 80
ENTRIES = 1 << 15  # entries of X that are multiplied at once


def entries(hashes: pa.Array, buckets: int, idf: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of the unit rows, sorted by row, from token hashes; without ``idf``
    (row, bucket, 1) of the buckets that are hit."""
    lists = hashes.cast(pa.large_list(pa.int64()))
    h = lists.flatten().to_numpy().view(np.uint64)
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.r_[first, len(h)])
    row, h = row[first], h[first]
    bucket = (h % np.uint64(buckets)).astype(np.int64)
    value = np.ones(len(h)) if idf is None else np.where(h >> np.uint64(63), -1.0, 1.0) * (1 + np.log(count)) * idf[bucket]
    key, at = np.unique(row * buckets + bucket, return_inverse=True)
    value = np.bincount(at, weights=value, minlength=len(key)) if len(key) else value
    row, bucket = key // buckets, key % buckets
    if idf is None:
        return row, bucket, np.ones(len(key))
    length = np.sqrt(np.bincount(row, weights=value * value, minlength=len(lists)))
    return row, bucket, value / np.maximum(length[row], 1e-300)


def product(row: np.ndarray, bucket: np.ndarray, value: np.ndarray, n: int, r: np.ndarray) -> np.ndarray:
    """X r for the entries of n rows."""
    out = np.zeros((n, r.shape[1]))
    for a in range(0, len(row), ENTRIES):
        s = slice(a, a + ENTRIES)
        first = np.flatnonzero(np.r_[True, row[s][1:] != row[s][:-1]])
        out[row[s][first]] += np.add.reduceat(value[s, None] * r[bucket[s]], first)
    return out


def _summed(spark, df: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The sum of tasks' matrices, given as rows (i, numbers)."""

    def add(table: pa.Table) -> pa.Table:
        rows = np.frombuffer(b"".join(table.column("numbers").to_pylist()), dtype=np.float64).reshape(-1, shape[1])
        return pa.table({"i": table.column("i")[:1], "numbers": pa.array([rows.sum(axis=0).tobytes()], pa.binary())})

    out = np.zeros(shape)
    for r in df.groupBy("i").applyInArrow(add, "i int, numbers binary").collect():  # a row a bucket
        out[r["i"]] = np.frombuffer(r["numbers"], dtype=np.float64)
    return out


def _rows(m: np.ndarray) -> pa.RecordBatch:
    some = np.flatnonzero(m.any(axis=1))
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([r.tobytes() for r in m[some]], pa.binary())], ["i", "numbers"])


@dataclass
class SvdEmbedder:
    idf: np.ndarray  # of each bucket
    projection: np.ndarray  # [buckets, dim]
    max_tokens: int | None = None
    name: str = "svd"

    @property
    def dim(self) -> int:
        return self.projection.shape[1]

    @property
    def model(self) -> str:
        import zlib

        print_ = zlib.crc32(np.round(self.projection, 4).astype(np.float32).tobytes())
        return f"svd-{self.dim}-{print_:08x}"

    @staticmethod
    def _hashes(text: str, max_tokens: int | None):
        return F.transform(F.coalesce(hashing_tokens(text, max_tokens), F.array().cast("array<string>")), lambda t: F.xxhash64(t)).alias("_h")

    @staticmethod
    def fit(docs: DataFrame, dim: int = 64, buckets: int = 1 << 13, rounds: int = 2, seed: int = 0, max_tokens: int | None = None,
            components: int = COMPONENTS) -> SvdEmbedder:
        """Train on every document of ``docs [text]``."""
        spark = docs.sparkSession
        ship_package(spark)
        hashed = materialised(docs.select(SvdEmbedder._hashes("text", max_tokens)))

        def hit(batches):
            n, total = np.zeros(buckets, dtype=np.int64), 0
            for b in batches:
                n += np.bincount(entries(b.column("_h"), buckets)[1], minlength=buckets)
                total += int((pa.compute.list_value_length(b.column("_h")).to_numpy(zero_copy_only=False) > 0).sum())
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[some, -1].astype(np.int32)), pa.array(np.r_[n[some], total])], ["i", "n"])

        counts = hashed.mapInArrow(hit, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()  # a row a bucket
        df, total = np.zeros(buckets), 0
        for r in counts:
            if r["i"] < 0:
                total = r["n"]
            else:
                df[r["i"]] = r["n"]
        idf = np.log((1 + total) / (1 + df)) + 1
        random = np.random.default_rng(seed)
        basis = random.normal(size=(buckets, min(components, buckets)))

        def gram(basis, small: bool):
            def run(batches):
                out = np.zeros((basis.shape[1] if small else buckets, basis.shape[1]))
                for b in batches:
                    for a in range(0, b.num_rows, 512):
                        row, bucket, value = entries(b.column("_h").slice(a, 512), buckets, idf)
                        z = product(row, bucket, value, min(512, b.num_rows - a), basis)
                        if small:
                            out += z.T @ z
                        else:
                            order = np.argsort(bucket, kind="stable")
                            out += product(bucket[order], row[order], value[order], buckets, z)
                yield _rows(out)

            return _summed(spark, hashed.mapInArrow(run, "i int, numbers binary"), (basis.shape[1] if small else buckets, basis.shape[1]))

        for _ in range(1 + rounds):
            basis = np.linalg.qr(gram(basis, False))[0]
        values, vectors = np.linalg.eigh(gram(basis, True))
        leading, mean = basis @ vectors, max(total, 1) / buckets  # rows have length one, so the trace is their number
        mix = random.normal(size=(buckets, dim))
        shrink = np.sqrt(mean / (np.maximum(values, 0) + mean)) - 1
        return SvdEmbedder(idf, mix + leading @ (shrink[:, None] * (leading.T @ mix)), max_tokens)

    def embed(self, df: DataFrame, key: str = "id", text: str = "text", keep=()) -> DataFrame:
        """[key, *keep, embedding]; a text without tokens has the zero vector."""
        ship_package(df.sparkSession)
        idf, projection, kept = self.idf, self.projection, [key, *keep]
        hashed = df.select(*kept, self._hashes(text, self.max_tokens))
        schema = T.StructType([*(hashed.schema[c] for c in kept), T.StructField("embedding", VECTOR_TYPE)])

        def run(batches):
            for whole in batches:
                for a in range(0, whole.num_rows, 512):
                    b = whole.slice(a, 512)
                    row, bucket, value = entries(b.column("_h"), len(idf), idf)
                    z = product(row, bucket, value, b.num_rows, projection)
                    z = z / (np.sqrt(np.einsum("ij,ij->i", z, z)) + NORM_EPS)[:, None]
                    at = np.arange(0, z.size + 1, z.shape[1], dtype=np.int32)
                    vectors = pa.ListArray.from_arrays(pa.array(at), pa.array(z.astype(np.float32).ravel()))
                    yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), vectors], schema.names)

        return hashed.mapInArrow(run, schema)
