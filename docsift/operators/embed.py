"""V6: embed a text column into unit vectors.

An embedder maps ``DataFrame[key, text]`` to ``DataFrame[key, embedding]``.
Documents and queries go through the same embedder (no prompt prefix).

* ``HashingEmbedder``: a deterministic stand-in expressed in Spark SQL only
  (no Python per row): ASCII case folding, all tokens ``[a-z0-9]+`` of the text (or the
  first ``max_tokens``, if a limit is given), bucket = first four hex digits of md5(token) mod dim, bucket
  counts, L2 normalised. The same expression exists in DuckDB, so semantic
  search can be checked end to end against SQL.
* ``PrecomputedEmbedder``: vectors already computed elsewhere, joined by id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsift.functions.text import ascii_lower
from docsift.session import ship_package
from docsift.schema import NORM_EPS

TOKEN_PATTERN = "[a-z0-9]+"
# Rows and tokens that are counted at once.
ROWS, TOKENS = 1024, 1 << 19


def hashing_tokens(text_col, max_tokens: int | None = None) -> Column:
    """Folded ASCII tokens of the whole text, or its first ``max_tokens``."""
    c = F.col(text_col) if isinstance(text_col, str) else text_col
    toks = F.regexp_extract_all(ascii_lower(c), F.lit(TOKEN_PATTERN), F.lit(0))
    return toks if max_tokens is None else F.slice(toks, 1, max_tokens)


def hashing_buckets(tokens: Column, dim: int) -> Column:
    return F.transform(
        tokens, lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 4), 16, 10).cast("int"), F.lit(dim))
    )


def _unit_vectors(buckets: pa.ListArray, dim: int) -> pa.Array:
    """Bucket counts of each row at unit length, a bounded number of tokens at a time."""
    if buckets.null_count:
        raise ValueError("a text to embed is null")
    out = np.zeros((len(buckets), dim), dtype=np.float32)
    ends = np.asarray(buckets.offsets, dtype=np.int64)  # of the rows in the values of the whole batch
    values = buckets.values.to_numpy(zero_copy_only=False)
    a = 0
    while a < len(out):
        b = max(a + 1, min(a + ROWS, int(np.searchsorted(ends, ends[a] + TOKENS, side="right")) - 1))
        flat = np.repeat(np.arange(b - a) * dim, np.diff(ends[a : b + 1])) + values[ends[a] : ends[b]]
        m = np.bincount(flat, minlength=(b - a) * dim).reshape(b - a, dim).astype(np.float64)
        n = np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]
        out[a:b] = m / (n + NORM_EPS)
        a = b
    return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * dim), pa.array(out.ravel()))


class HashingEmbedder:
    """Feature-hashing embedder (deterministic, SQL-native)."""

    name = "hashing"

    def __init__(self, dim: int = 64, max_tokens: int | None = None, engine: str = "numpy"):
        if engine not in ("numpy", "sql"):
            raise ValueError("engine is 'numpy' or 'sql'")
        self.dim = int(dim)
        self.max_tokens = None if max_tokens is None else int(max_tokens)
        self.engine = engine

    @property
    def model(self) -> str:
        return f"hashing-{self.dim}" + ("" if self.max_tokens is None else f"-{self.max_tokens}")

    def counts(self, text_col) -> Column:
        """Bucket counts in one pass over the token buckets (the tokenizer
        and md5 run once per token, not once per bucket)."""
        b = hashing_buckets(hashing_tokens(text_col, self.max_tokens), self.dim)
        zero = F.array_repeat(F.lit(0.0).cast("double"), self.dim)
        return F.aggregate(
            b, zero, lambda acc, x: F.transform(acc, lambda c, i: F.when(i == x, c + F.lit(1.0)).otherwise(c))
        )

    def embed(self, df: DataFrame, key: str = "id", text: str = "text", keep=()) -> DataFrame:
        if self.engine == "numpy":
            ship_package(df.sparkSession)
            # Tokens and md5 buckets in the JVM; the histogram + normalisation
            # in numpy (O(tokens + dim) per row), a slice of an Arrow batch at a time.
            b = hashing_buckets(hashing_tokens(text, self.max_tokens), self.dim)
            rows, dim = df.select(F.col(key), *keep, b.alias("_b")), self.dim
            schema = T.StructType([*rows.schema.fields[:-1], T.StructField("embedding", T.ArrayType(T.FloatType()))])

            def run(batches):
                for x in batches:
                    if x.num_rows:
                        yield pa.RecordBatch.from_arrays([*x.columns[:-1], _unit_vectors(x.column(x.num_columns - 1), dim)], schema.names)

            return rows.mapInArrow(run, schema)
        counted = df.select(F.col(key), *keep, self.counts(text).alias("_c"))
        normed = counted.withColumn(
            "_n", F.sqrt(F.aggregate("_c", F.lit(0.0).cast("double"), lambda a, x: a + x * x))
        )
        return normed.select(
            F.col(key),
            *keep,
            F.transform("_c", lambda x: (x / (F.col("_n") + F.lit(NORM_EPS))).cast("float")).alias("embedding"),
        )


class PrecomputedEmbedder:
    """Vectors computed elsewhere: [id, embedding] joined by key. Rows without a vector
    are not embedded; ``missing`` names them."""

    name = "precomputed"

    def __init__(self, vectors: DataFrame, model: str = "precomputed"):
        self.vectors = vectors.select("id", "embedding")
        self.model = model

    def embed(self, df: DataFrame, key: str = "id", text: str = "text", keep=()) -> DataFrame:
        v = self.vectors.withColumnRenamed("id", key)
        return df.select(key, *keep).join(v, key)

    def missing(self, df: DataFrame, key: str = "id") -> DataFrame:
        """[key] of the rows that have no vector."""
        return df.select(key).join(self.vectors.select(F.col("id").alias(key)), key, "left_anti")


def embed_documents(docs: DataFrame, embedder) -> DataFrame:
    """K1 helper: [id, embedding, model, text_hash] for every document (with
    ``PrecomputedEmbedder``: for every one that has a vector)."""
    out = embedder.embed(docs.select("id", "text", "text_hash"), key="id", text="text", keep=("text_hash",))
    return out.select("id", "embedding", F.lit(embedder.model).alias("model"), "text_hash")


def embed_queries(queries: DataFrame, embedder, text: str = "query") -> DataFrame:
    """Query texts [query_id, query] -> [query_id, embedding]."""
    return embedder.embed(queries.select("query_id", text), key="query_id", text=text)
