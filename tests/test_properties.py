"""Property tests: F3 against a Python model of LIKE, T2 against brute force."""

import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docsift.functions.text import like_contains
from docsift.operators.knn import knn

ALPHABET = "aAb%_\\éÉ"


def like_model(text: str, query: str) -> bool:
    """LIKE '%q%' with '%' any run, '_' one char, no escape, ASCII-only folding."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    t, q = text.translate(fold), query.translate(fold)
    rx = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in q)
    return re.search(rx, t, flags=re.DOTALL) is not None


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.text(ALPHABET, max_size=8), st.text(ALPHABET, max_size=4)), min_size=30, max_size=60))
def test_like_matches_model(spark, pairs):
    df = spark.createDataFrame([(i, t, q) for i, (t, q) in enumerate(pairs)], "i int, text string, q string")
    got = {}
    for i, (t, q) in enumerate(pairs):
        got[i] = df.filter(F.col("i") == i).select(like_contains("text", q).alias("m"))
    # one job for all pairs: union of the per-pair predicates
    union = None
    for i, d in got.items():
        d = d.withColumn("i", F.lit(i))
        union = d if union is None else union.unionByName(d)
    res = {r["i"]: r["m"] for r in union.collect()}
    for i, (t, q) in enumerate(pairs):
        assert res[i] == like_model(t, q), (t, q)


@settings(max_examples=5, deadline=None)
@given(
    st.integers(min_value=5, max_value=40),
    st.integers(min_value=1, max_value=6),
    st.integers(min_value=1, max_value=12),
    st.integers(min_value=0, max_value=10**6),
)
def test_knn_matches_brute_force(spark, n, m, k, seed):
    rng = np.random.default_rng(seed)
    X = rng.integers(-2, 3, size=(n, 3)).astype(np.float32)  # small ints: many exact ties
    Q = rng.integers(-2, 3, size=(m, 3)).astype(np.float32)
    corpus = spark.createDataFrame([(f"d{i}", X[i].tolist()) for i in range(n)], "id string, embedding array<float>")
    queries = spark.createDataFrame([(f"q{j}", Q[j].tolist()) for j in range(m)], "query_id string, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["id"]) for r in knn(corpus, queries, k).collect())
    want = []
    for j in range(m):
        d = ((X.astype(np.float64) - Q[j].astype(np.float64)) ** 2).sum(axis=1)
        order = sorted(range(n), key=lambda i: (round(d[i], 9), f"d{i}"))[:k]
        want += [(f"q{j}", r + 1, f"d{i}") for r, i in enumerate(order)]
    assert got == sorted(want)
