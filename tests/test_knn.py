"""Nearest neighbours and vector functions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsift.functions.vectors import cosine_similarity, dot, l2_normalize, squared_l2
from docsift.operators.knn import best_match, knn, knn_grid, knn_sql, knn_vector
from docsift.plans.search import search_vector
from tests.conftest import SF01


def _rows(df):
    return [(r["query_id"], r["rank"], r["id"], round(r["dist"], 6)) for r in df.orderBy("query_id", "rank").collect()]


def test_threshold_inclusive_scores(docs_factory, vectors_factory):
    # squared distances 0, 1, 4 -> scores 1.0, 0.5, 0.2 exactly
    vecs = vectors_factory([("a", [0, 0]), ("b", [1, 0]), ("c", [2, 0])])
    docs = docs_factory([("a", "ta", None), ("b", "tb", None), ("c", "tc", None)])
    got = search_vector(docs, vecs, [0.0, 0.0], k=3, threshold=0.5).collect()
    assert [(r["id"], r["score"]) for r in got] == [("a", 1.0), ("b", 0.5)]
    got = search_vector(docs, vecs, [0.0, 0.0], k=1, threshold=0.5).collect()
    assert [r["id"] for r in got] == ["a"]


def test_self_and_opposite(vectors_factory):
    v = np.array([0.6, 0.8])
    vecs = vectors_factory([("self", v), ("opp", -v)])
    got = {r["id"]: r["score"] for r in knn_vector(vecs, v, k=2).collect()}
    assert got["self"] == pytest.approx(1.0)
    assert got["opp"] == pytest.approx(0.2)


def test_k_validation_and_cap(vectors_factory):
    vecs = vectors_factory([("a", [0, 0]), ("b", [1, 0]), ("c", [2, 0])])
    for bad in (0, -1):
        with pytest.raises(ValueError):
            knn_vector(vecs, [0.0, 0.0], k=bad)
    assert knn_vector(vecs, [0.0, 0.0], k=100).count() == 3


def test_empty_corpus(spark, vectors_factory):
    vecs = vectors_factory([("a", [0, 0])]).limit(0)
    assert knn_vector(vecs, [0.0, 0.0], k=5).count() == 0


def test_ties_broken_by_id(vectors_factory):
    vecs = vectors_factory([("b", [1, 0]), ("a", [1, 0]), ("c", [0, 1])])
    got = [r["id"] for r in knn_vector(vecs, [1.0, 0.0], k=2).orderBy("rank").collect()]
    assert got == ["a", "b"]


def test_numpy_equals_hof_and_grid(spark):
    from docsift.sources.testdata import vectors_from_testdata

    vecs = vectors_from_testdata(spark, SF01).select("id", "embedding")
    q = vecs.filter(F.col("id") == "11").first()["embedding"]
    a = [(r["id"], round(r["dist"], 6)) for r in knn_vector(vecs, q, 10).orderBy("rank").collect()]
    b = [(r["id"], round(r["dist"], 6)) for r in knn_sql(vecs, q, 10).orderBy("rank").collect()]
    assert a == b
    queries = vecs.select(F.col("id").alias("query_id"), "embedding")
    bc = _rows(knn(vecs, queries, 5))
    gr = _rows(knn_grid(vecs, queries, 5, max_block_rows=64, max_query_rows=50))
    assert bc == gr
    assert len(bc) == 500 * 5


def test_threshold_before_equals_after(spark):
    from docsift.sources.testdata import vectors_from_testdata

    vecs = vectors_from_testdata(spark, SF01).select("id", "embedding")
    queries = vecs.select(F.col("id").alias("query_id"), "embedding")
    t = 0.6
    with_t = _rows(knn(vecs, queries, 10, threshold=t))
    after = knn(vecs, queries, 10).filter(F.col("score") >= t)
    assert with_t == _rows(after)


def test_vector_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, b array<float>")
    r = df.select(
        squared_l2("a", "b").alias("d"), dot("a", "a").alias("p"), cosine_similarity("a", "a").alias("c"),
        l2_normalize("a").alias("u"), l2_normalize("b").alias("z"), cosine_similarity("a", "b").alias("cz"),
    ).first()
    assert r["d"] == 25.0 and r["p"] == 25.0 and r["c"] == pytest.approx(1.0)
    assert r["u"] == pytest.approx([0.6, 0.8]) and r["z"] == [0.0, 0.0] and r["cz"] == 0.0


def test_best_match_cosine(vectors_factory, spark):
    vecs = vectors_factory([("a", [1, 0]), ("b", [0, 1]), ("z", [0, 0])])
    q = spark.createDataFrame([("q", [0.1, 1.0])], "query_id string, embedding array<float>")
    r = best_match(vecs, q).first()
    assert r["id"] == "b"


def _vectors(spark):
    from docsift.sources.testdata import vectors_from_testdata

    return vectors_from_testdata(spark, SF01).select("id", "embedding")


def test_query_blocks_change_nothing(spark):
    vecs = _vectors(spark)
    queries = vecs.limit(70).select(F.col("id").alias("query_id"), "embedding")
    assert _rows(knn(vecs, queries, 5, block_bytes=64 * 8 * 9)) == _rows(knn(vecs, queries, 5))


def test_ann_full_probe_equals_exact(spark):
    from docsift.operators.ann import ann_candidates, ann_search, build_ivf, within_probes

    vecs = _vectors(spark)
    idx = build_ivf(vecs, nlist=6, seed=3)
    queries = vecs.limit(50).select(F.col("id").alias("query_id"), "embedding")
    exact = _rows(knn(vecs, queries, 10))
    assert _rows(ann_search(idx, queries, 10, nprobe=idx.nlist)) == exact
    found = ann_candidates(idx, queries, 10, nprobe=6, most_rows=100)
    assert _rows(within_probes(found, 10, 6)) == exact
    assert _rows(within_probes(found, 10, 2)) == _rows(ann_search(idx, queries, 10, nprobe=2))


def test_ann_always_returns_k_rows(spark):
    from docsift.operators.ann import ann_search, build_ivf

    vecs = _vectors(spark)
    idx = build_ivf(vecs, nlist=40, seed=3)  # lists of about 12 rows
    queries = vecs.limit(60).select(F.col("id").alias("query_id"), "embedding")
    for kw in ({"nprobe": 1}, {"ef_search": 10}, {"ef_search": 10**6}):
        n = ann_search(idx, queries, 30, **kw).groupBy("query_id").count()
        assert n.count() == 60 and n.filter("count <> 30").isEmpty()
    assert _rows(ann_search(idx, queries, 30, ef_search=10**6)) == _rows(knn(vecs, queries, 30))
    assert ann_search(idx, queries, 1000).groupBy("query_id").count().filter("count <> 500").isEmpty()


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_ann_fitted_probe_reaches_recall(spark, sf):
    import __spark_entry__ as E
    from pyspark.sql import functions as F

    from docsift.plans.evaluate import recall_at_k

    d = f"/root/testdata/{sf}"
    few = F.col("query_id").cast("long") % 7 == 0
    exact = E.queries()["semantic_search_grid"](spark, d).where(few)
    got = recall_at_k(E.queries()["ann_probe_fitted"](spark, d).where(few), exact, 10).first()["recall"]
    print(sf, "recall", got)
    assert got >= 0.9


def test_ann_written_index_prunes_lists(spark, tmp_path):
    from docsift.operators.ann import IvfIndex, ann_search, build_ivf

    vecs = _vectors(spark)
    idx = build_ivf(vecs, nlist=4, seed=1)
    idx.write(str(tmp_path / "ivf"))
    back = IvfIndex.read(spark, str(tmp_path / "ivf"), idx.centroids)
    queries = vecs.limit(20).select(F.col("id").alias("query_id"), "embedding")
    assert _rows(ann_search(back, queries, 5, nprobe=2)) == _rows(ann_search(idx, queries, 5, nprobe=2))
    probe = back.vectors.filter(F.col("list_id").isin([0]))
    plan = probe._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "list_id" in plan


def test_top_k_stays_bounded():
    from docsift.operators.knn import TopK

    rng = np.random.default_rng(0)
    q, x = rng.normal(size=(50_000, 4)), rng.normal(size=(2_000, 4))
    best = TopK(3, len(q))
    for a in range(0, 2_000, 500):
        best.add(x[a : a + 500], np.array([f"{i:05d}" for i in range(a, a + 500)], dtype=object), q, np.arange(len(q)))
        assert best.size() <= 3 * len(q)
    some = rng.integers(0, len(q), 50)
    at, ids, _, _ = best.result()
    for i in some:
        d = ((x - q[i]) ** 2).sum(axis=1)
        assert ids[at == i].tolist() == [f"{j:05d}" for j in np.argsort(d)[:3]]


def test_similarity_tiles_stay_bounded():
    import tracemalloc

    from docsift.operators.similarity import pairs_above

    x = np.random.default_rng(1).normal(size=(20_000, 4))
    x /= np.linalg.norm(x, axis=1)[:, None]
    tracemalloc.start()
    n = sum(len(r) for r, _, _ in pairs_above(x, x, 0.9999))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 20_000 and peak < 1 << 30


def test_similarity_refuses_most_pairs(spark):
    from docsift.operators.similarity import similarity_pairs

    with pytest.raises(Exception, match="N x N"):
        similarity_pairs(_vectors(spark), min_sim=-2).count()
