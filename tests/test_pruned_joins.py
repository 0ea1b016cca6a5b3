import numpy as np
import pytest
from pyspark.sql import functions as F

from docsift.operators.balls import Balls, assigned, gaps, pivots
from docsift.operators.knn import best_match, knn, knn_bounded
from docsift.operators.quantiser import CentroidTree
from docsift.operators.similarity import TooMany, pair_share, similarity_pairs


def clustered(seed, n, dim=6, clusters=12, spread=0.05):
    r = np.random.default_rng(seed)
    c = r.normal(size=(clusters, dim))
    c /= np.linalg.norm(c, axis=1)[:, None]
    return c[r.integers(clusters, size=n)] + spread * r.normal(size=(n, dim))


def frame(spark, x, name="id", prefix="v"):
    return spark.createDataFrame([(f"{prefix}{i:05d}", [float(v) for v in row]) for i, row in enumerate(x)], f"{name} string, embedding array<float>")


@pytest.mark.parametrize("n", [1, 2, 17, 300])
def test_the_tree_equals_all_centroids(n):
    r = np.random.default_rng(n)
    c = np.concatenate([r.normal(size=(n, 5)), np.zeros((1, 5)), r.normal(size=(n, 5)) * 1e-7])
    c = np.concatenate([c, c[:3]])  # ties
    x = np.concatenate([r.normal(size=(700, 5)), c])
    tree = CentroidTree(c)
    d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    every = np.argsort(np.round(d, 9), axis=1, kind="stable")
    for m in (1, 4, len(c)):
        assert (tree.nearest(x, m) == every[:, :m]).all()


def test_the_tree_looks_at_a_part_and_holds_a_tile():
    import tracemalloc

    c, x = clustered(1, 20_000, 16, 200), clustered(1, 2000, 16, 200)
    tree = CentroidTree(c)
    tracemalloc.start()
    got = tree.nearest(x)[:, 0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert tree.compared < 0.3 * len(c) * len(x)
    assert peak < 100 << 20  # the flat table of differences takes 5 GB
    assert (got[:100] == [((c - v) ** 2).sum(axis=1).round(9).argmin() for v in x[:100]]).all()


def test_gaps_are_lower_bounds(spark):
    x = clustered(3, 300)
    rows = frame(spark, x)
    centres = pivots(rows, "id", 20)
    table = assigned(rows, centres).toPandas().sort_values("id")
    balls = Balls.of(assigned(rows, centres), len(centres))
    own, gap = table["_list"].to_numpy(), gaps(centres, balls, balls)
    x = x.astype(np.float32).astype(np.float64)
    d = np.sqrt(((x[:, None, :] - x[None]) ** 2).sum(axis=2))
    assert (gap[own[:, None], own[None, :]] <= d).all() and gap.max() > 0.5


def pairs_of(df):
    return sorted((r.id_a, r.id_b, round(r.sim, 6)) for r in df.collect())


def test_similarity_over_lists_equals_one_list(spark):
    x = clustered(5, 250) * np.random.default_rng(1).uniform(0.5, 2, size=(250, 1))
    x[:4] = 0
    x[10:20] = x[9]
    v = frame(spark, x)
    for wanted in ({"min_sim": 0.7}, {"min_sim": -0.9}, {"k": 3}, {"k": 4, "min_sim": 0.4}, {"k": 300}):
        assert pairs_of(similarity_pairs(v, lists=16, max_block_rows=20, **wanted)) == pairs_of(similarity_pairs(v, **wanted))


def test_the_share_of_pairs_falls_with_min_sim(spark):
    v = frame(spark, clustered(6, 400))
    shares = [pair_share(v, s, lists=40) for s in (-5.0, 0.0, 0.5, 0.9)]
    assert shares[0] == 1.0 and shares == sorted(shares, reverse=True) and shares[-1] < 0.3


def test_most_pairs_are_refused_but_a_dense_cluster_is_not(spark):
    with pytest.raises(TooMany):
        similarity_pairs(frame(spark, clustered(7, 400)), min_sim=-3, lists=8)
    x = clustered(8, 800, clusters=20)
    assert similarity_pairs(frame(spark, x), min_sim=0.9, lists=20).count() > 800


def hits(df):
    return sorted((r.query_id, r.rank, r.id, round(r.dist, 6)) for r in df.collect())


def test_bounded_search_equals_the_exact_one(spark):
    corpus, queries = frame(spark, clustered(9, 500)), frame(spark, clustered(9, 120), "query_id", "q")
    for options in ({"k": 5}, {"k": 3, "threshold": 0.9}, {"k": 600}):
        assert hits(knn_bounded(corpus, queries, sample=64, lists=20, max_block_rows=30, **options)) == hits(knn(corpus, queries, **options))
    # Many blocks take the bounded way by themselves.
    assert hits(knn(corpus, queries, 5, block_bytes=6 * 8 * 50)) == hits(knn(corpus, queries, 5))
    none = corpus.filter(F.lit(False))
    assert knn_bounded(none, queries, 3).count() == 0 and knn_bounded(corpus, queries.limit(0), 3).count() == 0


def test_bounded_cosine_with_zero_vectors(spark):
    x, q = clustered(10, 200), clustered(10, 40)
    x[[3, 50]] = 0
    q[7] = 0
    corpus, queries = frame(spark, x), frame(spark, q, "query_id", "q")
    mine = knn_bounded(corpus, queries, 2, metric="cosine", sample=32, lists=10, max_block_rows=30)
    assert hits(mine) == hits(knn(corpus, queries, 2, metric="cosine"))
    assert best_match(corpus, queries, block_bytes=6 * 8 * 10).count() == 40
