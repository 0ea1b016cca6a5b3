"""Blocks of queries that see all their rows pass: exact and by code."""

import numpy as np
import pytest

from docsift.operators import ann, knn, nearest, pq, quantiser


def frame(spark, x, name="id", prefix="v"):
    return spark.createDataFrame([(f"{prefix}{i:05d}", [float(v) for v in row]) for i, row in enumerate(x)], f"{name} string, embedding array<float>")


def hits(df):
    return sorted((r.query_id, r.rank, r.id, round(r.dist, 6)) for r in df.collect())


@pytest.mark.parametrize("scale, shift", [(1.0, 0.0), (1e-4, 0.0), (1.0, 1e4), (1e6, 0.0)])
def test_nearest_equals_all_distances(scale, shift):
    r = np.random.default_rng(1)
    x = (r.normal(size=(150, 8)) * scale + shift)[r.integers(0, 150, 3000)]  # many equal distances
    x[:1500] += r.normal(size=(1500, 8)) * scale
    q = np.concatenate([x[:20], r.normal(size=(5, 8))])
    ids = r.permutation(3000).astype(str).astype(object)
    d = ((x[None] - q[:, None]) ** 2).sum(axis=2)
    names = np.unique(ids.astype(str), return_inverse=True)[1]
    for k in (1, 7, 40):
        want = [ids[np.lexsort((names, np.round(v, 9)))[:k]].tolist() for v in d]
        for most in (None, np.sort(d, axis=1)[:, k - 1] * (1 + 1e-9) + 1e-8):
            best = nearest.Nearest(q, k, most)
            for a in range(0, 3000, 700):
                some = x[a : a + 700]
                best.start(lambda rows, some=some: some[rows], ids[a : a + 700], np.arange(a, min(3000, a + 700)))
                for at in (np.arange(0, 25, 2), np.arange(1, 25, 2)):
                    best.add(some[:300], 0, at)
                    best.add(some[300:], 300, at)
                best.settle()
            at, got, dist, _ = best.result()
            assert [got[at == i].tolist() for i in range(len(q))] == want
            assert (ids[best.tags()] == got).all() and np.allclose(dist, d[at, best.tags()])


def test_equal_rows_without_end_stay_bounded():
    x, ids = np.zeros((20_000, 3)), np.arange(20_000).astype(str).astype(object)
    best = nearest.Nearest(np.zeros((40, 3)), 3)
    best.start(lambda rows: x[rows], ids)
    best.add(x)
    assert best.count.max() <= nearest.width_of(3)
    best.settle()
    assert best.result()[1].tolist() == ["0", "1", "10"] * 40


def test_true_places():
    m = np.random.default_rng(0).random(4096) < 0.01
    assert (nearest.true_places(m) == np.flatnonzero(m)).all()


def test_one_product_gives_the_lists_of_the_tree(monkeypatch):
    r = np.random.default_rng(3)
    c = np.concatenate([r.normal(size=(90, 5)), np.zeros((30, 5))])  # more ties than spare places
    x = np.concatenate([r.normal(size=(900, 5)), c])
    flat = {m: quantiser.CentroidTree(c).nearest(x, m) for m in (1, 6, 100, 120)}
    monkeypatch.setattr(quantiser, "FLAT", 0)
    for m, got in flat.items():
        assert (got == quantiser.CentroidTree(c).nearest(x, m)).all()


def test_books_of_tasks_are_those_of_the_driver(spark):
    x = np.random.default_rng(4).normal(size=(700, 10))
    assert (pq.train_books(x, 4, spark=spark) == pq.train_books(x, 4)).all()


def test_a_query_gives_k_rows_to_the_ranking(spark, monkeypatch):
    x = np.random.default_rng(5).normal(size=(600, 6))
    corpus, queries = frame(spark, x), frame(spark, x[:200], "query_id", "q")
    seen, rank = [], knn.final_rank
    monkeypatch.setattr(knn, "final_rank", lambda found, *a, **b: seen.append(found) or rank(found, *a, **b))
    found = knn.knn_bounded(corpus, queries, 5, sample=64, lists=12, max_block_rows=40)
    assert seen[-1].count() == 200 * 5  # before, up to k rows of each cell
    assert hits(found) == hits(knn.knn(corpus, queries, 5))


def test_shortlists_are_a_row_a_query(spark, monkeypatch):
    r = np.random.default_rng(6)
    x = r.normal(size=(900, 10))
    index = pq.PqIndex.build(ann.build_ivf(frame(spark, x), nlist=12, seed=1))
    index.ivf.nprobe = 5
    queries = frame(spark, x[:150], "query_id", "q")
    show = lambda df: sorted((h.query_id, h.place, h.id, h.list_id) for h in df.collect())
    one = index.shortlists(queries, 40)
    assert one.count() == 150 and {len(h.ids) for h in one.collect()} == {40}
    want, found = show(index.nearest_codes(queries, 40)), hits(index.search(queries, 6))
    # Brute force: the codes of the five nearest lists.
    codes = {h.id: (np.frombuffer(h.code, dtype=np.uint8), h.list_id) for h in index.codes.collect()}
    names = np.array(sorted(codes))
    flat, own = pq.decode(np.array([codes[n][0] for n in names]), index.books, 10), np.array([codes[n][1] for n in names])
    q = x[:150].astype(np.float32).astype(np.float64)
    probes, count = index.ivf.probes(q, 40, 5)
    for i in range(0, 150, 7):
        d = np.where(np.isin(own, probes[i][: count[i]]), ((flat - q[i]) ** 2).sum(axis=1).round(9), np.inf)
        assert [h[2] for h in want if h[0] == f"q{i:05d}"] == names[np.argsort(d, kind="stable")[:40]].tolist()
    monkeypatch.setattr(pq, "CELL_CODES", 200)  # several groups, each settled in parts
    assert show(index.nearest_codes(queries, 40)) == want and hits(index.search(queries, 6)) == found


def test_rows_of_one_id_are_all_ranked(spark):
    x = np.random.default_rng(7).normal(size=(300, 6))
    x[200:] = x[:100]
    rows = spark.createDataFrame([(f"v{i % 200:05d}", [float(v) for v in row]) for i, row in enumerate(x)], "id string, embedding array<float>")
    index = pq.PqIndex.build(ann.build_ivf(rows, nlist=5, seed=1))
    index.ivf.nprobe, index.shortlist = 5, 60
    got = hits(index.search(frame(spark, x[:20], "query_id", "q"), 2))
    assert [(h[0], h[2]) for h in got] == [(f"q{i:05d}", f"v{i:05d}") for i in range(20) for _ in range(2)]


def test_blocks_fill_the_rounds_of_tasks(spark):
    tasks = spark.sparkContext.defaultParallelism
    assert nearest.block_count(spark, 10, 50) == 1 and nearest.block_count(spark, 10, 5) == 2
    for rows, most in ((100_000, 3000), (100_000, 100_000), (5_000, 400)):
        n = nearest.block_count(spark, rows, most)
        assert n % tasks == 0 and -(-rows // n) <= most
