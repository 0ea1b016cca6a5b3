"""Searches and joins of two large sides: blocks that grow, queries beyond a block in cells."""

import numpy as np
from pyspark.sql import functions as F

from docsift.operators import ann, knn, pq
from docsift.operators.similarity import _lists_of, similarity_pairs


def frame(spark, x, name="id", prefix="v"):
    return spark.createDataFrame([(f"{prefix}{i:05d}", [float(v) for v in row]) for i, row in enumerate(x)], f"{name} string, embedding array<float>")


def hits(df):
    return sorted((r.query_id, r.rank, r.id, round(r.dist, 6)) for r in df.collect())


def test_blocks_grow_with_the_table():
    assert knn.block_rows(500, 128, 32_768) == 128
    for n in (5_000, 100_000, 500_000):
        assert -(-n // knn.block_rows(n, 128, 32_768)) <= knn.BLOCKS
    assert knn.block_rows(10**8, 128, 32_768) == 32_768


def test_cells_of_a_grid_and_of_lists_do_not_follow_the_rows(spark):
    x = np.random.default_rng(0).normal(size=(900, 4))
    corpus, queries = frame(spark, x), frame(spark, x[:300], "query_id")
    found = knn.knn_grid(corpus, queries, 3, max_block_rows=4, max_query_rows=4)
    assert hits(found) == hits(knn.knn(corpus, queries, 3))
    # Before, 225 and 75 blocks; a task had a partial row for each query and block.
    plan = found._jdf.queryExecution().toString()
    assert "least" in plan.lower()
    assert _lists_of(corpus, 4, 4).blocks.sum() <= knn.BLOCKS + 4
    few = similarity_pairs(corpus, k=2, lists=4, max_block_rows=4)
    pairs = lambda df: sorted((r.id_a, r.id_b, round(r.sim, 6)) for r in df.collect())
    assert pairs(few) == pairs(similarity_pairs(corpus, k=2))


def test_best_rows_with_ties_bounds_and_single_precision():
    r = np.random.default_rng(1)
    for scale, shift in ((1.0, 0.0), (1e-4, 0.0), (1.0, 1e4), (1e9, 0.0)):
        x = (r.normal(size=(150, 8)) * scale + shift)[r.integers(0, 150, 3000)]
        q = np.concatenate([x[:20], r.normal(size=(5, 8))])
        ids = r.permutation(3000).astype(str).astype(object)
        d = ((x[None] - q[:, None]) ** 2).sum(axis=2)
        names = np.unique(ids.astype(str), return_inverse=True)[1]
        for known in (False, True):
            want = [ids[np.lexsort((names, np.round(v, 9)))[:7]].tolist() for v in d]
            best = knn.TopK(7, len(q), most=np.sort(d, axis=1)[:, 6] * (1 + 1e-9) + 1e-8 if known else None)
            for a in range(0, 3000, 700):
                best.add(x[a : a + 700], ids[a : a + 700], q, np.arange(len(q)), a)
            at, got, _, _ = best.result()
            assert [got[at == i].tolist() for i in range(len(q))] == want
            assert set(best.tags()) <= set(range(0, 3000, 700))


def test_many_queries_meet_lists_in_cells(spark):
    r = np.random.default_rng(2)
    vectors, queries = frame(spark, r.normal(size=(600, 6))), frame(spark, r.normal(size=(150, 6)), "query_id", "q")
    index = ann.build_ivf(vectors, nlist=25, seed=1)
    for nprobe, k in ((1, 3), (6, 10), (25, 40)):
        for by_probe in (False, True):
            one, few = ann._candidates(index, queries, k, nprobe, 0, None, by_probe, knn.BLOCK_BYTES, ann.MOST_ROWS)
            many, none = ann._candidates(index, queries, k, nprobe, 0, None, by_probe, 6 * 8 * 20, 500)
            assert few == 150 and none == 0
            show = lambda df, k=k: hits(knn.final_rank(df.select("query_id", "id", "dist", "key"), k))
            assert show(many) == show(one)
            if by_probe:  # the k best of each probed list
                fields = lambda df: sorted((h.query_id, h.id, h.probe, h.enough, h.list_id) for h in df.collect())
                assert fields(ann.in_cells(index, queries, 600, nprobe, by_probe=True)) == fields(ann._candidates(index, queries, 600, nprobe, 0, None, True, knn.BLOCK_BYTES, 10**7)[0])
            else:  # k rows a query in a task, whatever the number of probes
                most = many.groupBy("query_id", F.spark_partition_id()).count().agg(F.max("count")).first()[0]
                assert most <= k * 5


def test_shortlists_by_code_are_the_nearest_codes(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(700, 10))
    index = pq.PqIndex.build(ann.build_ivf(frame(spark, x), nlist=9, seed=1))
    codes = {h.id: np.frombuffer(h.code, dtype=np.uint8) for h in index.codes.collect()}
    names = sorted(codes)
    flat = pq.decode(np.array([codes[n] for n in names]), index.books, 10)
    index.ivf.nprobe = 9
    q = x[:30].astype(np.float32).astype(np.float64)
    got = {}
    for h in index.nearest_codes(frame(spark, x[:30], "query_id", "q"), 15).collect():
        got.setdefault(h.query_id, []).append((h.place, h.id))
    for i in range(30):
        d = ((flat - q[i]) ** 2).sum(axis=1).round(9)
        assert [n for _, n in sorted(got[f"q{i:05d}"])] == [names[j] for j in np.argsort(d, kind="stable")[:15]]
