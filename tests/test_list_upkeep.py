"""K2: lists are split and dropped as the table grows; always what assigning all gives."""

import numpy as np
import pytest

from docsift.operators.ann import IvfIndex, ann_search, assign_lists, build_ivf, carry_lists
from docsift.operators.knn import knn
from docsift.operators.list_upkeep import balanced, two_means
from docsift.session import materialised


def table(spark, x, first=0):
    rows = [(str(first + i), [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "id string, embedding array<float>")


def own(df):
    return sorted((r.id, r.list_id) for r in df.select("id", "list_id").collect())


def assert_assigned(index):
    assert own(index.vectors) == own(assign_lists(index.vectors.select("id", "embedding"), index.centroids))
    counted = np.bincount([x for _, x in own(index.vectors)], minlength=index.nlist)
    assert (counted == index.sizes).all()


@pytest.fixture(scope="module")
def clusters():
    r = np.random.default_rng(5)
    centres = r.normal(size=(9, 8))
    return (centres[r.integers(0, 9, 1500)] + 0.2 * r.normal(size=(1500, 8))).astype(np.float32)


def test_long_lists_are_split_and_empty_ones_dropped(spark, clusters):
    given = np.vstack([np.full(8, 90.0), clusters[0], clusters[1] + 0.1, np.full(8, -90.0)]).astype(np.float64)
    index = build_ivf(table(spark, clusters), centroids=given)
    assert index.sizes.max() > 120 and (index.sizes == 0).sum() == 2
    after = balanced(index, most=120)
    assert after.sizes.max() <= 120 and after.sizes.min() > 0 and after.sizes.sum() == 1500
    assert_assigned(after)
    short = balanced(after, most=1500, least=int(np.sort(after.sizes)[3]))
    assert short.nlist < after.nlist
    assert_assigned(short)
    queries = table(spark, clusters[:20]).withColumnRenamed("id", "query_id")
    rows = lambda df: sorted((r.query_id, r.rank, r.id) for r in df.collect())
    assert rows(ann_search(after, queries, 5, nprobe=after.nlist)) == rows(knn(after.vectors.select("id", "embedding"), queries, 5))


def test_rows_that_come_later_split_the_list_they_fall_in(spark, clusters):
    index = build_ivf(table(spark, clusters[:300]), 6)
    grown = table(spark, clusters[:300]).unionByName(table(spark, clusters[2:3] + 0.01 * np.random.default_rng(1).normal(size=(400, 8)), 5000))
    lists, changed = carry_lists(grown, index.vectors, index.centroids)
    assert changed.count() == 400
    carried = IvfIndex.over(materialised(lists), index.centroids)
    after = balanced(carried, most=150)
    assert carried.sizes.max() > 400 and after.sizes.max() <= 150
    assert_assigned(after)


def test_copies_cannot_be_split(spark, clusters):
    x = np.vstack([np.repeat(clusters[:1], 700, axis=0), clusters[100:200]])
    index = build_ivf(table(spark, x), centroids=np.vstack([clusters[0], clusters[0] + 9.0]).astype(np.float64))
    after = balanced(index, most=60)
    assert sorted(after.sizes)[-1] >= 700 and sorted(after.sizes)[-2] <= 60
    assert_assigned(after)
    again = balanced(after, most=60)
    assert_assigned(again)


def test_ties_go_to_the_least_list(spark):
    x = [[a, b] for a in range(-6, 7) for b in range(-6, 7)]
    after = balanced(build_ivf(table(spark, x), centroids=np.array([[0.0, 0.0], [6.0, 6.0], [0.0, 0.0]])), most=20)
    assert after.sizes.max() <= 20
    assert_assigned(after)


def test_nothing_to_do(spark, clusters):
    index = build_ivf(table(spark, clusters[:100]), 4)
    assert balanced(index, most=100) is index
    empty = build_ivf(table(spark, clusters[:2]).limit(0), centroids=np.eye(8)[:2])
    after = balanced(empty)
    assert after.nlist == 1 and after.vectors.count() == 0
    assert two_means(np.ones((5, 3))) is None


def test_the_client_keeps_its_lists_short(spark, tmp_path):
    from docsift.operators.embed import HashingEmbedder
    from docsift.plans.api import SearchEngine
    from docsift.sources.testdata import documents_from_testdata

    eng = SearchEngine(spark, str(tmp_path / "store"), HashingEmbedder(64), buckets=4)
    assert eng.index.upkeep() is None
    eng.store.publish(documents_from_testdata(spark, "/root/testdata/sf0.001"))
    eng.index.rebuild()
    eng.index.build_ivf(nlist=2)
    before = eng.store.head()
    index = eng.index.upkeep(most=40)
    assert index.nlist > 2 and eng.store.head().version == before.version + 1
    assert (index.sizes == eng.store.coarse()[1]).all() and index.nprobe == eng.store.head().nprobe
    assert_assigned(index)
    head = eng.store.head()
    eng.index.upkeep(most=int(index.sizes.max()))
    assert eng.store.head().version == head.version
    top = eng.search.query(eng.docs().orderBy("id").first()["text"], k=1).first()
    assert top["score"] > 0.99
