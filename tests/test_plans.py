"""The plan shapes the README claims, read from the physical plans."""

from pyspark.sql import functions as F

from docsift.operators import mutate as M
from docsift.operators.knn import knn
from docsift.sources.testdata import documents_from_testdata, vectors_from_testdata
from tests.conftest import SF01


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_knn_partial_topk_no_corpus_join(spark):
    vecs = vectors_from_testdata(spark, SF01).select("id", "embedding")
    queries = vecs.select(F.col("id").alias("query_id"), "embedding")
    p = plan(knn(vecs, queries, 10))
    assert "MapInArrow" in p
    assert "WindowGroupLimit" in p and "Partial" in p
    assert "SortMergeJoin" not in p and "BroadcastHashJoin" not in p


def test_large_change_set_is_not_broadcast(spark):
    docs = documents_from_testdata(spark, SF01)
    ch = spark.createDataFrame([(str(i), "x" * 2000, None) for i in range(300)], "id string, text string, metadata map<string,string>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1kb")
    try:
        table, _ = M.upsert(docs, ch, "2024-06-01 00:00:00")
        p = plan(table)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" not in p and "SortMergeJoin" in p


def test_drift_and_lookup_read_no_text(spark, tmp_path):
    from docsift.operators.embed import HashingEmbedder
    from docsift.operators.index import drift, rebuild
    from docsift.sources.store import Store

    store = Store(spark, str(tmp_path / "s"))
    docs = documents_from_testdata(spark, SF01)
    store.publish(docs, rebuild(docs, HashingEmbedder(16)))
    p = drift(store.documents(), store.vectors(), "hashing-16")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in p and "text:string" not in p and "embedding" not in p


def test_metadata_search_ranks_ids_first(spark):
    from docsift.plans.search import metadata_search

    docs = documents_from_testdata(spark, SF01)
    p = plan(metadata_search(docs, "lang", "fr", 10))
    assert "BroadcastHashJoin" in p and "TakeOrderedAndProject" in p
