"""Upserts into the store: documents are shuffled once, texts to embed come from the changes."""

import json

import numpy as np
from pyspark.sql import functions as F

from docsift.operators import mutate as M
from docsift.operators.embed import HashingEmbedder
from docsift.operators.index import load_or_build, rebuild, sync
from docsift.sources.store import Store
from docsift.streaming.ingest import apply_batch

AS_OF = "2024-06-01 00:00:00"
KIND = "id string, text string, metadata map<string,string>, created_at string, updated_at string, text_hash string"


def documents(spark, rows):
    df = spark.createDataFrame([(i, t, {"k": "v"}, "2024-01-01 00:00:00", "2024-01-01 00:00:00", None) for i, t in rows], KIND)
    for c in ("created_at", "updated_at"):
        df = df.withColumn(c, F.col(c).cast("timestamp"))
    return df.withColumn("text_hash", F.sha2("text", 256))


def plain(df):
    return sorted((repr((r.id, r.text, sorted(r.metadata.items()), r.created_at, r.updated_at, r.text_hash)) for r in df.collect()))


def vecs(df):
    return sorted((r.id, r.model, r.text_hash, tuple(np.float32(r.embedding))) for r in df.collect())


def lines(spark, changes):
    return spark.createDataFrame([(json.dumps({"id": i, "text": t, "ordinal": o}),) for i, t, o in changes], "value string")


def test_dealt_upsert_equals_the_join_and_is_shuffled_once(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"), buckets=4)
    # Repeated and null ids pass as in the join; of a repeated id every row is changed.
    docs = documents(spark, [*[(str(i), f"t{i}") for i in range(60)], ("7", "again"), (None, "nameless"), (None, "other")])
    rows = [("7", "new 7", 1), ("7", "newer 7", 2), ("8", None, 3), ("new", "n", 4), (None, "x", 5), ("new", "older", 0)]
    changes = M.prepare(spark.createDataFrame(rows, "id string, text string, ordinal long"), require_id=True)
    want, _ = M.upsert_batch(docs, changes, AS_OF)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table, report = M.upsert_batch(docs, changes, AS_OF, deal=store.deal)
        plan = table._jdf.queryExecution().executedPlan().toString()
        # One shuffle of documents and changes, besides the one that finds the last change of an id.
        assert "Join" not in plan and plan.count("Exchange rangepartitioning") == 1 and plan.count("Exchange ") == 2
        monkeypatch.setattr(type(table), "hint", lambda *_: 1 / 0)  # no other shuffle to write it
        staged = store.stage(table, "documents", dealt=True)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plain(store.staged(staged)) == plain(want) and report.count() == len(rows)
    assert store.head() is None
    version = store.publish(staged)
    assert store.documents(version).count() == 64 and [r.text for r in store.document("7").collect()] == ["newer 7"] * 2


def test_a_batch_embeds_the_texts_of_its_changes(spark, tmp_path, monkeypatch):
    store, emb, plans = Store(spark, str(tmp_path / "s"), buckets=4), HashingEmbedder(16), []
    docs = documents(spark, [*[(str(i), f"text {i}") for i in range(40)], ("7", "again")])
    store.publish(docs)
    load_or_build(store, emb)
    assert vecs(store.vectors()) == vecs(rebuild(docs, emb))
    embed = HashingEmbedder.embed

    def noted(self, df, *a, **k):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return embed(self, df, *a, **k)

    monkeypatch.setattr(HashingEmbedder, "embed", noted)
    assert apply_batch(store, lines(spark, [("7", "seven", 1), ("new", "fresh", 1), ("new", "early", 0)]), 1, AS_OF, emb)
    assert plans and not any("text:string" in p for p in plans)  # no scan of the documents' texts
    monkeypatch.undo()
    assert vecs(store.vectors()) == vecs(rebuild(store.documents(), emb)) and store.vectors().count() == 42
    # Documents that others changed are embedded too, from the table.
    head = store.head()
    store.publish(M.upsert_batch(store.documents(head), lines_of(spark, [("3", "edited")]), AS_OF)[0], parent=head)
    assert apply_batch(store, lines(spark, [("7", "seven", 2), ("9", "nine", 2)]), 2, AS_OF, emb)
    assert vecs(store.vectors()) == vecs(rebuild(store.documents(), emb))


def lines_of(spark, rows):
    return spark.createDataFrame(rows, "id string, text string")


def test_changed_texts_that_the_table_does_not_have_are_not_embedded(spark):
    emb = HashingEmbedder(16)
    docs = documents(spark, [("a", "one"), ("a", "two"), ("b", "b"), ("c", "c")])
    vectors = rebuild(documents(spark, [("b", "b"), ("c", "old"), ("gone", "g")]), emb)
    changed = documents(spark, [("a", "one"), ("c", "unlike"), ("none", "n")])
    assert vecs(sync(docs, vectors, emb, changed)) == vecs(sync(docs, vectors, emb)) == vecs(rebuild(docs, emb))
