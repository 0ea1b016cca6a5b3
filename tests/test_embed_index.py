"""V5 V6 K1 K2 J6 A4 S1 S5 S6 I1."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsift.operators.embed import HashingEmbedder, embed_documents
from docsift.operators.index import drift, health, rebuild, sync
from docsift.operators.pooling import mean_pool
from docsift.sources.testdata import documents_from_testdata
from tests.conftest import SF01


def vec_map(df):
    return {r["id"]: np.asarray(r["embedding"]) for r in df.collect()}


def test_pooling_masks_and_zero(spark):
    rows = [("a", 1, [1.0, 0.0]), ("a", 0, [1e30, float("nan")]), ("b", 0, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "id string, mask int, vec array<double>")
    got = vec_map(mean_pool(df, dim=2))
    assert got["a"] == pytest.approx([1.0, 0.0]) and list(got["b"]) == [0.0, 0.0]
    for bad in ([1.0], [1.0, 2.0, 3.0]):
        wrong = spark.createDataFrame([("a", 1, bad)], "id string, mask int, vec array<double>")
        with pytest.raises(Exception, match="length 2"):
            mean_pool(wrong, dim=2).collect()


def test_truncation_at_256_tokens(spark):
    head = " ".join(f"w{i}" for i in range(256))
    df = spark.createDataFrame([("a", head + " extra words"), ("b", head + " other")], "id string, text string")
    for engine in ("numpy", "sql"):
        v = vec_map(HashingEmbedder(64, 256, engine).embed(df))
        assert np.array_equal(v["a"], v["b"])
        v = vec_map(HashingEmbedder(64, engine=engine).embed(df))  # no limit: the whole text
        assert not np.array_equal(v["a"], v["b"])


def test_hashing_engines_agree_and_unit(spark):
    docs = documents_from_testdata(spark, SF01).limit(200)
    a = vec_map(HashingEmbedder(64, engine="numpy").embed(docs.select("id", "text")))
    b = vec_map(HashingEmbedder(64, engine="sql").embed(docs.select("id", "text")))
    assert a.keys() == b.keys()
    for k in a:
        assert np.array_equal(a[k], b[k])
        n = float(np.sqrt((a[k].astype(np.float64) ** 2).sum()))
        assert n == pytest.approx(1.0, abs=1e-6) or n == 0.0


def test_sync_equals_rebuild_after_edits(spark):
    from docsift.operators import mutate as M

    emb = HashingEmbedder(32)
    docs = documents_from_testdata(spark, SF01).limit(300)
    vecs = rebuild(docs, emb)
    ch = spark.createDataFrame(
        [("5", "changed text", None), ("new1", "brand new", None)], "id string, text string, metadata map<string,string>"
    )
    edited, _ = M.upsert(docs, ch, "2024-06-01 00:00:00")
    edited, _ = M.delete(edited, spark.createDataFrame([("7",)], "id string"))
    synced = vec_map(sync(edited, vecs, emb))
    full = vec_map(rebuild(edited, emb))
    assert synced.keys() == full.keys()
    assert all(np.array_equal(synced[k], full[k]) for k in full)
    st = {r["id"]: r["status"] for r in drift(edited, vecs, emb.model).filter("status <> 'ok'").collect()}
    assert st == {"5": "stale", "new1": "missing", "7": "orphan"}
    h = health(edited, vecs, emb.model).first().asDict()
    assert h == {"documents": 300, "vectors": 300, "missing": 1, "orphans": 1, "stale": 1}


def test_store_roundtrip_and_new_db(spark, tmp_path, docs_factory):
    from docsift.operators.ann import build_ivf
    from docsift.sources.store import Conflict, Store

    store = Store(spark, str(tmp_path / "store"), buckets=4)
    assert store.head() is None and store.documents().count() == 0
    docs = docs_factory([("a", "x", {"k": "v"}), ("b", "y", None)])
    v0 = store.publish(docs, batch_id=7)
    assert store.documents().count() == 2 and store.vectors().count() == 0 and store.document("a").first()["text"] == "x"
    vecs = rebuild(docs, HashingEmbedder(8))
    ivf = build_ivf(vecs, 2, seed=1)
    v1 = store.publish(vectors=vecs, parent=v0, lists=ivf.vectors, centroids=ivf.centroids)
    assert v1.documents == v0.documents and v1.batch_id == 7  # inherited
    assert store.lists().count() == 2 and len(store.centroids()) == 2
    with pytest.raises(Conflict):
        store.publish(docs, parent=v0)
    v2 = store.new_db()
    assert store.documents().count() == store.lists().count() == 0 and store.centroids() is None
    assert store.documents(v0).count() == 2
    v3 = store.publish(docs, parent=v2)
    assert store.retain(1) == [0, 1, 2] and store.head() == v3 and store.documents().count() == 2


def test_text_files_names(spark, tmp_path):
    from docsift.sources.files import read_text_files, write_text_files

    src = spark.createDataFrame([("portugal", "Lisbon [j] é"), ("SPAIN", "Madrid")], "name string, text string")
    write_text_files(src, str(tmp_path / "txt"))
    got = {r["name"]: r["text"] for r in read_text_files(spark, str(tmp_path / "txt")).collect()}
    assert got == {"Portugal": "Lisbon [j] é", "Spain": "Madrid"}


def test_stream_equals_batch_and_replay_is_noop(spark, tmp_path, docs_factory):
    from docsift.operators import mutate as M
    from docsift.operators.ann import build_ivf
    from docsift.operators.index import load_or_build
    from docsift.sources.json_docs import parse_json_documents
    from docsift.sources.store import Store
    from docsift.streaming.ingest import apply_batch, ingest

    docs = docs_factory([("a", "old", None), ("b", "keep", None)])
    files = [
        ['{"id": "a", "text": "a1", "ordinal": 1}', '{"id": "c", "text": "c1", "ordinal": 2}'],
        ['{"id": "a", "text": "a2"}', '{"text": "no id"}'],
        ['{"id": "c", "text": "c2", "metadata": {"n": 1}, "ordinal": 5}', "not json"],
    ]
    src, as_of = tmp_path / "in", "2024-06-01 00:00:00"
    store = Store(spark, str(tmp_path / "store"), buckets=4)
    store.publish(docs)
    emb = HashingEmbedder(16)
    load_or_build(store, emb)  # vectors for the initial load; ingest keeps them in sync
    ivf = build_ivf(store.vectors(), 2, seed=1)
    store.publish(parent=store.head(), lists=ivf.vectors, centroids=ivf.centroids, synced=True)
    for i, lines in enumerate(files):  # each run of the stream finds one new file
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(str(src / f"batch={i}"))
        ingest(spark, str(src), store, str(tmp_path / "ckpt"), as_of, embedder=emb)
    got = {r["id"]: (r["text"], dict(r["metadata"])) for r in store.documents().collect()}
    assert got == {"a": ("a2", {}), "b": ("keep", {}), "c": ("c2", {"n": "1"})}
    have, want = vec_map(store.vectors()), vec_map(rebuild(store.documents(), emb))
    assert have.keys() == want.keys() == vec_map(store.lists()).keys()
    assert all(np.array_equal(want[k], have[k]) and np.array_equal(want[k], vec_map(store.lists())[k]) for k in want)
    head = store.head()
    ingest(spark, str(src), store, str(tmp_path / "ckpt"), as_of, embedder=emb)  # nothing new
    assert store.head() == head
    # an edit in between doesn't make an old batch new again
    edited, _ = M.upsert(store.documents(head), spark.createDataFrame([("a", "edited")], "id string, text string"), as_of)
    store.publish(edited, parent=head)
    replay = spark.createDataFrame([('{"id": "a", "text": "WRONG"}',)], "value string")
    assert apply_batch(store, replay, head.batch_id, as_of, emb) is False
    assert {r["id"]: r["text"] for r in store.documents().collect()}["a"] == "edited"
    union = parse_json_documents(spark.createDataFrame([(x,) for f in files for x in f], "value string").coalesce(1))
    t, _ = M.upsert_batch(docs, union, as_of)
    assert {r["id"]: (r["text"], dict(r["metadata"])) for r in t.collect()} == got


def test_embed_documents_carries_hash(spark):
    docs = documents_from_testdata(spark, SF01).limit(20)
    v = embed_documents(docs, HashingEmbedder(16))
    assert v.columns == ["id", "embedding", "model", "text_hash"] and v.count() == 20


def test_load_or_build(spark, tmp_path):
    from docsift.operators.index import load_or_build
    from docsift.sources.store import Store

    store = Store(spark, str(tmp_path / "s"))
    docs = documents_from_testdata(spark, SF01).limit(50)
    store.publish(docs)
    emb = HashingEmbedder(16)
    v1 = load_or_build(store, emb)
    assert v1.count() == 50
    v2 = load_or_build(store, emb)  # nothing changed: same vectors
    assert vec_map(v1).keys() == vec_map(v2).keys()


def test_store_lookup_pushes_id_filter(spark, tmp_path):
    from docsift.operators.lookup import get_by_id
    from docsift.sources.store import Store

    store = Store(spark, str(tmp_path / "p"), buckets=4)
    store.publish(documents_from_testdata(spark, SF01))
    plan = store.document("42")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,42)" in plan and "PartitionFilters: [isnotnull(bucket" in plan
    assert store.document("42").count() == 1
    assert get_by_id(store.documents(), "42").count() == 1


def test_a_killed_publish_blocks_nothing(spark, tmp_path, docs_factory, monkeypatch):
    import os

    from docsift.sources.store import Conflict, Store

    store = Store(spark, str(tmp_path / "store"), buckets=4)
    v0 = store.publish(docs_factory([("a", "x", None)]))

    def killed(self, new):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:  # after the tables, before the pointer
        m.setattr(Store, "_point", killed)
        with pytest.raises(KeyboardInterrupt):
            store.publish(docs_factory([("a", "lost", None)]), parent=v0)
    os.makedirs(tmp_path / "store" / "v=1" / "documents")  # left by something else
    assert store.head() == v0 and store.document("a").first()["text"] == "x"
    v = store.publish(docs_factory([("a", "new", None)]), parent=v0)
    assert store.head() == v and store.document("a").first()["text"] == "new"
    with pytest.raises(Conflict):
        store.publish(docs_factory([("a", "late", None)]), parent=v0)
    folders = lambda: {f for f in os.listdir(tmp_path / "store") if f.startswith("documents")}
    assert len(folders()) == 3
    store.retain(1)
    assert len(folders()) == 2  # the unnamed folder may be of a publish under way
    store.retain(1, unnamed_after=0)
    assert folders() == {v.documents} and store.document("a").first()["text"] == "new"


def test_an_edit_assigns_only_what_changed(spark):
    from docsift.operators.ann import assign_lists, build_ivf, carry_lists

    rows = [(str(i), [float(i % 7), float(i % 5), 1.0]) for i in range(60)]
    vectors = spark.createDataFrame(rows, "id string, embedding array<float>")
    index = build_ivf(vectors, 5)
    edited = spark.createDataFrame([("3", [9.0, 9.0, 9.0]), ("new", [0.0, 0.0, 0.0])] + [r for r in rows if r[0] not in ("3", "8")], vectors.schema)
    lists, changed = carry_lists(edited, index.vectors, index.centroids)
    assert sorted(r.id for r in changed.collect()) == ["3", "new"]
    own = lambda df: sorted((r.id, r.list_id) for r in df.collect())
    assert own(lists) == own(assign_lists(edited, index.centroids))


def test_the_client_searches_with_the_fitted_lists(spark, tmp_path):
    import numpy as np

    from docsift.operators.embed import HashingEmbedder
    from docsift.plans.api import SearchEngine
    from docsift.sources.testdata import documents_from_testdata

    eng = SearchEngine(spark, str(tmp_path / "store"), HashingEmbedder(64), buckets=4)
    eng.store.publish(documents_from_testdata(spark, "/root/testdata/sf0.001"))
    eng.index.rebuild()
    exact = [[r.id for r in eng.search.semantic(q).collect()] for q in ("the and of", "der die das", "la casa")]
    index = eng.index.build_ivf()
    head = eng.store.head()
    assert head.nprobe == index.nprobe >= 1 and index.nlist == 14
    assert (eng.index.lists(head).sizes == np.bincount([r.list_id for r in eng.store.lists().collect()], minlength=14)).all()
    eng.documents.upsert("new", "the and of")
    assert eng.store.head().nprobe == index.nprobe and eng.index.lists(eng.store.head()).sizes.sum() == 201
    found = [[r.id for r in eng.search.semantic(q, ef_search=1).collect()] for q in ("the and of", "der die das", "la casa")]
    assert found[0][0] == "new" and all(len(f) == 10 for f in found)
    assert sum(len(set(a) & set(b)) for a, b in zip(found, exact, strict=True)) >= 20
    many = eng.documents.retrieve_many(["new", "7", "absent"]).collect()
    assert sorted(r.id for r in many) == ["7", "new"]
    assert {r.id: r.exists for r in eng.documents.exists(["new", "absent"]).collect()} == {"new": True, "absent": False}
    assert eng.documents.count_grouped().filter("key = 'lang'").agg(F.sum("count")).first()[0] == 200


def test_any_split_and_order_of_the_changes_gives_one_table(spark, tmp_path, docs_factory):
    import itertools
    import json

    from docsift.sources.store import Store
    from docsift.streaming.ingest import apply_batch

    changes = [("a", "newer", 5), ("a", "older", 3), ("b", "one", 1), ("b", "two", 2), ("c", "only", 0)]
    lines = [json.dumps({"id": i, "text": t, "ordinal": o}) for i, t, o in changes]
    frame = lambda some: spark.createDataFrame([(x,) for x in some], "value string")
    splits = [[lines], [lines[:1], lines[1:]], [lines[3:], lines[:3]], *([[x] for x in p] for p in list(itertools.permutations(lines))[::40])]
    for n, split in enumerate(splits):
        store = Store(spark, str(tmp_path / f"s{n}"), buckets=2)
        store.publish(docs_factory([("a", "first", None)]))
        for k, part in enumerate(split):
            assert apply_batch(store, frame(part), k, "2024-01-01 00:00:00")
            assert not apply_batch(store, frame(part), k, "2024-01-01 00:00:00")
        assert {r.id: r.text for r in store.documents().collect()} == {"a": "newer", "b": "two", "c": "only"}
        assert {r.id: r.ordinal for r in store.ordinals().collect()} == {"a": 5, "b": 2, "c": 0}
    # Without an ordinal a change is applied as it comes, and the state stays.
    apply_batch(store, frame([json.dumps({"id": "a", "text": "plain"})]), 99, "2024-01-01 00:00:00")
    apply_batch(store, frame([json.dumps({"id": "a", "text": "late", "ordinal": 4})]), 100, "2024-01-01 00:00:00")
    assert {r.id: r.text for r in store.documents().collect()}["a"] == "plain"
    store.new_db()
    assert store.ordinals().count() == 0


@pytest.mark.parametrize("dim", [768, 3072])
def test_pooling_of_long_vectors(spark, dim):
    import numpy as np

    from docsift.operators.pooling import mean_pool

    r = np.random.default_rng(dim)
    x = r.normal(size=(30, dim))
    rows = [(i % 4, int(i % 3 != 0), [float(v) for v in x[i]]) for i in range(30)] + [(9, 0, [float("nan")] * dim)]
    df = mean_pool(spark.createDataFrame(rows, "id int, mask int, vec array<double>"), dim)
    assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    got = {r.id: np.array(r.embedding) for r in df.collect()}
    for i in range(4):
        m = x[[j for j in range(30) if j % 4 == i and j % 3]].mean(axis=0)
        assert np.allclose(got[i], m / (np.linalg.norm(m) + 1e-12), atol=1e-6)
    assert not got[9].any()
