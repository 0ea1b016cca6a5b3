"""F3 under edits: any series of edits leaves what the plain search finds in the documents."""

import random

from docsift.operators.text_search import text_matches, text_search
from docsift.operators.trigram_segments import SegmentedTrigrams

WORDS = ["Then", "thEn", "north", "École", "100%", "a_b", "\U0001f600smile", "x", "", "naïve", "The"]
SCHEMA = "id string, text string, metadata map<string,string>"


def frame(spark, docs):
    return spark.createDataFrame([(i, t, {"n": t[:3]}) for i, t in docs.items()], SCHEMA)


def assert_plain(spark, index, docs):
    plain = frame(spark, docs)
    assert sorted(map(tuple, index.documents().select("id", "text").collect())) == sorted(docs.items())
    for query in ("then", "École n", "%", "x"):
        assert sorted(index.matches(query).collect(), key=str) == sorted(text_matches(plain, query).select("id", "text", "metadata").collect(), key=str)
    assert index.search("the", 4).collect() == text_search(plain, "the", 4).collect()
    assert index.search("the", 4, 1.5).count() == 0


def test_a_series_of_edits(spark, tmp_path):
    r = random.Random(3)
    text = lambda: " ".join(r.choices(WORDS, k=r.randrange(0, 9)))
    docs = {str(i): text() for i in range(160)}
    index = SegmentedTrigrams.build(frame(spark, docs), str(tmp_path / "t"), buckets=3, chunk=16, block=64)
    before, then = index, dict(docs)
    seen = []
    for size in (30, 3, 3, 9):
        ids = [str(r.randrange(200)) for _ in range(size)]
        for i in set(ids):
            if r.random() < 0.3:
                docs.pop(i, None)
            else:
                docs[i] = text()
        changed = spark.createDataFrame([(i,) for i in [*ids, ids[0], None, "never there"]], "id string")
        index = index.after(changed, frame(spark, docs))
        seen.append(len(index.segments))
        assert all(b.rows * 2 < a.rows for a, b in zip(index.segments, index.segments[1:], strict=False))
    assert max(seen) > 1
    assert_plain(spark, index, docs)
    assert_plain(spark, before, then)
    one = index.compacted()
    assert len(one.segments) == 1 and one.segments[0].rows == len(docs)
    assert_plain(spark, one, docs)


def test_no_change_and_no_documents(spark, tmp_path):
    index = SegmentedTrigrams.build(frame(spark, {"a": "then"}).limit(0), str(tmp_path / "t"))
    none = spark.createDataFrame([], "id string")
    assert index.after(none, frame(spark, {"a": "then"})) is index
    index = index.after(spark.createDataFrame([("a",)], "id string"), frame(spark, {"a": "then"}))
    assert [x.id for x in index.search("HEN").collect()] == ["a"]
    index = index.after(spark.createDataFrame([("a",)], "id string"), frame(spark, {"a": "then"}).limit(0))
    assert index.search("hen").count() == 0 and index.documents().count() == 0


def test_an_edit_indexes_only_what_changed(spark, tmp_path):
    docs = {str(i): f"text number {i}" for i in range(300)}
    index = SegmentedTrigrams.build(frame(spark, docs), str(tmp_path / "t"), chunk=64, block=256)
    docs["7"] = "a new one"
    after = index.after(spark.createDataFrame([("7",)], "id string"), frame(spark, docs))
    assert after.segments[0] == index.segments[0] and [s.rows for s in after.segments] == [300, 1]
    assert after.index(after.segments[1]).texts().count() == 1
    assert [x.id for x in after.matches("new one").collect()] == ["7"] and after.matches("number 7").where("id = '7'").count() == 0


def test_the_client_keeps_the_index_in_step(spark, tmp_path):
    from docsift.operators.embed import HashingEmbedder
    from docsift.plans.api import SearchEngine

    eng = SearchEngine(spark, str(tmp_path / "store"), HashingEmbedder(8), buckets=2)
    eng.store.new_db()
    eng.documents.create_batch([{"id": str(i), "text": f"hay {i}", "metadata": {"n": i}} for i in range(40)])
    eng.index.build_trigrams()
    eng.documents.upsert_batch([{"id": "3", "text": "a needle", "metadata": {"n": "x"}}, {"id": "new", "text": "NEEDLE and hay 77"}])
    eng.documents.delete("5")
    eng.documents.put_metadata("7", "k", "v")
    head = eng.store.head()
    assert len(head.trigrams) > 1 and sum(s["rows"] for s in head.trigrams[1:]) <= 4
    rows = lambda df: [(r["id"], r["text"], r["score"], r["metadata"]) for r in df.collect()]
    for query in ("needle", "hay", "hay 7", "y"):
        assert rows(eng.search.fulltext(query, k=50)) == rows(text_search(eng.docs(), query, 50))
    kept = eng.store.retain(1, unnamed_after=0)
    assert kept and rows(eng.search.fulltext("needle")) == rows(text_search(eng.docs(), "needle"))
    assert {p.name for p in (tmp_path / "store").glob("segment-*")} == {s["name"] for s in head.trigrams}
    eng.store.new_db()
    assert eng.store.head().trigrams is None and eng.search.fulltext("hay").count() == 0
