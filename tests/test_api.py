"""The client call surface over the store (each call a Spark plan)."""

import datetime as dt

from docsift.operators.embed import HashingEmbedder
from docsift.plans.api import SearchEngine


def test_client_surface(spark, tmp_path):
    clock = lambda: dt.datetime(2024, 6, 1)
    eng = SearchEngine(spark, str(tmp_path / "eng"), HashingEmbedder(32), buckets=4, clock=clock)
    eng.store.new_db()
    rep = eng.documents.create_batch(
        [
            {"id": "pt", "text": "Portugal is a country in Europe", "metadata": {"region": "europe"}},
            {"id": "jp", "text": "Japan is an island country in East Asia", "metadata": {"region": "asia", "n": 1}},
            {"id": "mn", "text": "Mongolia is a landlocked country", "metadata": {"region": "asia"}},
        ]
    )
    assert {r["status"] for r in rep.collect()} == {"inserted"}
    assert eng.documents.total_count() == 3
    assert {r["status"] for r in eng.documents.create("dup", id="pt").collect()} == {"exists"}
    v = eng.store.head().version
    rep = eng.documents.create_batch([{"id": "pt", "text": "again"}, {"id": "new", "text": "n"}])
    assert {r["status"] for r in rep.collect()} == {"rolled_back"}
    assert eng.store.head().version == v  # nothing published
    new = eng.documents.create("A text without an id").collect()
    assert new[0]["status"] == "inserted" and new[0]["id"].startswith("doc_")
    assert eng.documents.count("region", "asia") == 2 and eng.documents.count("region") == 4
    assert [r["id"] for r in eng.documents.list("region", "asia").collect()] == ["jp", "mn"]
    r = eng.documents.retrieve("jp").first()
    assert dict(r["metadata"]) == {"region": "asia", "n": "1"}
    eng.documents.update("pt", "Portugal borders Spain")  # metadata cleared
    assert dict(eng.documents.retrieve("pt").first()["metadata"]) == {}
    eng.documents.put_metadata("pt", "region", "europe")
    assert dict(eng.documents.retrieve("pt").first()["metadata"]) == {"region": "europe"}
    assert {r["id"]: r["status"] for r in eng.documents.delete("mn").collect()} == {"mn": "deleted"}
    assert eng.documents.delete("mn").first()["status"] == "not_found"
    h = eng.health().first().asDict()
    assert h["documents"] == 3 and h["vectors"] == 3 and h["missing"] == h["orphans"] == h["stale"] == 0
    top = eng.search.semantic("Portugal borders Spain", k=1).first()
    assert top["id"] == "pt" and abs(top["score"] - 1.0) < 1e-6
    assert [r["id"] for r in eng.search.fulltext("country", k=10).collect()] == ["jp"]
    assert [r["id"] for r in eng.search.by_metadata("region", "asia").collect()] == ["jp"]
    eng.index.build_ivf(2, seed=1)
    eng.documents.upsert("kr", "Korea is in East Asia")
    assert sorted(r["id"] for r in eng.store.lists().collect()) == sorted(r["id"] for r in eng.vectors().collect())
    ann = eng.search.query("Korea is in East Asia", k=1, ef_search=10**6).first()
    assert ann["id"] == "kr"
    probe = eng.store.lists().filter("list_id IN (0)")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in probe and "list_id" in probe
    eng.index.rebuild()
    assert eng.store.lists().count() == eng.vectors().count() == 4
    one, two = (eng.documents.create("the same text").first()["id"] for _ in range(2))
    assert one != two and eng.documents.total_count() == 6
    eng.store.new_db()
    assert eng.search.semantic("Korea").count() == 0
