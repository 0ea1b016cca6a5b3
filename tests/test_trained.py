import numpy as np
from pyspark.sql import functions as F

from docsift.operators.embed_svd import SvdEmbedder
from docsift.operators.pq import PqIndex, encode, tables, train_books


def test_codes_estimate_distances():
    r = np.random.default_rng(2)
    x, q = r.normal(size=(3000, 10)), r.normal(size=(5, 10))
    books = train_books(x, 4)  # 10 dimensions in parts of 3: filled with zeros
    code, table = encode(x, books), tables(q, books)
    near = sum(table[:, p][:, code[:, p]] for p in range(4))
    flat = np.concatenate([books[p][code[:, p]] for p in range(4)], axis=1)[:, :10]
    assert np.allclose(near, ((q[:, None] - flat[None]) ** 2).sum(axis=2))
    exact = ((q[:, None] - x[None]) ** 2).sum(axis=2)
    assert np.corrcoef(near.ravel(), exact.ravel())[0, 1] > 0.97


def test_shortlist_reaches_the_recall(spark):
    from docsift.operators.ann import build_ivf
    from docsift.operators.knn import knn

    r = np.random.default_rng(3)
    c = r.normal(size=(40, 16))
    for n in (600, 2400):
        x = c[r.integers(40, size=n)] + 0.4 * r.normal(size=(n, 16))
        vectors = spark.createDataFrame([(f"{i:05d}", [float(v) for v in row]) for i, row in enumerate(x)], "id string, embedding array<float>")
        index = PqIndex.build(build_ivf(vectors, int(n**0.5)))
        index = index.fit(k=10, recall=0.92, sample=200)
        queries = vectors.filter(F.col("id") % 7 == 0).select(F.col("id").alias("query_id"), "embedding")
        exact = {(h.query_id, h.id): round(h.dist, 6) for h in knn(vectors, queries, 10).collect()}
        got = {(h.query_id, h.id): round(h.dist, 6) for h in index.search(queries, 10).collect()}
        assert len(got) == len(exact)
        same = [k for k in exact if k in got]
        assert len(same) >= 0.9 * len(exact) and all(exact[k] == got[k] for k in same)
        assert index.shortlist < n / 5
        plan = index.search(queries.limit(1), 3)._jdf.queryExecution().executedPlan().toString()
        assert "list_id" in plan.split("PartitionFilters")[-1] or "list_id" in plan


def test_trained_embedder(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    rows = [(str(i), "common words of all " * 5 + " ".join(rng.choice(words, 12))) for i in range(300)] + [("e", ""), ("n", "É ü")]
    docs = spark.createDataFrame(rows, "id string, text string").repartition(5)
    one, two = SvdEmbedder.fit(docs, 32, buckets=512, components=8), SvdEmbedder.fit(docs.repartition(3), 32, buckets=512, components=8)
    assert np.allclose(one.projection, two.projection, atol=1e-6) and one.model == two.model
    # The leading directions are those of the full decomposition.
    table = {r.id: np.array(r.embedding) for r in one.embed(docs).collect()}
    assert len(table) == 302 and not table["e"].any() and not table["n"].any()
    assert all(abs(np.linalg.norm(v) - 1) < 1e-5 for k, v in table.items() if k not in "en")
    query = spark.createDataFrame([(i, " ".join(t.split()[-6:])) for i, t in rows[:60]], "query_id string, query string")
    found = {r.query_id: np.array(r.embedding) for r in one.embed(query, key="query_id", text="query").collect()}
    names = [i for i, _ in rows[:300]]
    every = np.array([table[i] for i in names])
    hits = np.mean([names[int((every @ v).argmax())] == i for i, v in found.items()])
    assert hits > 0.5
    assert SvdEmbedder.fit(docs.limit(0), 8, buckets=64).embed(docs).count() == 302
