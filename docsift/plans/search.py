"""The search call and its three retrieval modes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsift.operators import knn as knn_ops
from docsift.operators.embed import embed_queries
from docsift.operators.metadata import metadata_equals
from docsift.operators.text_search import text_search
from docsift.schema import DEFAULT_EF_SEARCH, DEFAULT_K, DEFAULT_TYPE, TEXT_SCORE, TEXT_TYPES, check_k


def drop_orphans(vectors: DataFrame, docs: DataFrame) -> DataFrame:
    """Vectors whose id has a document, kept before ranking."""
    return vectors.join(docs.select("id"), "id", "left_semi")


def fetch_documents(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """Attach text and metadata to ranked hits [query_id, id, ...]. Hits whose id has no
    document are dropped (the reference would return an empty one)."""
    return hits.join(docs.select("id", "text", "metadata"), "id")


def _results(joined: DataFrame, with_query: bool) -> DataFrame:
    cols = (["query_id"] if with_query else []) + ["rank", "id", "text", "score", "metadata"]
    return joined.select(*cols)


def search_vectors(docs: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = DEFAULT_K, threshold: float = 0.0,
                   check_orphans: bool = True) -> DataFrame:
    """Q2 for many query vectors [query_id, embedding]:
    T2 -> V2 -> F5 -> J2. Returns [query_id, rank, id, text, score, metadata]."""
    corpus = drop_orphans(vectors, docs) if check_orphans else vectors
    hits = knn_ops.knn(corpus, queries, check_k(k), threshold)
    return _results(fetch_documents(docs, hits), True)


def search_vector(docs: DataFrame, vectors: DataFrame, vector, k: int = DEFAULT_K, threshold: float = 0.0,
                  check_orphans: bool = True) -> DataFrame:
    """Q2: one query vector -> [rank, id, text, score, metadata], best first."""
    corpus = drop_orphans(vectors, docs) if check_orphans else vectors
    hits = knn_ops.knn_vector(corpus, vector, check_k(k), threshold)
    return _results(fetch_documents(docs, hits), False).orderBy("rank")


def search_texts(docs: DataFrame, vectors: DataFrame, queries: DataFrame, embedder, k: int = DEFAULT_K, threshold: float = 0.0,
                 ef_search: int = DEFAULT_EF_SEARCH, index=None, check_orphans: bool = True) -> DataFrame:
    """Q1 for many text queries [query_id, query]: exact, or approximate when an ``index``
    (K3) is given, in which each query probes the index's ``nprobe`` lists (``fit_nprobe``) and
    ``ef_search`` rows or more."""
    q = embed_queries(queries, embedder)
    if index is None:
        return search_vectors(docs, vectors, q, k, threshold, check_orphans)
    from docsift.operators.ann import IvfIndex, ann_search

    if check_orphans:
        live = drop_orphans(index.vectors, docs)  # fewer rows in a list: count again, so that k are found
        index = IvfIndex.over(live, index.centroids, index.nprobe)
    return _results(fetch_documents(docs, ann_search(index, q, check_k(k), threshold, index.nprobe, ef_search)), True)


def semantic_search(docs: DataFrame, vectors: DataFrame, query: str, embedder, k: int = DEFAULT_K, threshold: float = 0.0,
                    ef_search: int = DEFAULT_EF_SEARCH, index=None, check_orphans: bool = True) -> DataFrame:
    """Q1 for one text -> [rank, id, text, score, metadata], best first."""
    one = docs.sparkSession.createDataFrame([("q", query)], "query_id string, query string")
    found = search_texts(docs, vectors, one, embedder, k, threshold, ef_search, index, check_orphans)
    return found.drop("query_id").orderBy("rank")


def metadata_search(docs: DataFrame, key, value, k: int = DEFAULT_K) -> DataFrame:
    """Metadata mode: first k matches in id order, score 1.0; a filter without both key and
    value gives no rows. Ids are ranked first; texts are read for the k of them."""
    k = check_k(k)
    if key is None or value is None:
        matches = docs.filter(F.lit(False))
    else:
        matches = metadata_equals(docs, key, value)
    first = _with_rank(matches.select("id", "metadata").orderBy("id").limit(k))  # k rows
    found = F.broadcast(first).join(docs.select("id", "text"), "id")
    return found.select("rank", "id", "text", F.lit(TEXT_SCORE).alias("score"), "metadata").orderBy("rank")


def _with_rank(hits: DataFrame) -> DataFrame:
    # The caller's limit of k rows bounds this window's one task.
    return hits.withColumn("rank", F.row_number().over(Window.orderBy("id")))


def search(
    docs: DataFrame,
    vectors: DataFrame | None,
    query: str | None,
    k: int = DEFAULT_K,
    type: str = DEFAULT_TYPE,  # noqa: A002 - the reference's field name
    metadata: dict | None = None,
    threshold: float = 0.0,
    ef_search: int = DEFAULT_EF_SEARCH,
    embedder=None,
    index=None,
    check_orphans: bool = True,
    trigrams=None,
) -> DataFrame:
    """Q3: the dispatcher. A metadata filter replaces the search (query, type and threshold
    ignored); then ``text``/``fulltext``; any other type is semantic. Returns
    [rank, id, text, score, metadata].

    ``check_orphans=False`` when the vectors are known to be those of the documents. A text
    search goes through the ``trigrams`` of the documents, if given."""
    if query is None:
        raise ValueError("Missing 'query' field")
    k = check_k(k)
    if metadata is not None:
        return metadata_search(docs, metadata.get("key"), metadata.get("value"), k)
    if type in TEXT_TYPES:
        hits = text_search(docs, query, k, threshold) if trigrams is None else trigrams.search(query, k, threshold)
        return _with_rank(hits).select("rank", "id", "text", "score", "metadata")
    if embedder is None:
        raise ValueError("semantic search needs an embedder")
    return semantic_search(docs, vectors, query, embedder, k, threshold, ef_search, index, check_orphans)


def preview(results: DataFrame, chars: int = 200, decimals: int = 4) -> DataFrame:
    """P5: text preview and rounded score for display."""
    return results.withColumn("text", F.substring("text", 1, chars)).withColumn("score", F.round("score", decimals))
