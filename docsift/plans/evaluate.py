"""Q4: retrieval evaluation over a query set, and recall of the approximate
search against the exact one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.operators.embed import embed_queries
from docsift.operators.knn import best_match


def retrieval_eval(docs: DataFrame, vectors: DataFrame, queries: DataFrame, embedder) -> DataFrame:
    """[query_id, id, similarity, hit]: best document per text query by
    cosine, and whether that document contains the query text verbatim."""
    q = embed_queries(queries, embedder)
    top = best_match(vectors, q)
    texts = docs.select("id", "text")
    qt = queries.select("query_id", F.col("query"))
    out = top.join(texts, "id").join(qt, "query_id")
    return out.select("query_id", "id", "similarity", (F.instr("text", F.col("query")) > 0).alias("hit"))


def recall_at_k(approx: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """[recall]: share of the exact top-k (query_id, id) pairs the
    approximate search found, over all queries."""
    e = exact.filter(F.col("rank") <= k).select("query_id", "id")
    a = approx.filter(F.col("rank") <= k).select("query_id", "id", F.lit(1).alias("_f"))
    j = e.join(a, ["query_id", "id"], "left")
    return j.agg((F.sum(F.coalesce("_f", F.lit(0))) / F.count(F.lit(1))).alias("recall"))
