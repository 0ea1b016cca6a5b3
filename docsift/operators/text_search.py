"""Substring search with SQL LIKE semantics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.functions.text import like_contains
from docsift.schema import TEXT_SCORE, check_k


def text_matches(docs: DataFrame, query: str) -> DataFrame:
    """Every document whose text contains ``query`` (LIKE '%q%': '%' and '_'
    are live wildcards, '\\' is plain, ASCII letters fold case, others don't)."""
    return docs.filter(like_contains("text", query))


def text_search(docs: DataFrame, query: str, k: int = 10, threshold: float = 0.0) -> DataFrame:
    """F3 + T3 + P6 + F5: first k matches in id order, score 1.0.

    The threshold applies after the limit, so a threshold above 1 gives no rows.
    """
    k = check_k(k)
    hits = text_matches(docs, query).select("id", "text", "metadata").orderBy("id").limit(k)
    hits = hits.withColumn("score", F.lit(TEXT_SCORE))
    if threshold > TEXT_SCORE:
        hits = hits.filter(F.lit(False))
    return hits.select("id", "text", "score", "metadata")
