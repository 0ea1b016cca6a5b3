"""Scans, lookups, ordering and counts by id."""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def list_all(docs: DataFrame) -> DataFrame:
    """S3 + T1: every document, ordered by id (binary string order)."""
    return docs.select("id", "text", "metadata").orderBy("id")


def list_ids(docs: DataFrame) -> DataFrame:
    """Ids only (the scan reads one column)."""
    return docs.select("id").orderBy("id")


def _ids_frame(docs: DataFrame, ids) -> DataFrame:
    if isinstance(ids, DataFrame):
        return ids.select(F.col(ids.columns[0]).cast("string").alias("id"))
    ids = [str(i) for i in ids]
    return docs.sparkSession.createDataFrame([(i,) for i in ids], "id string")


def get_by_id(docs: DataFrame, doc_id: str) -> DataFrame:
    """zero or one row (the filter on id reaches the parquet scan)."""
    return docs.filter(F.col("id") == F.lit(str(doc_id))).select("id", "text", "metadata")


def get_by_ids(docs: DataFrame, ids: DataFrame | Iterable[str]) -> DataFrame:
    """F1 for many ids: a left-semi join, duplicates in ``ids`` ignored."""
    return docs.join(_ids_frame(docs, ids), "id", "left_semi").select("id", "text", "metadata")


def exists_flags(docs: DataFrame, ids: DataFrame | Iterable[str]) -> DataFrame:
    """[id, exists] for each distinct requested id."""
    want = _ids_frame(docs, ids).distinct()
    found = docs.select("id").join(want, "id", "left_semi").withColumn("exists", F.lit(True))
    return want.join(found, "id", "left").select("id", F.coalesce("exists", F.lit(False)).alias("exists"))


def count_all(docs: DataFrame) -> DataFrame:
    """A1: one row, one column ``count``."""
    return docs.agg(F.count(F.lit(1)).alias("count"))
