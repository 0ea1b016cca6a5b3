"""Adapters from the driver's parquet tables to the document / vector model."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.functions.text import text_hash

# A fixed load time, so results are repeatable and comparable with SQL.
AS_OF = "2024-01-01 00:00:00"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def as_of_col(as_of: str = AS_OF):
    return F.lit(as_of).cast("timestamp")


def documents_from_testdata(spark: SparkSession, sf_dir: str, as_of: str = AS_OF) -> DataFrame:
    """``documents`` -> [id, text, metadata{lang, source}, created_at, updated_at]."""
    d = read_table(spark, sf_dir, "documents")
    return d.select(
        d.doc_id.cast("string").alias("id"),
        d.text,
        F.map_from_arrays(
            F.array(F.lit("lang"), F.lit("source")), F.array(d.lang, d.source)
        ).alias("metadata"),
        as_of_col(as_of).alias("created_at"),
        as_of_col(as_of).alias("updated_at"),
        text_hash(d.text).alias("text_hash"),
    )


def metadata_long_from_testdata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long metadata rows straight from the columns (no map round trip)."""
    d = read_table(spark, sf_dir, "documents")
    doc_id = d.doc_id.cast("string").alias("document_id")
    return d.select(doc_id, F.lit("lang").alias("key"), d.lang.alias("value")).unionByName(
        d.select(doc_id, F.lit("source").alias("key"), d.source.alias("value"))
    )


def vectors_from_testdata(spark: SparkSession, sf_dir: str, model: str = "testdata") -> DataFrame:
    """``embeddings`` -> vectors table [id, embedding, model, text_hash]; ``label`` kept."""
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(
        e.vec_id.cast("string").alias("id"),
        e.embedding,
        F.lit(model).alias("model"),
        F.lit(None).cast("string").alias("text_hash"),
        e.label,
    )
