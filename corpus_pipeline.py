"""The corpus pipeline: every stage takes (spark, docs, sf_dir) and returns a DataFrame,
written as Parquet and reread as the next stage's ``docs``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.llm.common import free_name, remove, scratch
from docsift.llm.decontam import decontaminate
from docsift.llm.jaccard import one_of_each_group
from docsift.llm.mixture import mix_sources
from docsift.llm.quality import keep_good
from docsift.llm.queries import tokenizer_file
from docsift.llm.token_files import read_tokens, write_tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_good(docs, _table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the least doc_id."""
    return one_of_each_group(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that all sources weigh alike, in shuffled order."""
    return mix_sources(docs).select(docs.columns)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture's token files, read back: a row a document. They are in an order of their own
    for each copy, a hash of its id and its place in ``docs``: a uniform shuffle of the mixture."""
    path, key = scratch(spark, "token-files"), free_name("order", docs.columns)
    shuffled = docs.withColumn(key, F.xxhash64("doc_id", F.monotonically_increasing_id()))
    write_tokens(shuffled, path, tokenizer_file(), order=key)
    return read_tokens(spark, path, with_ids=False)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixture", source_mixture),
    ("token_files", token_files),
]

# Chosen paths and byte-pair encoding have no SQL form; tests/llm holds the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to ``documents``; a stage's table goes when the next has read it."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            remove(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
