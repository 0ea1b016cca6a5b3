"""Shared helpers of the training-data operators: scratch tables in the shared
folder, connected components as joins, and 64-bit mixing for numpy."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
# splitmix64 finaliser (fixed values)
_M1 = U64(0xBF58476D1CE4E5B9)
_M2 = U64(0x94D049BB133111EB)
_ODD = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over an array of unsigned 64-bit integers."""
    x = x ^ (x >> U64(30))
    x = x * _M1
    x = x ^ (x >> U64(27))
    x = x * _M2
    return x ^ (x >> U64(31))


def chain(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Order-sensitive hash of two hashes."""
    return mix(left * _ODD + right)


def seed(n: int) -> np.uint64:
    return mix(np.array([n + 1], dtype=U64) * _ODD)[0]


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: what the session names
    in ``spark.checkpoint.dir`` (or what was set on the context). Only a local
    session without either gets a temporary one."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="docsift-llm-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/docsift-llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as a zstd table in the shared folder, reread, and its path.

    Cuts the lineage: a lost executor costs a reread, not a recomputation."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def checkpointed(df: DataFrame) -> DataFrame:
    """Eager reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that nothing will read again."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def text_key() -> Column:
    """Hash of the column ``text``; null counts as empty."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def matching(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, hash of text) is in ``keys (doc_id, tkey)``
    (``how`` = left_semi) or isn't (left_anti); a null id equals a null id."""
    mine = F.struct(F.col("d.doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce("d.text", F.lit(""))).alias("t"))
    theirs = F.struct(F.col("k.doc_id").alias("id"), F.col("k.tkey").alias("t"))
    return docs.alias("d").join(keys.alias("k"), mine.eqNullSafe(theirs), how)


def free_name(name: str, taken: list[str]) -> str:
    """``name`` with underscores until it clashes with none of ``taken``."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges (a, b)``: ``(node, root)`` with the least
    node of each component as root, for every node that has an edge.

    Alternating large-star and small-star steps (Kiveris et al., 2014). Every step
    is a grouped minimum and a join; a hub's edges are never gathered in one row.
    The minima are written before the join: of two plain sides AQE splits a hub's.
    Each round is checkpointed, so lineage stays short."""
    spark = edges.sparkSession
    star = checkpointed(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    while True:
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low, least_at = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large, large_at = written(large.where("u <> v").distinct(), "large-star")
        low, low_at = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                      F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u <> v").distinct()
        )
        after = checkpointed(small)
        remove(spark, least_at, large_at, low_at)
        # Stars are stable: no node is both a leaf and a root, and no leaf has two roots.
        ends = after.select(F.col("u").alias("x"), F.lit(1).alias("leaf"), F.lit(0).alias("root"))
        ends = ends.unionByName(after.select(F.col("v").alias("x"), F.lit(0).alias("leaf"), F.lit(1).alias("root")))
        unstable = ends.groupBy("x").agg(F.sum("leaf").alias("leaf"), F.max("root").alias("root")).where("leaf + root > 1 and leaf > 0")
        star = after
        if unstable.isEmpty():
            break
    leaves = star.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(star.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
