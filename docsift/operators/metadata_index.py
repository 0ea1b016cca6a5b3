"""F4 J1 A2 T4 through a clustered table of metadata rows (key, value, id).

Rows lie in folders by a hash of (key, value), sorted by key, value and id; AQE cuts the folder of a
hot value into several files. A lookup reads one folder's rows of its key and value (the folder
by partition, the rows by pushed filters), so a count reads no document, and the first k matches
in id order cost k texts. ``after`` gives the table after edits: rows of changed documents are
replaced, others are kept."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsift.operators.metadata import explode_metadata
from docsift.schema import TEXT_SCORE, check_k

BUCKETS = 256
SCHEMA = "key string, value string, id string, bucket int"


@dataclass
class MetadataIndex:
    spark: SparkSession
    path: str
    buckets: int = BUCKETS

    @staticmethod
    def _rows(docs: DataFrame) -> DataFrame:
        return explode_metadata(docs).select("key", "value", F.col("document_id").alias("id"))

    def _bucket(self, key, value):
        return F.pmod(F.xxhash64(key, value), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame) -> MetadataIndex:
        rows = rows.select("key", "value", "id", self._bucket("key", "value").alias("bucket"))
        rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "key", "value", "id").write.partitionBy("bucket").parquet(self.path)
        return self

    @staticmethod
    def build(docs: DataFrame, path: str, buckets: int = BUCKETS) -> MetadataIndex:
        """Index the metadata of ``docs [id, metadata]`` in the folder ``path``."""
        return MetadataIndex(docs.sparkSession, path, buckets)._write(MetadataIndex._rows(docs))

    def after(self, changed: DataFrame, docs: DataFrame, path: str) -> MetadataIndex:
        """The table, in the folder ``path``, after the documents ``changed [id]`` were edited, inserted or
        deleted; ``docs`` are the documents afterwards, of which the changed ones alone are exploded."""
        ids = changed.select("id").distinct()
        kept = self.rows().select("key", "value", "id").join(ids, "id", "left_anti")
        fresh = self._rows(docs.join(ids, "id", "left_semi").select("id", "metadata"))
        return MetadataIndex(self.spark, path, self.buckets)._write(kept.unionByName(fresh))

    def rows(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def ids(self, key: str, value: str) -> DataFrame:
        """[id] of the documents with ``metadata[key] == value``."""
        mine = (F.col("key") == key) & (F.col("value") == value)
        return self.rows().filter((F.col("bucket") == self._bucket(F.lit(key), F.lit(value))) & mine).select("id")

    def count(self, key: str, value: str) -> DataFrame:
        """A2: one row [count]."""
        return self.ids(key, value).agg(F.count(F.lit(1)).alias("count"))

    def count_grouped(self) -> DataFrame:
        """A2 grouped: [key, value, count]."""
        return self.rows().groupBy("key", "value").agg(F.count(F.lit(1)).alias("count"))

    def matches(self, docs: DataFrame, key: str, value: str) -> DataFrame:
        """The matching documents [id, text, metadata]."""
        return docs.select("id", "text", "metadata").join(self.ids(key, value), "id", "left_semi")

    def search(self, docs: DataFrame, key: str, value: str, k: int = 10) -> DataFrame:
        """The first k matches in id order, score 1.0: [rank, id, text, score, metadata]."""
        first = self.ids(key, value).orderBy("id").limit(check_k(k))
        ranked = first.withColumn("rank", F.row_number().over(Window.orderBy("id")))  # k rows
        found = docs.select("id", "text", "metadata").join(F.broadcast(ranked), "id")
        return found.select("rank", "id", "text", F.lit(TEXT_SCORE).alias("score"), "metadata").orderBy("rank")
