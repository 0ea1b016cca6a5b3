"""Documents as JSON lines ``{"text": ..., "id": ..., "metadata": {...}}``.

A line is parsed once, to a variant; fields are typed from it. ``text`` and ``id`` must be
strings and ``metadata`` an object. What is wrong with a line is in ``_invalid``, which
validation turns into a rejected row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.functions.json import metadata_map


def parse_json_documents(lines: DataFrame, col: str = "value") -> DataFrame:
    """[value] -> [id, text, metadata, ordinal, _invalid]. ``ordinal`` is NULL when not given."""
    field = lambda name: F.expr(f"try_variant_get(_v, '$.{name}', 'variant')")
    df = lines.select(F.try_parse_json(F.col(col)).alias("_v"))
    df = df.select("_v", *(field(n).alias(f"_{n}") for n in ("id", "text", "metadata")))
    kind = lambda n: F.schema_of_variant(f"_{n}")
    invalid = (
        F.when(F.col("_v").isNull(), "Malformed JSON")
        .when(~F.schema_of_variant("_v").startswith("OBJECT"), "Invalid request: must be a JSON object")
        .when(F.col("_text").isNull(), "Missing 'text' field")
        .when(kind("text") != "STRING", "Invalid 'text': must be a string")
        .when(kind("id") != "STRING", "Invalid 'id': must be a string")
    )
    df = df.withColumn("metadata", metadata_map(F.col("_metadata")))
    bad_metadata = F.col("_metadata").isNotNull() & (kind("metadata") != "VOID") & F.col("metadata").isNull()
    return df.select(
        F.when(kind("id") == "STRING", F.col("_id").try_cast("string")).alias("id"),
        F.when(kind("text") == "STRING", F.col("_text").try_cast("string")).alias("text"),
        "metadata",
        F.expr("try_variant_get(_v, '$.ordinal', 'bigint')").alias("ordinal"),
        F.coalesce(invalid, F.when(bad_metadata, "Invalid 'metadata': must be a JSON object of unique keys")).alias("_invalid"),
    )


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    return parse_json_documents(spark.read.text(path))
