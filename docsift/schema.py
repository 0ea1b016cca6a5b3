"""Table schemas and fixed constants of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values that must equal the reference's behaviour.
DEFAULT_K = 10
DEFAULT_EF_SEARCH = 200
TOKEN_LIMIT = 256
LIST_CAP = 1000
NORM_EPS = 1e-12
TEXT_SCORE = 1.0
DEFAULT_TYPE = "semantic"
TEXT_TYPES = ("text", "fulltext")

META_TYPE = T.MapType(T.StringType(), T.StringType(), valueContainsNull=False)
VECTOR_TYPE = T.ArrayType(T.FloatType(), containsNull=False)

DOCUMENTS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("text", T.StringType(), False),
        T.StructField("metadata", META_TYPE, False),
        T.StructField("created_at", T.TimestampType(), True),
        T.StructField("updated_at", T.TimestampType(), True),
        # Hash of the text, written with it, so that drift reads no text.
        T.StructField("text_hash", T.StringType(), True),
    ]
)

VECTORS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("embedding", VECTOR_TYPE, False),
        T.StructField("model", T.StringType(), True),
        T.StructField("text_hash", T.StringType(), True),
    ]
)

DOC_COLUMNS = ["id", "text", "metadata", "created_at", "updated_at", "text_hash"]
VEC_COLUMNS = ["id", "embedding", "model", "text_hash"]


def check_k(k: int) -> int:
    if k is None or int(k) < 1:
        raise ValueError(f"k must be >= 1, got {k!r}")
    return int(k)
