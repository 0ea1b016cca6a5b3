"""Masked mean pooling of token vectors, then L2 normalisation.

Token rows [id, mask, vec] (one row per token) are pooled per id with one vector-valued
aggregate in the JVM (``Summarizer``), so the plan has the same size for any dimension. It is
partial (map-side): an id holding a huge share of the rows is summed in pieces, never gathered
in one task. Masked rows add nothing, even when their values are wild (NaN or infinite); an id
whose tokens are all masked pools to the zero vector, with no NaN. A vector of another length
than ``dim`` fails the job.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.schema import NORM_EPS


def mean_pool(tokens: DataFrame, dim: int, key: str = "id", vec: str = "vec", mask: str = "mask") -> DataFrame:
    """[key, mask, vec array] -> [key, embedding array<float>] (pooled + normalised)."""
    on = F.col(mask) != 0
    wrong = F.raise_error(F.concat(F.lit(f"a vector isn't of length {dim}: "), F.size(vec).cast("string"))).cast("array<double>")
    given = F.when(F.size(vec) == dim, F.col(vec).cast("array<double>")).otherwise(wrong)
    zeros = F.array_repeat(F.lit(0.0), dim)
    # A masked vector's length is checked before its values are set to 0.
    live = F.when(on, given).otherwise(F.when(F.size(given) == dim, zeros))
    tokens = tokens.select(F.col(key), F.when(on, 1).otherwise(0).alias("_on"), array_to_vector(live).alias("_v"))
    agg = tokens.groupBy(key).agg(F.sum("_on").alias("_n"), Summarizer.sum(F.col("_v")).alias("_s"))
    n = F.greatest(F.col("_n"), F.lit(1)).cast("double")
    pooled = agg.select(F.col(key), n.alias("_n"), vector_to_array("_s").alias("_s"))
    pooled = pooled.select(F.col(key), F.transform("_s", lambda x: x / F.col("_n")).alias("_m"))
    pooled = pooled.withColumn(
        "_norm", F.sqrt(F.aggregate("_m", F.lit(0.0).cast("double"), lambda a, x: a + x * x)) + F.lit(NORM_EPS)
    )
    return pooled.select(
        F.col(key), F.transform("_m", lambda x: (x / F.col("_norm")).cast("float")).alias("embedding")
    )
