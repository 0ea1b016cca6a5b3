"""V1-V4: vector expressions as Spark higher-order functions.

These run inside the JVM for any number of rows; they are the small-input and
cross-check path. Bulk nearest-neighbour work uses numpy over Arrow batches
(``docsift.operators.knn``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docsift.schema import NORM_EPS


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def squared_l2(a, b) -> Column:
    """V1: sum((a_i - b_i)^2) in double."""
    a, b = _col(a), _col(b)
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def dot(a, b) -> Column:
    """V4: inner product in double."""
    a, b = _col(a), _col(b)
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a) -> Column:
    a = _col(a)
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine_similarity(a, b) -> Column:
    """V4: dot / (|a| |b|); 0 when either side is the zero vector, as in ``best_match``."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def score_from_distance(dist) -> Column:
    """V2: score = 1 / (1 + squared L2 distance)."""
    return F.lit(1.0) / (F.lit(1.0) + _col(dist))


def l2_normalize(a, norm_col=None, eps: float = NORM_EPS) -> Column:
    """V3: x / (|x| + eps), float result; the zero vector stays zero.

    Pass ``norm_col`` (a column already holding |a|) to avoid recomputing the
    norm per element inside the lambda.
    """
    a = _col(a)
    n = norm(a) if norm_col is None else _col(norm_col)
    return F.transform(a, lambda x: (x.cast("double") / (n + F.lit(eps))).cast("float"))
