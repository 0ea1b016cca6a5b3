"""Text helpers: ASCII-only case folding and LIKE with live wildcards."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# SQL LIKE in the reference folds ASCII letters only.
UPPER = string.ascii_uppercase
LOWER = string.ascii_lowercase
# An escape character no query may contain, so '\' and every other
# character is plain inside the pattern while '%' and '_' stay live.
NO_ESCAPE = "\u0001"


def ascii_lower(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.translate(c, UPPER, LOWER)


def ascii_lower_py(s: str) -> str:
    return s.translate(str.maketrans(UPPER, LOWER))


def like_contains(text_col, query: str) -> Column:
    """``text LIKE '%query%'`` with ASCII case folding and no escape char."""
    if NO_ESCAPE in query:
        raise ValueError("query contains the reserved character U+0001")
    q = ascii_lower_py(query)
    if "%" not in q and "_" not in q:
        # No wildcard: a plain substring test (codegen'd, no regex). Spark
        # only rewrites LIKE to this itself for the default escape character.
        return ascii_lower(text_col).contains(F.lit(q))
    return F.like(ascii_lower(text_col), F.lit("%" + q + "%"), F.lit(NO_ESCAPE))


def text_hash(text_col) -> Column:
    """Content hash used to find stale vectors (K2)."""
    c = F.col(text_col) if isinstance(text_col, str) else text_col
    return F.sha2(c, 256)
