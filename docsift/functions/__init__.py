"""Column-level functions (JVM-side expressions, no Python per row)."""

from docsift.functions.vectors import (  # noqa: F401
    cosine_similarity,
    dot,
    l2_normalize,
    norm,
    score_from_distance,
    squared_l2,
)
from docsift.functions.text import ascii_lower, like_contains, text_hash  # noqa: F401
from docsift.functions.json import normalise_metadata_json  # noqa: F401
