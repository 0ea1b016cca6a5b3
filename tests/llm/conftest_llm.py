import random

import pytest

SF001 = "/root/testdata/sf0.001"
EXTRA = "copy string, shard int, tkey string, key int, node int, root int, weight string, trusted boolean, spans string, path2 string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def rows_of(pairs, source="s"):
    return [(i, t, "en", source, 0, "c", 1, "t", 2, 3, 4, "w", True, "x", "p") for i, t in pairs]


def prose(seed, n, vocabulary=4000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def make(spark):
    """Documents with extra columns of clashing names."""
    from docsift.session import ship_package

    ship_package(spark)
    return lambda pairs, source="s": spark.createDataFrame(rows_of(pairs, source), SCHEMA)


@pytest.fixture(scope="session")
def sample(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]


# Null and empty texts, a null id, repeated rows, one id with two texts, a very long text.
ODD = [
    (None, None), (1, None), (2, ""), (3, " \n\t "), (4, "word"), (4, "word"), (5, "one two"), (5, "three four five six"),
    (None, "a text without an id"), (6, prose(1, 30000)), (7, "é　x\x1cy  z w \U0001f600 token = abc"), (8, "\x00 nul"),
]


def key(t):
    return (t[0] is not None, t)
