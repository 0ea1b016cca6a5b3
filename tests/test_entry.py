"""The driver contract: entry() runs, every query has a stable schema."""

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["rank", "id", "text", "score", "metadata"]
    assert df.count() == 10


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_similarity_pairs_refuses_full_matrix(spark):
    import pytest

    from docsift.operators.similarity import similarity_pairs
    from docsift.sources.testdata import vectors_from_testdata

    with pytest.raises(ValueError):
        similarity_pairs(vectors_from_testdata(spark, "/root/testdata/sf0.001"))
