import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from docsift.session import local_session

    s = local_session("*", app="docsift-tests")
    yield s
    s.stop()


@pytest.fixture
def docs_factory(spark):
    """Build a documents table from (id, text, metadata) tuples."""
    from pyspark.sql import functions as F

    from docsift.schema import DOCUMENTS

    def make(rows, as_of="2024-01-01 00:00:00"):
        data = [(i, t, m or {}, None, None, None) for i, t, m in rows]
        df = spark.createDataFrame(data, DOCUMENTS)
        ts = F.lit(as_of).cast("timestamp")
        return df.withColumn("created_at", ts).withColumn("updated_at", ts).withColumn("text_hash", F.sha2("text", 256))

    return make


@pytest.fixture
def vectors_factory(spark):
    from docsift.schema import VECTORS

    def make(rows):
        return spark.createDataFrame([(i, [float(x) for x in v], "m", None) for i, v in rows], VECTORS)

    return make
