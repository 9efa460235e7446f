import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def notices(spark):
    """Notices with a key in ``hash``, text in ``notes`` and columns whose names clash with results."""

    def make(rows, key="long"):
        schema = f"hash {key}, notes string, source_name string, score string, kept string, key string, text string, row_a int"
        return spark.createDataFrame([(k, t, "county list", "x", "y", "z", "w", 1) for k, t in rows], schema)

    return make


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], T.StructType().add("hash", "long").add("notes", "string").add("source_name", "string"))
