import pytest
from odd_rows import SCHEMA


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (doc_id, text) pairs, with nulls elsewhere and columns whose names clash with results."""

    def make(*rows, source="s"):
        return spark.createDataFrame([(i, t, None, source, None, 1, "x") for i, t in rows], SCHEMA)

    return make
