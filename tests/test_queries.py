"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import math
import os

import duckdb
import pytest

from tidemark.plans import registry

DIR = os.environ.get("TIDEMARK_TEST_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or hasattr(v, "as_tuple"):
        return f"{float(v):.9g}"
    return v.isoformat(" ").removesuffix(" 00:00:00") if hasattr(v, "hour") else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_rows_agree(spark, duck, name):
    df, sql = registry.QUERIES[name](spark, DIR), duck.sql(registry.ORACLE[name])
    assert sorted(df.columns) == sorted(sql.columns)
    order = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    at = [sql.columns.index(c) for c in order]
    assert ours == sorted(tuple(plain(r[k]) for k in at) for r in sql.fetchall())
