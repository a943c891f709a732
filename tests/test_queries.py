import math

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
from driftwell import catalog  # noqa: E402

ORACLE = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def shown(v):
    if isinstance(v, float):
        assert not math.isnan(v)
        return round(v, 8) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.sql(ORACLE[name])
    assert sorted(want.columns) == cols
    got = sorted((tuple(shown(r[c]) for c in cols) for r in df.collect()), key=repr)
    place = [want.columns.index(c) for c in cols]
    assert got == sorted((tuple(shown(r[i]) for i in place) for r in want.fetchall()), key=repr)


def test_entry(spark):
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
