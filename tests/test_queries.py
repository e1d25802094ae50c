import duckdb
import pytest

import __spark_entry__
from keystrata.queries import ORACLE, QUERIES, TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(repr(tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = duck.sql(ORACLE[name])
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    assert plain(df.select(columns).collect()) == plain(found.select(*[f'"{c}"' for c in columns]).fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["o_orderkey", "o_totalprice"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
