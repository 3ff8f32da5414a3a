"""Every query of the library against its SQL at the smallest scale."""

import math
import os

import duckdb
import pytest

from cortexgrid.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v if v is None or isinstance(v, (bool, int)) else str(v)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, oracle, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    result = oracle.sql(ORACLE_SQL[name])
    assert columns == sorted(result.columns)
    want = result.select(*map(duckdb.ColumnExpression, columns)).fetchall()
    got = df.select(columns).collect()
    key = lambda row: tuple(map(repr, row))
    assert sorted((tuple(map(plain, r)) for r in got), key=key) == sorted((tuple(map(plain, r)) for r in want), key=key)
