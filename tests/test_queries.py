"""Every query with SQL, compared with it on the smallest tables."""

import math
import os

import duckdb
import pytest

from codexlake.plans import catalogue


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(data):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{data}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, data, name):
    df = catalogue.queries()[name](spark, data)
    rows = df.collect()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        return
    result = duck.execute(sql)
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    at = [columns.index(c) for c in df.columns]
    assert sorted(repr(plain(tuple(r))) for r in rows) == sorted(repr(plain(tuple(r[i] for i in at))) for r in result.fetchall())
