"""Every registered retail query against its DuckDB twin at the smallest scale."""

import math
import os

import duckdb
import pytest

from retailops.plans import catalog

AT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(AT):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{AT}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, list):
        return tuple(map(plain, v))
    return v if v is None or isinstance(v, (bool, int, str)) else str(v)


def rows(tuples):
    return sorted((tuple(map(plain, t)) for t in tuples), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_equals_its_twin(spark, duck, name):
    df = catalog.QUERIES[name](spark, AT)
    columns = sorted(df.columns)
    twin = duck.sql(catalog.SQL[name])
    assert sorted(twin.columns) == columns
    at = [list(twin.columns).index(c) for c in columns]
    assert rows(df.select(*columns).collect()) == rows([tuple(r[i] for i in at) for r in twin.fetchall()])


def test_every_query_has_a_twin():
    assert set(catalog.QUERIES) == set(catalog.SQL)
