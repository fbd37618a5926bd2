"""Every query with a SQL form against DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from surfmesh.plans import model_oracle, model_queries, oracle, queries

DIR = "/root/testdata/sf0.001"
QUERIES, SQL = queries.QUERIES | model_queries.QUERIES, oracle.SQL | model_oracle.SQL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DIR):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{DIR}/{name}'")
    return con


def plain(rows, columns):
    order = [columns.index(c) for c in sorted(columns)]
    value = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


def test_every_form_has_its_query():
    assert not set(oracle.SQL) & set(model_oracle.SQL) and set(SQL) <= set(QUERIES) and set(QUERIES) - set(SQL) == {"mesh_from_points"}


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    want = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert plain(df.collect(), df.columns) == plain(want.fetchall(), want.columns)
