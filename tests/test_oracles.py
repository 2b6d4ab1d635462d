"""Every query that SQL can express, against DuckDB on the same tables."""

import math

import duckdb
import pytest
from colloquy.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v if isinstance(v, (int, bool, str, type(None))) else str(v)


def rows(columns, data):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in at) for r in data), key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    wanted = duck.sql(SQL[name])
    assert sorted(frame.columns) == sorted(wanted.columns)
    assert rows(frame.columns, [tuple(r) for r in frame.collect()]) == rows(wanted.columns, wanted.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
