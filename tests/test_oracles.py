"""Every query with SQL gives the rows that DuckDB gives."""

import datetime
import math
import os

import duckdb
import pytest

from snaplake import plans

SQL = plans.oracle_sql()
QUERIES = plans.queries()


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(sf_dir):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{sf_dir}/{name}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def rows(names, got):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in got], key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal(spark, duck, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    expected = duck.execute(SQL[name])
    names = [c[0] for c in expected.description]
    assert sorted(frame.columns) == sorted(names)
    assert rows(frame.columns, frame.collect()) == rows(names, expected.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_others_run(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
