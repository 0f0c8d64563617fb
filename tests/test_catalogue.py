"""Every named query against its comparison SQL on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from loam.catalogue import all_queries
from loam.sources.tables import TABLES
from tests.conftest import SMALL

QUERIES = all_queries()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return connection


def plain(value):
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return value


def table(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    found = [tuple(plain(r[i]) for i in order) for r in records]
    return sorted(columns), sorted(found, key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, SMALL)
    got = table(frame.columns, frame.collect())
    result = duck.execute(QUERIES[name].sql)
    assert got == table([d[0] for d in result.description], result.fetchall())


def test_every_query_has_a_comparison():
    assert all(q.sql for q in QUERIES.values())
