"""Every registered query against its SQL, over the smallest tables."""

import math
import os

import duckdb
import pytest

from corpusops.plans.oracle import ORACLE
from corpusops.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for name in os.listdir(SF_DIR):
        connection.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF_DIR}/{name}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    return str(value)


def as_rows(rows, names, order):
    return sorted(tuple(plain(row[names.index(n)]) for n in order) for row in rows)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE])
def test_query_equals_sql(spark, tables, name):
    frame = QUERIES[name](spark, SF_DIR)
    expected = tables.sql(ORACLE[name])
    order = sorted(frame.columns)
    assert order == sorted(expected.columns)
    assert as_rows(frame.collect(), frame.columns, order) == as_rows(expected.fetchall(), expected.columns, order)


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_queries_without_sql_return_rows(spark):
    assert QUERIES["t03_unigram"](spark, SF_DIR).count() > 100
