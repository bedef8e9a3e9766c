"""Every query with SQL gives the same rows as that SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return con


def _key(row):
    return tuple(
        (v is None, "" if v is None or isinstance(v, (int, float)) else str(v), float(v) if isinstance(v, (int, float)) else 0.0)
        for v in row
    )


def _close(a, b):
    if isinstance(a, float) and isinstance(b, (int, float)):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    df = queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    ours = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=_key)
    cursor = duck.execute(oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    theirs = sorted((tuple(r[i] for i in order) for r in cursor.fetchall()), key=_key)
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs):
        assert all(_close(x, y) for x, y in zip(a, b)), (columns, a, b)


def test_entry_has_a_row_per_order(spark):
    df = entry(spark)
    assert df.count() == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()


def test_every_sql_has_its_query():
    assert set(oracle_sql()) <= set(queries())
