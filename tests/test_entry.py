"""Every query with SQL gives the same rows in both engines on the smallest tables."""

from __future__ import annotations

import glob
import os

import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def comparable(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted(tuple(repr(round(r[i], 9) + 0.0) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, DATA)
    other = duck.sql(__spark_entry__.oracle_sql()[name])
    assert comparable(df.collect(), df.columns) == comparable(other.fetchall(), list(other.columns))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 10


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
