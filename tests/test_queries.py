"""Every query of the engine against its SQL, on the smallest tables."""

import glob
from datetime import datetime
from pathlib import Path

import duckdb
import pytest

from chatloom.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.sql(f"create view {Path(f).stem} as select * from '{f}'")
    return con


def plain(v):
    if v is None or v != v:
        return "~"
    if isinstance(v, bool) or isinstance(v, (str, datetime)):
        return str(v)
    return str(round(float(v), 6))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, tables, name):
    found = QUERIES[name](spark, DIR)
    rows = [tuple(r) for r in found.collect()]
    if name in SQL:
        wanted = tables.sql(SQL[name])
        assert sorted(found.columns) == sorted(wanted.columns)
        assert rows_of(found.columns, rows) == rows_of(wanted.columns, wanted.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(SQL) <= set(__spark_entry__.queries())
