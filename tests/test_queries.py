"""Every query runs on the smallest tables, and equals its SQL where it has one."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from parolith.session import TABLES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
SLOW = {"tau_sweep"}


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - SLOW))
def test_query(spark, sql, name):
    df = entry.queries()[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in names]).collect()), key=repr)
    if name in entry.oracle_sql():
        told = sql.execute(entry.oracle_sql()[name])
        columns = [c[0] for c in told.description]
        at = [columns.index(c) for c in names]
        assert sorted(columns) == names
        assert got == sorted((tuple(plain(r[k]) for k in at) for r in told.fetchall()), key=repr)
