"""Every core query that has SQL against DuckDB on the smallest tables; the rest must run."""

import datetime
import glob
import os

import duckdb
import pytest

from quire.plans import registry


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted(([plain(r[c]) for c in cols] for r in df.collect()), key=lambda r: [(x is None, str(x)) for x in r])


def duck(sql, folder):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(([plain(r[i]) for i in order] for r in cur.fetchall()), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, small, name):
    got = rows_of(registry.queries()[name](spark, small))
    sql = registry.oracle_sql().get(name)
    if sql:
        assert got == duck(sql, small)
