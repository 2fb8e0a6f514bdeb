"""Every registered query against its DuckDB twin on the smallest tables."""

import collections
import datetime
import decimal

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from ledgerweave.sources.tables import TABLES, table_path


def _canon(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, decimal.Decimal):
        return format(v.normalize(), "f") if v != 0 else "0"
    if isinstance(v, float):
        return format(decimal.Decimal(repr(v)).normalize(), "f")
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF_SMALL, t)}')")
    return con


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    cols = sorted(sdf.columns)
    s_rows = collections.Counter(tuple(_canon(r[c]) for c in cols) for r in sdf.collect())
    res = duck.execute(E.oracle_sql()[name])
    d_cols = [d[0] for d in res.description]
    assert sorted(d_cols) == cols
    idx = sorted(range(len(d_cols)), key=lambda i: d_cols[i])
    d_rows = collections.Counter(tuple(_canon(r[i]) for i in idx) for r in res.fetchall())
    assert s_rows == d_rows
