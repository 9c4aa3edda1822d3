"""Every registered query of the analytics operators against its SQL in DuckDB."""

import math

import duckdb
import pandas as pd
import pytest

from visitloom.plans import registry
from visitloom.sources.tables import TABLES


def _plain(v):
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.8g}"
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))[:19]
    return str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = [tuple(_plain(r[c]) for c in columns) for r in df.collect()]
    told = duck.sql(registry.oracle_sql()[name])
    assert sorted(told.columns) == columns
    at = [told.columns.index(c) for c in columns]
    want = [tuple(_plain(r[i]) for i in at) for r in told.fetchall()]
    key = lambda t: tuple(str(x) for x in t)
    assert sorted(got, key=key) == sorted(want, key=key)
