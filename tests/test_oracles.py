"""Every query with SQL gives the rows of its SQL, in DuckDB, on the smallest tables; the others run."""

import os

import duckdb
import pandas as pd
import pytest

from quoin.plans import catalog

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DIR}/{f}'")
    return c


def cell(v):
    if v is None or v is pd.NA or v != v:
        return ""
    return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) or "float" in type(v).__name__ or "int" in type(v).__name__ else str(v)


def rows(df):
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DIR).toPandas()
    if name in catalog.ORACLE:
        want = duck.execute(catalog.ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
