"""The queries that SQL can express, on whole tables, against that SQL in DuckDB."""

import os

import duckdb
import pytest
from tests.test_oracles import rows

from quoin.llm import queries

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query(spark, name):
    duck = duckdb.connect()
    for f in os.listdir(DIR):
        duck.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DIR}/{f}'")
    got, want = queries.QUERIES[name](spark, DIR).toPandas(), duck.execute(queries.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
