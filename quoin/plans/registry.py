"""Queries by name, each with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import Tables, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: Queries whose SQL covers a part of their input: the query over that part alone, and the SQL.
PARTS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def query(name: str, sql: str | None = None, parts: dict[str, Callable[[Tables], DataFrame]] | None = None):
    """Registers a function of ``Tables``; ``sql`` may use base tables and fixture views. ``parts``: for
    tables that the SQL does not cover whole, what it covers; such SQL is no oracle of the query."""

    def put(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql and parts:
            PARTS[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir, parts)), oracle(sql)
        elif sql:
            ORACLE[name] = oracle(sql)
        return f

    return put
