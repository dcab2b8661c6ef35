"""Every registered query equals its DuckDB oracle on the smallest tables,
and the entry point runs."""

import importlib.util
import os

import duckdb
import pytest

import __spark_entry__ as E
from tracekit.plans import catalog
from tracekit.sources.fixtures import BASE_TABLES

from .conftest import SF_SMALL

_spec = importlib.util.spec_from_file_location(
    "check_oracle", os.path.join(os.path.dirname(os.path.dirname(__file__)), "scripts", "check_oracle.py"))
check = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(check)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["bucket", "low", "n", "share", "accuracy"]
    assert df.count() >= 1


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    got = check._rows(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(E.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    want = check._rows(cols, cur.fetchall())
    assert sorted(df.columns) == sorted(cols)
    assert got == want


def test_every_query_has_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLE)
    assert set(catalog.QUERIES) <= set(E.queries())
