"""Queries that SQL can express equal their DuckDB SQL on whole tables."""

import math

import duckdb
import pytest

from tracekit.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(lspark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.ORACLE[name])
    names = [d[0] for d in want.description]
    df = queries.QUERIES[name](lspark, SF)
    assert sorted(df.columns) == sorted(names)
    norm = lambda r: tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r)
    assert sorted(map(repr, map(norm, map(tuple, df.select(*names).collect())))) == sorted(map(repr, map(norm, want.fetchall())))
