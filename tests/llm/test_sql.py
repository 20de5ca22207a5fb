"""Queries of this subpackage that have SQL, against it."""

from __future__ import annotations

import duckdb
import pytest

from textwarden.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = con.sql(queries.SQL[name]), queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    listed = lambda names, rows: sorted(repr([r[names.index(c)] for c in order]) for r in rows)
    assert listed(got.columns, [tuple(r) for r in got.collect()]) == listed(want.columns, want.fetchall())
