"""The training-data queries that have SQL of their own, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from sigloom.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got, want = registry.queries()[name](spark, SF), con.sql(registry.oracle_sql()[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    assert sorted(tuple(r[c] for c in order) for r in got.collect()) == sorted(tuple(r[want.columns.index(c)] for c in order) for r in want.fetchall())
