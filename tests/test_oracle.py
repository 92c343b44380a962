"""Every query with SQL of its own against that SQL, in DuckDB, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"
NAMES = [n for n in entry.oracle_sql() if n.startswith(("v_", "p_", "e_", "f_", "k_", "s_"))]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def cells(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    text = lambda v: "null" if v is None else repr(float(f"{v:.9g}")) if isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) else str(v)
    return sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    rows = df.collect()
    assert rows  # an empty result shows nothing
    assert cells(rows, df.columns) == cells(want.fetchall(), want.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
