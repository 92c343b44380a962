"""Every operator on tables that are empty, constant, short, gappy or null: no failure, and no rows out of nothing."""

import pytest

from sigloom.operators import VIEWS, Signals

SCHEMA = "entity_id string, signal_id string, I double, y double, unit string, dimension string"
ODD = [("e", "flat", float(i), 2.0, "kPa", "time") for i in range(70)] + [("e", "zero", float(i), 0.0, "m/s", "space") for i in range(70)]
ODD += [("e", "one", 0.0, 1.0, "K", "time"), ("e", "two", 0.0, 1.0, None, None), ("e", "two", 1.0, 3.0, None, None), ("f", "none", 0.0, None, "count", "time"), ("f", "none", 1.0, None, "count", "time")]
ODD += [("e", "gappy", float(i * i), float(i % 3) if i % 5 else None, "L/min", "time") for i in range(60)] + [("e", "inlet", float(i), -float(i), "L/min", "time") for i in range(60)]


@pytest.mark.parametrize("rows", [[], ODD], ids=["empty", "odd"])
def test_all_operators(spark, rows):
    s = Signals(spark.createDataFrame(rows, SCHEMA).repartition(2))
    failed = {}
    for name in VIEWS:
        try:
            s.rounded(name).collect()
        except Exception as e:  # noqa: BLE001
            failed[name] = str(e)[:200]
    assert not failed
