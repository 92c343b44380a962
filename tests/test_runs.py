"""Intake, streams against batches, exports and work orders."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.operators import Signals
from sigloom.operators import engines as E
from sigloom.plans import pipeline as P
from sigloom.sources import intake
from sigloom.streaming import stateful as S

SF = "/root/testdata/sf0.001"


def test_intake(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, 2.0)], "signal_id string, index double, value double")
    assert intake.observations(df).first().asDict() == {"entity_id": "default", "signal_id": "a", "I": 1.0, "y": 2.0, "unit": None, "dimension": None}
    with pytest.raises(ValueError):
        intake.observations(df.drop("value"))
    df.write.csv(f"file://{tmp_path}/x.csv", header=True)
    df.write.parquet(f"file://{tmp_path}/x.parquet")
    assert intake.read(spark, f"file://{tmp_path}/x.csv").collect() == intake.read(spark, f"file://{tmp_path}/x.parquet").collect()
    assert intake.sniff(b"PAR1....") == "parquet" and intake.sniff(b"a,b\n1,2") == "csv" and intake.sniff(b"\0\1") == "parquet"


@pytest.fixture(scope="module")
def stream(spark, tmp_path_factory):
    """The event grid in four files by index, read one at a time."""
    at = tmp_path_factory.mktemp("stream")
    grid = intake.event_grid(spark, SF)
    for i, (a, b) in enumerate(((0, 150), (150, 400), (400, 401), (401, 800))):
        grid.where((F.col("I") >= a) & (F.col("I") < b)).coalesce(1).write.mode("append").parquet(f"file://{at}/in")
    import pathlib

    for i, p in enumerate(sorted(pathlib.Path(at, "in").glob("*.parquet"), key=lambda p: p.stat().st_mtime)):
        import os

        os.utime(p, (i, i))
    return lambda: spark.readStream.schema(grid.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{at}/in")


def drain(spark, df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"file://{tmp_path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_stream_equals_batch(spark, stream, tmp_path):
    batch = Signals(intake.event_grid(spark, SF))
    got = {(r.signal_id, r.I): (r.dy, r.d2y) for r in drain(spark, S.derivatives(stream()), "derivatives", tmp_path).collect()}
    want = {(r.signal_id, r.I): (r.dy, r.d2y) for r in batch["v_curvature"].collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)

    last = {(r.signal_id, r.s): r for r in drain(spark, S.running_laplace(stream()), "laplace", tmp_path).orderBy("I").collect()}
    rows = batch["v_base"].where("signal_id = 'click'").orderBy("I").collect()
    I, y = np.array([r.I for r in rows]), np.array([r.y for r in rows])
    assert last["click", 0.01].field == pytest.approx((y * np.exp(-0.01 * (I - I[0])) * np.diff(I, prepend=I[0])).sum() / (I[-1] - I[0]))

    blocks = drain(spark, S.buffered_kernel(stream(), "permutation_entropy", 60), "blocks", tmp_path).where("signal_id = 'click'").orderBy("block").collect()
    from sigloom.functions.kernels import permutation_entropy

    assert [b.permutation_entropy for b in blocks] == pytest.approx([permutation_entropy(None, y[i : i + 60])["permutation_entropy"] for i in range(0, len(y) - 59, 60)])
    level = drain(spark, S.kalman_level(stream()), "kalman", tmp_path).where("signal_id = 'click'").orderBy("I").collect()
    assert len(level) == len(y) and abs(level[-1].level - y.mean()) < 3 * y.std()


def test_event_time_windows(spark):
    df = spark.createDataFrame([("e", "a", f"2024-01-01 00:{m:02d}:00", float(m)) for m in (1, 5, 40, 59)], "entity_id string, signal_id string, t string, y double").withColumn("ts", F.to_timestamp("t"))
    assert sorted(r.n for r in S.windowed(df, window="30 minutes").collect()) == [2, 2] and sorted(r.n for r in S.sessions(df).collect()) == [2, 2]


def test_export(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    rows = P.export(intake.event_grid(spark, SF), out, engines=("hurst", "mst"))
    assert rows["hurst"] == 5 and rows["mst"] == 4 and all(P.validate(spark, out).values())


def test_four_layers(spark):
    layers = P.four_layers(intake.event_grid(spark, SF))
    assert layers["summary"].count() == 5 and layers["geometry"].count() == 10 and layers["mechanics"].count() == 20
    assert {r.role for r in layers["summary"].collect()} <= {"SOURCE", "SINK", "CONDUIT", "ISOLATED"}


def test_orders(spark):
    order = {"click": ["hurst", "fft"], "view": ["fft"]}
    assert P.decode_order(P.encode_order(order)) == order
    out = P.run_order(intake.event_grid(spark, SF), order)
    assert {n: d.count() for n, d in out.items()} == {"fft": 2, "hurst": 1} and set(P.run_order(intake.event_grid(spark, SF), None)) == {"hurst", "sample_entropy"}
    with pytest.raises(ValueError):
        P.run_order(intake.event_grid(spark, SF), {"click": ["nothing"]})


def test_primitives_reach_typology(spark):
    base = intake.event_grid(spark, SF)
    s = Signals(base, E.apply(Signals(base), "hurst").join(E.apply(Signals(base), "lyapunov"), ["entity_id", "signal_id"]))
    assert all(r.hurst is not None for r in s.table("v_signal_typology").collect())


def test_domain_config(spark, tmp_path):
    from sigloom.sources import config

    (tmp_path / "d.json").write_text('{"index": {"column": "cycle", "dimension": "time"}, "entity": {"column": "unit_id"}, "signals": {"s1": {"unit": "K"}, "s2": {"unit": "psia"}, "s9": {}}}')
    domain = config.load(spark, f"file://{tmp_path}/d.json")
    wide = spark.createDataFrame([(1, 1, 5.0, 6.0), (1, 2, 5.5, None)], "unit_id int, cycle int, s1 double, s2 double")
    rows = {(r.entity_id, r.signal_id, r.I): (r.y, r.unit) for r in config.melt(wide, domain).collect()}
    assert rows["1", "s1", 2.0] == (5.5, "K") and rows["1", "s2", 1.0] == (6.0, "psia") and len(rows) == 4
    with pytest.raises(ValueError):
        config.melt(wide.select("cycle"), domain)
    got = config.from_bytes(spark, b"signal_id,index,value\na,1,2.5\n").first()
    assert (got.signal_id, got.I, got.y) == ("a", 1.0, 2.5)
