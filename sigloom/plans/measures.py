"""Engineering measures as queries: aggregates over series, velocity fields, and numerical routines, each with SQL of its own.

Series: lineitem's quantities by return flag, at the time of the order key; an aggregate for each flag. Fields: means of
quantity, discount and tax in a box of six cells a side for each flag. Routines: one run for each different pair of quantity
and discount, which are all that lineitem has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.functions.physics import cavity as V
from sigloom.functions.physics import chemical as C
from sigloom.functions.physics import columns as D
from sigloom.functions.physics import control as K
from sigloom.functions.physics import fluids as U
from sigloom.functions.physics import machines as M
from sigloom.functions.physics import thermal as T
from sigloom.functions.physics import turbines as G
from sigloom.functions.physics.dispatch import compute
from sigloom.operators.catalog import settled, settled_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _told(df: DataFrame) -> DataFrame:
    return df.select(*[settled(F.col(c)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str, real: str) -> None:
    """real: the columns of the SQL that are real numbers."""
    QUERIES[f"f_{name}"] = lambda spark, sf_dir: _told(run(spark, sf_dir))
    ORACLES[f"f_{name}"] = f"SELECT * REPLACE ({', '.join(f'{settled_sql(f'CAST({c} AS DOUBLE)')} AS {c}' for c in real.split())}) FROM ({sql})"


# ---------------------------------------------------------------- aggregates over series

SERIES = "SELECT l_returnflag AS series, CAST(l_quantity AS DOUBLE) - 25 AS y, CAST(l_discount AS DOUBLE) * 100 - 5 AS i, CAST(l_quantity AS DOUBLE) AS q, CAST(l_extendedprice AS DOUBLE) AS p, (l_orderkey % 5000) / 1000.0::DOUBLE AS t FROM lineitem"


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_returnflag").alias("series"), (F.col("l_quantity").cast("double") - 25).alias("y"), (F.col("l_discount").cast("double") * 100 - 5).alias("i"), F.col("l_quantity").cast("double").alias("q"),
        F.col("l_extendedprice").cast("double").alias("p"), ((F.col("l_orderkey") % 5000) / F.lit(1000.0)).alias("t"),
    )


def amp(f: float) -> str:
    w = f"2 * pi() * {f} * t"
    return f"(2 * sqrt(pow(sum(y * cos({w})), 2) + pow(sum(y * sin({w})), 2)) / count(y))"


def db(a: str, b: str) -> str:
    return f"(20 * log10(({a} + 1e-12) / ({b} + 1e-12)))"


def _label(value: str, *cases: tuple[float, str], other: str) -> str:
    return f"CASE {' '.join(f"WHEN {value} > {k} THEN '{v}'" for k, v in cases)} ELSE '{other}' END"


def _aggregate(name: str, columns: Callable[[], list[Column]], fields: dict[str, str], real: str) -> None:
    run = lambda spark, sf_dir: _series(spark, sf_dir).groupBy("series").agg(*columns()).select("series", *fields)
    _add(name, run, f"SELECT series, {', '.join(f'{v} AS {k}' for k, v in fields.items())} FROM ({SERIES}) GROUP BY series", real)


ABS, ROOT = "abs(y)", "sqrt(abs(y))"
_aggregate(
    "bearing_condition_indicators", lambda: M.condition_indicators("y"),
    {"rms": "sqrt(avg(y * y))", "peak": f"max({ABS})", "crest_factor": f"max({ABS}) / sqrt(avg(y * y))", "kurtosis": "kurtosis_pop(y) + 3", "clearance_factor": f"max({ABS}) / pow(avg({ROOT}), 2)", "impulse_factor": f"max({ABS}) / avg({ABS})", "shape_factor": f"sqrt(avg(y * y)) / avg({ABS})"},
    "rms peak crest_factor kurtosis clearance_factor impulse_factor shape_factor",
)
_lower, _upper = db(amp(50 * (1 - 2 * 0.03)), amp(50.0)), db(amp(50 * (1 + 2 * 0.03)), amp(50.0))
_aggregate("broken_rotor_bar", lambda: M.broken_rotor_bar("y", "t", 50.0, 0.03), {"brb_indicator_db": f"greatest({_lower}, {_upper})", "brb_lower_db": _lower, "brb_upper_db": _upper, "severity": _label(f"greatest({_lower}, {_upper})", (-35, "severe"), (-45, "moderate"), (-54, "incipient"), other="healthy")}, "brb_indicator_db brb_lower_db brb_upper_db")
_worst = f"greatest({db(amp(25.5), amp(50.0))}, {db(amp(74.5), amp(50.0))})"
_aggregate("eccentricity", lambda: M.eccentricity("y", "t", 50.0, 24.5), {"dynamic_eccentricity_db": _worst, "condition": _label(_worst, (-30, "severe"), (-40, "moderate"), other="healthy")}, "dynamic_eccentricity_db")
_worst = f"greatest({', '.join(db(amp(abs(50 + s * k * 87.0)), amp(50.0)) for k in (1, 2, 3) for s in (-1, 1))})"
_aggregate("bearing_fault_mcsa", lambda: M.bearing_fault_current("y", "t", 50.0, 87.0), {"bearing_indicator_db": _worst, "condition": _label(_worst, (-40, "fault"), (-50, "warning"), other="healthy")}, "bearing_indicator_db")
_side = "(" + " + ".join(amp(400.0 + s * k * 25.0) for k in (1, 2, 3) for s in (-1, 1)) + f") / {amp(400.0)}"
_aggregate("sideband_analysis", lambda: M.sidebands("y", "t", 400.0, 25.0), {"GMF_amplitude": amp(400.0), "sideband_ratio": _side, "fault_indicator": f"{_side} > 0.5"}, "GMF_amplitude sideband_ratio")
_aggregate("harmonic_analysis", lambda: M.harmonics("y", "t", 50.0, 6), {"fundamental": amp(50.0), "thd": f"sqrt({' + '.join(f'pow({amp(50.0 * k)}, 2)' for k in range(2, 7))}) / {amp(50.0)}"}, "fundamental thd")
_s = "(sqrt(avg(y * y)) * sqrt(avg(i * i)))"
_aggregate("power_factor", lambda: M.power_factor("y", "i"), {"P": "avg(y * i)", "S": _s, "Q": f"sqrt(greatest({_s} * {_s} - avg(y * i) * avg(y * i), 0))", "pf": f"avg(y * i) / {_s}"}, "P S Q pf")
_damage = "sum(1 / (0.5 * pow(q / 2 / 900, -5)))"
_aggregate("miner_damage", lambda: M.miner("q", 1.0, 900.0, -0.2), {"damage": _damage, "remaining_life": f"1 / {_damage}", "failed": f"{_damage} >= 1"}, "damage remaining_life")
_mean = "sum(t * q) / sum(q)"
_aggregate("residence_time_distribution", lambda: C.residence_time("t", "q"), {"mean_residence_time": _mean, "variance": f"sum(t * t * q) / sum(q) - pow({_mean}, 2)", "dispersion": f"(sum(t * t * q) / sum(q) - pow({_mean}, 2)) / pow({_mean}, 2)"}, "mean_residence_time variance dispersion")
_add(
    "time_synchronous_average", lambda spark, sf_dir: M.synchronous_average(_series(spark, sf_dir).withColumn("row", F.round(F.col("t") * 1000).cast("long")), ["series"], "y", "row", 40),
    f"SELECT series, CAST(round(t * 1000) AS BIGINT) % 40 AS phase, avg(y) AS tsa, stddev_pop(y) AS residual, count(*) AS n_averages FROM ({SERIES}) GROUP BY ALL", "tsa residual",
)
_z = "10 + 100 / (1 + power(0.1 * q, 2))", "-10 * q / (1 + power(0.1 * q, 2))"
_add(
    "nyquist_features", lambda spark, sf_dir: _series(spark, sf_dir).select("series", M.randles("q", 10.0, 100.0, 1e-3).alias("z")).groupBy("series").agg(*M.nyquist_features("z.Z_real", "z.Z_imag")).drop("Z_real_at_max"),
    f"SELECT series, min(re) AS R_s, max(re) - min(re) AS R_p, max(re) AS R_total, max(-im) AS Z_imag_max FROM (SELECT series, {_z[0]} AS re, {_z[1]} AS im FROM ({SERIES})) GROUP BY series", "R_s R_p R_total Z_imag_max",
)

# ---------------------------------------------------------------- velocity fields

FIELD = """SELECT l_returnflag AS field_id, l_orderkey % 6 AS ix, l_suppkey % 6 AS iy, l_partkey % 6 AS iz, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS u,
  100 * CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS v, 100 * CAST(sum(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS w FROM lineitem GROUP BY 1, 2, 3, 4"""
STEPS = (0.5, 0.25, 1.0)
AT = "field_id, ix, iy, iz"


def velocity_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))
    cells = [(F.col(c) % 6).alias(a) for c, a in (("l_orderkey", "ix"), ("l_suppkey", "iy"), ("l_partkey", "iz"))]
    made = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_returnflag").alias("field_id"), *cells).agg(mean("l_quantity").alias("u"), (100 * F.sum(F.col("l_discount").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))).alias("v"), (100 * F.sum(F.col("l_tax").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))).alias("w"))
    return made


def _slope(n: str, a: str) -> str:
    others = ", ".join(x for x in ("ix", "iy", "iz") if x != f"i{a}")
    o, h = f"OVER (PARTITION BY field_id, {others} ORDER BY i{a})", STEPS["xyz".index(a)]
    return f"coalesce((lead({n}) {o} - lag({n}) {o}) / {2 * h}, (lead({n}) {o} - {n}) / {h}, ({n} - lag({n}) {o}) / {h}) AS {n}{a}"


def _bend(n: str, a: str) -> str:
    others = ", ".join(x for x in ("ix", "iy", "iz") if x != f"i{a}")
    o, h = f"OVER (PARTITION BY field_id, {others} ORDER BY i{a})", STEPS["xyz".index(a)]
    return f"(lead({n}) {o} - 2 * {n} + lag({n}) {o}) / {h * h}"


GRADIENT = f"SELECT *, {', '.join(_slope(n, a) for n in 'uvw' for a in 'xyz')} FROM ({FIELD})"
SPIN = {"omega_x": "wy - vz", "omega_y": "uz - wx", "omega_z": "vx - uy"}
SIZE = "sqrt((wy - vz) * (wy - vz) + (uz - wx) * (uz - wx) + (vx - uy) * (vx - uy))"
STRAIN2 = "(ux * ux + vy * vy + wz * wz + (uy + vx) * (uy + vx) / 2 + (uz + wx) * (uz + wx) / 2 + (vz + wy) * (vz + wy) / 2)"
TURN2 = "((uy - vx) * (uy - vx) / 2 + (uz - wx) * (uz - wx) / 2 + (vz - wy) * (vz - wy) / 2)"
DET = "(ux * (vy * wz - vz * wy) - uy * (vx * wz - vz * wx) + uz * (vx * wy - vy * wx))"
Q2, SPEED = f"(({TURN2} - {STRAIN2}) / 2)", "sqrt(u * u + v * v + w * w)"
HELICITY = "(u * (wy - vz) + v * (uz - wx) + w * (vx - uy))"


def _field(name: str, run: Callable[[DataFrame], DataFrame], fields: dict[str, str], source: str = GRADIENT, graded: bool = True) -> None:
    start = lambda spark, sf_dir: U.gradients(velocity_field(spark, sf_dir), STEPS) if graded else velocity_field(spark, sf_dir)
    _add(name, lambda spark, sf_dir: run(start(spark, sf_dir)).select(*AT.split(", "), *fields), f"SELECT {AT}, {', '.join(f'{v} AS {k}' for k, v in fields.items())} FROM ({source})", " ".join(fields))


_field("velocity_gradient_tensor", lambda g: g, {f"d{n}_d{a}": f"{n}{a}" for n in "uvw" for a in "xyz"})
_field("velocity_magnitude", U.speed, {"velocity_magnitude": SPEED}, FIELD, False)
_field("vorticity", U.vorticity, SPIN | {"vorticity_magnitude": SIZE})
_field("divergence", U.divergence, {"divergence": "ux + vy + wz"})
_field("strain_rate_tensor", U.strain_rate, {f"s_{a}{b}": f"({'uvw'[i]}{b} + {'uvw'[j]}{a}) / 2" for i, a in enumerate("xyz") for j, b in enumerate("xyz") if i <= j})
_field("rotation_tensor", U.rotation, {f"r_{a}{b}": f"({'uvw'[i]}{b} - {'uvw'[j]}{a}) / 2" for i, a in enumerate("xyz") for j, b in enumerate("xyz") if i < j})
_field("q_criterion", lambda g: U.invariants(g, 0.01), {"Q": Q2})
_field("delta_criterion", lambda g: U.invariants(g, 0.01), {"delta": f"power({Q2} / 3, 3) + power({DET} / 2, 2)"})
_field("dissipation_rate", lambda g: U.invariants(g, 0.01), {"dissipation": f"0.02 * {STRAIN2}"})
_field("enstrophy", lambda g: U.invariants(g, 0.01), {"enstrophy": f"0.5 * {SIZE} * {SIZE}"})
_field("helicity", lambda g: U.invariants(g, 0.01), {"helicity": HELICITY, "relative_helicity": f"{HELICITY} / nullif({SPEED} * {SIZE}, 0)"})
_field("field_laplacian", lambda f: U.laplacian(f, "u", STEPS), {"laplacian_u": " + ".join(_bend("u", a) for a in "xyz")}, FIELD, False)
_FLOW = {f"mean_{c}": f"avg({c})" for c in "uvw"} | {"tke": "(var_pop(u) + var_pop(v) + var_pop(w)) / 2"} | {f"tau_{a}{b}": f"-1.2 * covar_pop({a}, {b})" for a, b in ("uu", "vv", "ww", "uv", "uw", "vw")}
_add("reynolds_stress", lambda spark, sf_dir: U.turbulence(velocity_field(spark, sf_dir), 1.2).select("field_id", *_FLOW), f"SELECT field_id, {', '.join(f'{v} AS {k}' for k, v in _FLOW.items())} FROM ({FIELD}) GROUP BY 1", " ".join(_FLOW))
_add(
    "field_shape", lambda spark, sf_dir: U.shape(velocity_field(spark, sf_dir)).withColumn("fill", F.col("n_cells") / (F.col("n_x") * F.col("n_y") * F.col("n_z"))),
    f"SELECT field_id, count(DISTINCT ix) AS n_x, count(DISTINCT iy) AS n_y, count(DISTINCT iz) AS n_z, count(*) AS n_cells, 0::BIGINT AS n_missing, count(*) = count(DISTINCT ix) * count(DISTINCT iy) * count(DISTINCT iz) AS is_valid, count(*) / (count(DISTINCT ix) * count(DISTINCT iy) * count(DISTINCT iz)) AS fill FROM ({FIELD}) GROUP BY 1", "fill",
)
_MEANS = {"mean_velocity_magnitude": SPEED, "mean_dissipation": f"0.02 * {STRAIN2}", "mean_enstrophy": f"0.5 * {SIZE} * {SIZE}", "mean_helicity": HELICITY, "mean_Q": Q2}
_add(
    "field_analysis", lambda spark, sf_dir: U.analysis(velocity_field(spark, sf_dir), STEPS, 0.01, 3.0),
    f"""SELECT *, sqrt(2 * mean_tke / 3) * sqrt(15 * 0.01 * 2 * mean_tke / 3 / mean_dissipation) / 0.01 AS taylor_reynolds_number, sqrt(2 * mean_tke / 3) / mean_velocity_magnitude AS turbulence_intensity,
      CASE WHEN reynolds_number < 2300 THEN 'laminar' WHEN reynolds_number < 4000 THEN 'transitional' ELSE 'turbulent' END AS flow_regime FROM (
      SELECT *, mean_velocity_magnitude * 3 / 0.01 AS reynolds_number FROM (SELECT field_id, {", ".join(f"avg({v}) AS {k}" for k, v in _MEANS.items())}, (var_pop(u) + var_pop(v) + var_pop(w)) / 2 AS mean_tke FROM ({GRADIENT}) GROUP BY 1))""",
    " ".join(_MEANS) + " mean_tke reynolds_number taylor_reynolds_number turbulence_intensity",
)


def _lambda2(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [f"d{n}_d{a}" for n in "uvw" for a in "xyz"]
    for pdf in batches:
        yield pdf[AT.split(", ")].assign(lambda2=U.lambda2(pdf[names].to_numpy(float).reshape(-1, 3, 3)))


# the middle root of the characteristic polynomial of S^2 + O^2, by the cosine formula
_S, _O = ([[f"(({'uvw'[i]}{'xyz'[j]} {sign} {'uvw'[j]}{'xyz'[i]}) / 2)" for j in range(3)] for i in range(3)] for sign in "+-")
_M = {f"m{i}{j}": " + ".join(f"{m[i][k]} * {m[k][j]}" for m in (_S, _O) for k in range(3)) for i in range(3) for j in range(3) if i <= j}
_add(
    "lambda2_criterion", lambda spark, sf_dir: U.gradients(velocity_field(spark, sf_dir), STEPS).mapInPandas(_lambda2, "field_id string, ix long, iy long, iz long, lambda2 double"),
    f"""SELECT {AT}, 3 * m - (m + 2 * p * cos(a)) - (m + 2 * p * cos(a + 2 * pi() / 3)) AS lambda2 FROM (SELECT *, acos(greatest(-1, least(1, r))) / 3 AS a FROM (
      SELECT *, ((m00 - m) * ((m11 - m) * (m22 - m) - m12 * m12) - m01 * (m01 * (m22 - m) - m12 * m02) + m02 * (m01 * m12 - (m11 - m) * m02)) / (2 * p * p * p) AS r FROM (
        SELECT *, sqrt(((m00 - m) * (m00 - m) + (m11 - m) * (m11 - m) + (m22 - m) * (m22 - m) + 2 * (m01 * m01 + m02 * m02 + m12 * m12)) / 6) AS p FROM (
          SELECT *, (m00 + m11 + m22) / 3 AS m FROM (SELECT {AT}, {", ".join(f"{v} AS {k}" for k, v in _M.items())} FROM ({GRADIENT}))))))""",
    "lambda2",
)

FLAT = """SELECT l_returnflag AS field_id, l_orderkey % 9 AS ix, l_suppkey % 7 AS iy, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS u, 100 * CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS v FROM lineitem GROUP BY 1, 2, 3"""


def flat_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = [(F.col("l_orderkey") % 9).alias("ix"), (F.col("l_suppkey") % 7).alias("iy")]
    made = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_returnflag").alias("field_id"), *cells)
    return made.agg((F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))).alias("u"), (100 * F.sum(F.col("l_discount").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))).alias("v"))


def _slope2(n: str, a: str) -> str:
    o, h = f"OVER (PARTITION BY field_id, {'iy' if a == 'x' else 'ix'} ORDER BY i{a})", STEPS["xy".index(a)]
    return f"coalesce((lead({n}) {o} - lag({n}) {o}) / {2 * h}, (lead({n}) {o} - {n}) / {h}, ({n} - lag({n}) {o}) / {h})"


for _name, _make, _fields in (
    ("vorticity_2d", U.vorticity, {"omega_z": f"{_slope2('v', 'x')} - {_slope2('u', 'y')}", "vorticity_magnitude": f"abs({_slope2('v', 'x')} - {_slope2('u', 'y')})"}),
    ("divergence_2d", U.divergence, {"divergence": f"{_slope2('u', 'x')} + {_slope2('v', 'y')}"}),
):
    _add(
        _name, lambda spark, sf_dir, make=_make, fields=_fields: make(U.gradients(flat_field(spark, sf_dir), STEPS[:2])).select("field_id", "ix", "iy", *fields),
        f"SELECT field_id, ix, iy, {', '.join(f'{v} AS {k}' for k, v in _fields.items())} FROM ({FLAT})", " ".join(_fields),
    )

_CAVITY = " UNION ALL ".join(f"SELECT '{n}' AS component, {re} AS Re, unnest({at}::DOUBLE[]) AS position, unnest({values}::DOUBLE[]) AS velocity" for n, table, at in (("u", V.U, V.U_AT), ("v", V.V, V.V_AT)) for re, values in table.items())
_add("cavity_profiles", lambda spark, sf_dir: V.lookup(spark), _CAVITY, "position velocity")
_add(
    "cavity_reynolds", lambda spark, sf_dir: V.lookup(spark).groupBy("Re").agg(F.count_distinct("component").alias("n"), F.min("velocity").alias("least")),
    f"SELECT Re, count(DISTINCT component) AS n, min(velocity) AS least FROM ({_CAVITY}) GROUP BY 1", "least",
)

# ---------------------------------------------------------------- numerical routines

PAIRS = "SELECT DISTINCT CAST(l_quantity AS DOUBLE) AS q, CAST(l_discount AS DOUBLE) AS d FROM lineitem"


def _routine(name: str, run: Callable[[float, float], dict], fields: dict[str, str], source: str = PAIRS, real: str | None = None) -> None:
    """run takes a row's q and d; fields are its results with SQL over q and d (or what `source` adds to them)."""
    real = " ".join(fields) if real is None else real
    kinds = {k: "double" if k in real.split() else "boolean" for k in fields}

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [run(q, d) for q, d in zip(pdf["q"].tolist(), pdf["d"].tolist())]
            yield pdf.assign(**{k: [float(r[k]) if kinds[k] == "double" else bool(r[k]) for r in rows] for k in fields})

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        pairs = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_quantity").cast("double").alias("q"), F.col("l_discount").cast("double").alias("d")).distinct()
        return pairs.mapInPandas(work, "q double, d double, " + ", ".join(f"{k} {v}" for k, v in kinds.items()))

    _add(name, query, f"SELECT q, d, {', '.join(f'{v} AS {k}' for k, v in fields.items())} FROM ({source})", real)


def _root(inner: str, low: str, high: str, too_low: str, steps: int = 90) -> str:
    """Rows of PAIRS with z, a root between two borders by halving: too_low says of z whether the root lies above."""
    return f"""WITH RECURSIVE b(q, d, lo, hi, k) AS (SELECT q, d, ({low})::DOUBLE, ({high})::DOUBLE, 0 FROM ({PAIRS}) UNION ALL
      SELECT q, d, CASE WHEN {too_low} THEN z ELSE lo END, CASE WHEN {too_low} THEN hi ELSE z END, k + 1 FROM (SELECT *, (lo + hi) / 2 AS z {inner} FROM b WHERE k < {steps})) SELECT q, d, (lo + hi) / 2 AS z FROM b WHERE k = {steps}"""


_x = "(0.05 + 8 * d)"
_routine("wilson", lambda q, d: dict(zip("ab", T.wilson([0.05 + 8 * d, 0.95 - 8 * d], [[1, 0.5], [0.8, 1]])["ln_gamma"])), {
    "a": f"-ln({_x} + 0.5 * (1 - {_x})) + (1 - {_x}) * (0.5 / ({_x} + 0.5 * (1 - {_x})) - 0.8 / (0.8 * {_x} + 1 - {_x}))",
    "b": f"-ln(1 - {_x} + 0.8 * {_x}) - {_x} * (0.5 / ({_x} + 0.5 * (1 - {_x})) - 0.8 / (0.8 * {_x} + 1 - {_x}))",
})
_g1, _g2 = "exp(-0.15)", "exp(-0.24)"
_routine("nrtl", lambda q, d: dict(zip("ab", T.nrtl([0.05 + 8 * d, 0.95 - 8 * d], [[0, 0.5], [0.8, 0]])["ln_gamma"])), {
    "a": f"pow(1 - {_x}, 2) * (0.8 * pow({_g2} / ({_x} + (1 - {_x}) * {_g2}), 2) + 0.5 * {_g1} / pow(1 - {_x} + {_x} * {_g1}, 2))",
    "b": f"pow({_x}, 2) * (0.5 * pow({_g1} / (1 - {_x} + {_x} * {_g1}), 2) + 0.8 * {_g2} / pow({_x} + (1 - {_x}) * {_g2}, 2))",
})
_uq = f"""SELECT *, {_x} * 2.1 / ({_x} * 2.1 + (1 - {_x}) * 3.2) AS f1, {_x} * 1.9 / ({_x} * 1.9 + (1 - {_x}) * 2.8) AS h1, 5 * (2.1 - 1.9) - 1.1 AS l1, 5 * (3.2 - 2.8) - 2.2 AS l2 FROM ({PAIRS})"""
_routine("uniquac", lambda q, d: {"combinatorial": np.log(T.uniquac([0.05 + 8 * d, 0.95 - 8 * d], [2.1, 3.2], [1.9, 2.8], [[1, 0.7], [0.9, 1]])["gamma_C"][0]), "residual": np.log(T.uniquac([0.05 + 8 * d, 0.95 - 8 * d], [2.1, 3.2], [1.9, 2.8], [[1, 0.7], [0.9, 1]])["gamma_R"][0])}, {
    "combinatorial": f"ln(f1 / {_x}) + 5 * 1.9 * ln(h1 / f1) + l1 - f1 / {_x} * ({_x} * l1 + (1 - {_x}) * l2)",
    "residual": "1.9 * (1 - ln(h1 + 0.9 * (1 - h1)) - h1 / (h1 + 0.9 * (1 - h1)) - 0.7 * (1 - h1) / (0.7 * h1 + 1 - h1))",
}, _uq)
_routine("ideal_solution", lambda q, d: {"gamma": T.ideal([d, 1 - d])["gamma"][0], "G_E_RT": T.ideal([d, 1 - d])["G_E_RT"]}, {"gamma": "1.0", "G_E_RT": "0.0"})
# Peng-Robinson at 300 + 4 q K and (1 + 90 d) bar of a fluid of 370 K and 42.5 bar: the greatest root by halving above the last turning point
_tr, _pr = "((300 + 4 * q) / 370)", "((1 + 90 * d) / 42.5)"
_A, _B = f"(0.45724 * pow(1 + (0.37464 + 1.54226 * 0.15 - 0.26992 * 0.0225) * (1 - sqrt({_tr})), 2) * {_pr} / ({_tr} * {_tr}))", f"(0.0778 * {_pr} / {_tr})"
_c2, _c1, _c0 = f"({_B} - 1)", f"({_A} - 2 * {_B} - 3 * {_B} * {_B})", f"(-({_A} * {_B} - {_B} * {_B} - pow({_B}, 3)))"
_turn = f"CASE WHEN {_c2} * {_c2} > 3 * {_c1} THEN (-{_c2} + sqrt({_c2} * {_c2} - 3 * {_c1})) / 3 ELSE {_B} END"
_cubic = _root("", f"CASE WHEN (pow({_turn}, 3) + {_c2} * pow({_turn}, 2) + {_c1} * ({_turn}) + {_c0}) > 0 THEN {_B} ELSE {_turn} END", "10", f"((z + {_c2}) * z + {_c1}) * z + {_c0} < 0")
_routine("equation_of_state", lambda q, d: T.cubic(300 + 4 * q, (1 + 90 * d) * 1e5, 370.0, 42.5e5, 0.15), {"Z": "z", "V": "z * 8.314462618 * (300 + 4 * q) / ((1 + 90 * d) * 1e5)", "A": _A, "B": _B}, _cubic)
_k1, _k2 = "(1 + q / 20)", "(0.9 - 4 * d)"
_v = f"least(1, greatest(0, -(0.4 * ({_k1} - 1) + 0.6 * ({_k2} - 1)) / (({_k1} - 1) * ({_k2} - 1))))"
_routine("flash", lambda q, d: (lambda f: {"V": f["V"], "x1": f["x"][0], "y1": f["y"][0]})(T.flash([0.4, 0.6], [1 + q / 20, 0.9 - 4 * d], 60)), {
    "V": "v", "x1": f"0.4 / (1 + v * ({_k1} - 1)) / (0.4 / (1 + v * ({_k1} - 1)) + 0.6 / (1 + v * ({_k2} - 1)))", "y1": f"{_k1} * 0.4 / (1 + v * ({_k1} - 1)) / ({_k1} * 0.4 / (1 + v * ({_k1} - 1)) + {_k2} * 0.6 / (1 + v * ({_k2} - 1)))",
}, f"SELECT *, {_v} AS v FROM ({PAIRS})")
ANTOINE = [[6.90565, 1211.033, 220.79], [6.95464, 1344.8, 219.482]]
_ant = [f"pow(10, {a} - {b} / (z - 273.15 + {k}))" for a, b, k in ANTOINE]
_p = "(300 + 10 * q)"
_routine("bubble_point", lambda q, d: (lambda f: {"T": f["T"], "y1": f["y"][0]})(T.bubble_point([0.05 + 8 * d, 0.95 - 8 * d], 300 + 10 * q, ANTOINE)), {
    "T": "z", "y1": f"{_x} * {_ant[0]} / ({_x} * {_ant[0]} + (1 - {_x}) * {_ant[1]})",
}, _root("", "200", "700", f"{_x} * {_ant[0]} + (1 - {_x}) * {_ant[1]} < {_p}"))
_routine("dew_point", lambda q, d: (lambda f: {"T": f["T"], "x1": f["x"][0]})(T.dew_point([0.05 + 8 * d, 0.95 - 8 * d], 300 + 10 * q, ANTOINE)), {
    "T": "z", "x1": f"{_x} / {_ant[0]} / ({_x} / {_ant[0]} + (1 - {_x}) / {_ant[1]})",
}, _root("", "200", "700", f"{_p} * ({_x} / {_ant[0]} + (1 - {_x}) / {_ant[1]}) > 1"))
_routine("vle", lambda q, d: (lambda f: {"V": f["V"], "K1": f["K"][0], "K2": f["K"][1]})(T.vle(340 + q / 2, 760.0, [0.4, 0.6], ANTOINE)), {
    "V": "CASE WHEN 0.4 * k1 + 0.6 * k2 <= 1 THEN 0 WHEN 0.4 / k1 + 0.6 / k2 <= 1 THEN 1 ELSE -(0.4 * (k1 - 1) + 0.6 * (k2 - 1)) / ((k1 - 1) * (k2 - 1)) END", "K1": "k1", "K2": "k2",
}, f"SELECT *, {_ant[0]} / 760 AS k1, {_ant[1]} / 760 AS k2 FROM (SELECT *, 340 + q / 2 AS z FROM ({PAIRS}))")
_fenske = "(ln(0.95 / 0.05 * 0.95 / 0.05) / ln(al))"
_routine("fenske_underwood_gilliland", lambda q, d: (lambda f: {k: f[k] for k in ("N_min", "theta", "R_min", "N_actual")})(T.shortcut_column(0.95, 0.05, 1.5 + q / 25, 1.0, 0.3 + 4 * d)), {
    "N_min": _fenske, "theta": "z", "R_min": "m", "N_actual": f"({_fenske} + 0.75 * (1 - pow(0.2 * m / (1.2 * m + 1), 0.5668))) / (1 - 0.75 * (1 - pow(0.2 * m / (1.2 * m + 1), 0.5668)))",
}, f"SELECT *, al * 0.95 / (al - z) + 0.05 / (1 - z) - 1 AS m FROM (SELECT *, 1.5 + q / 25 AS al FROM ({_root('', '1 + 1e-9', '1.5 + q / 25 - 1e-9', '(1.5 + q / 25) * (0.3 + 4 * d) / (1.5 + q / 25 - z) + (0.7 - 4 * d) / (1 - z) < 0', 100)}))")
_routine("strain_life", lambda q, d: (lambda f: {"logN": np.log10(f["N"]), "transition_life": f["transition_life"]})(M.strain_life(0.002 + q / 5000, 900.0, 0.3 + d, -0.09, -0.6, 2e5)), {
    "logN": "z", "transition_life": "0.5 * pow((0.3 + d) * 2e5 / 900, 1 / 0.51)",
}, _root("", "0", "12", "900 / 2e5 * pow(2 * pow(10, z), -0.09) + (0.3 + d) * pow(2 * pow(10, z), -0.6) > 0.002 + q / 5000", 100))
# a tray's balance as a quadratic: L x + V al x / (1 + (al - 1) x) = inflow
_tl, _al, _inn = "(1 + d)", "(1.5 + q / 25)", "((1 + d) * 0.3 + 2 * 0.6)"
_b = f"({_tl} + 2 * {_al} - {_inn} * ({_al} - 1))"
_tx = f"((-{_b} + sqrt({_b} * {_b} + 4 * {_tl} * ({_al} - 1) * {_inn})) / (2 * {_tl} * ({_al} - 1)))"
_routine("tray_calculation", lambda q, d: D.tray(0.3, 0.6, 1 + d, 2.0, 1.5 + q / 25), {"x": _tx, "y": f"{_al} * {_tx} / (1 + ({_al} - 1) * {_tx})"})
# one degree of freedom, two of them, and linear systems of second order
_w, _zeta = "(1 + q)", "(0.1 + 2 * d)"
_re, _im = f"({_w} * {_w} - 9)", f"(6 * {_zeta} * {_w})"
_routine("frequency_response", lambda q, d: (lambda f: {"magnitude": f["magnitude"][0], "phase": f["phase_rad"][0], "dc_gain": f["dc_gain"]})(K.frequency_response([(1 + q) ** 2], [1, 2 * (0.1 + 2 * d) * (1 + q), (1 + q) ** 2], [3.0])), {
    "magnitude": f"{_w} * {_w} / sqrt({_re} * {_re} + {_im} * {_im})", "phase": f"-atan2({_im}, {_re})", "dc_gain": "1.0",
})
_wd = f"({_w} * sqrt(1 - {_zeta} * {_zeta}))"
_decay = f"exp(-{_zeta} * {_w} * 0.7)"
_routine("step_response", lambda q, d: {"y": K.step_response([(1 + q) ** 2], [1, 2 * (0.1 + 2 * d) * (1 + q), (1 + q) ** 2], np.linspace(0, 0.7, 8))["y"][-1]}, {"y": f"1 - {_decay} * (cos({_wd} * 0.7) + {_zeta} * {_w} / {_wd} * sin({_wd} * 0.7))"})
_routine("impulse_response", lambda q, d: {"y": K.impulse_response([(1 + q) ** 2], [1, 2 * (0.1 + 2 * d) * (1 + q), (1 + q) ** 2], np.linspace(0, 0.7, 8))["y"][-1]}, {"y": f"{_w} * {_w} / {_wd} * {_decay} * sin({_wd} * 0.7)"})
_routine("poles_zeros", lambda q, d: (lambda f: {"re": f["dominant_pole"].real, "im": abs(f["dominant_pole"].imag), "zero": f["zeros"][0].real, "stable": f["stable"]})(K.poles_zeros([1, q], [1, 2 * (0.1 + 2 * d) * (1 + q), (1 + q) ** 2])), {"re": f"-{_zeta} * {_w}", "im": _wd, "zero": "-q", "stable": "true"}, real="re im zero")
_routine("routh_hurwitz", lambda q, d: (lambda f: {"third": f["routh_array"][2, 0], "sign_changes": f["sign_changes"], "stable": f["stable"]})(K.routh([1, 2 + d, q, 40 + d])), {"third": "CASE WHEN (2 + d) * q = 40 + d THEN 2 * (2 + d) ELSE ((2 + d) * q - (40 + d)) / (2 + d) END", "sign_changes": "2 * ((2 + d) * q < 40 + d)::INT", "stable": "(2 + d) * q > 40 + d"}, real="third sign_changes")
_routine("lyapunov_stability_linear", lambda q, d: (lambda f: {"p11": f["P"][0, 0], "p12": f["P"][0, 1], "p22": f["P"][1, 1], "stable": f["stable"]})(K.lyapunov_equation([[0, 1], [-q, -(1 + d)]])), {
    "p11": "(1 + d) / (2 * q) + (1 + q) / (2 * (1 + d))", "p12": "1 / (2 * q)", "p22": "(1 + q) / (2 * q * (1 + d))", "stable": "true",
}, real="p11 p12 p22")
_routine("pole_placement", lambda q, d: (lambda f: {"k1": f["K"][0], "k2": f["K"][1], "success": f["success"]})(K.place([[0, 1], [q, d]], [0, 1], [-2.0, -3.0])), {"k1": "6 + q", "k2": "5 + d", "success": "true"}, real="k1 k2")
_routine("nyquist_stability", lambda q, d: (lambda f: {"closed_loop_unstable_poles": f["closed_loop_unstable_poles"], "stable": f["stable"]})(K.nyquist([q + 0.5], [1, 3, 3, 1])), {"closed_loop_unstable_poles": "CASE WHEN q + 0.5 > 8 THEN 2 ELSE 0 END", "stable": "q + 0.5 < 8"}, real="closed_loop_unstable_poles")
_routine("modal_analysis", lambda q, d: (lambda f: {"w1": f["natural_frequencies"][0] ** 2, "w2": f["natural_frequencies"][1] ** 2})(M.modal([[1, 0], [0, 2]], [[1 + q + 50, -50], [-50, 50]])), {
    "w1": f"(({_w} + 50) + 25) / 2 - sqrt(pow((({_w} + 50) - 25) / 2, 2) + 1250)", "w2": f"(({_w} + 50) + 25) / 2 + sqrt(pow((({_w} + 50) - 25) / 2, 2) + 1250)",
})
_a, _b, _cc = "(q + 60 - 4)", "(60 - 8)", "(2 * (1 + d))"  # (K - 4 M) and 2 C at w = 2
_detr, _deti = f"({_a} * {_b} - {_cc} * {_cc} * 2 - 3600)", f"({_a} * 2 * {_cc} + {_b} * {_cc})"
_routine("modal_frequency_response", lambda q, d: (lambda h: {"re": h.real, "im": h.imag})(M.receptance(2.0, [[1, 0], [0, 2]], [[q + 60, -60], [-60, 60]], [[1 + d, 0], [0, 2 * (1 + d)]], [1, 0])[0]), {
    "re": f"({_b} * {_detr} + 2 * {_cc} * {_deti}) / ({_detr} * {_detr} + {_deti} * {_deti})", "im": f"(2 * {_cc} * {_detr} - {_b} * {_deti}) / ({_detr} * {_detr} + {_deti} * {_deti})",
})
_routine("modal_participation", lambda q, d: (lambda f: {"first": f["effective_mass"][0], "share": f["cumulative_mass_ratio"][-1], "total_mass": f["total_mass"]})(M.participation(np.array([[1, 0], [0, 1.0]]), [[q, 0], [0, 2 + d]], [1, 1])), {"first": "q * q", "share": "(q * q + (2 + d) * (2 + d)) / (q + 2 + d)", "total_mass": "q + 2 + d"})


# ---------------------------------------------------------------- tables of signals, and the way in by names

ENGINES = "SELECT l_returnflag AS unit_id, l_linenumber AS cycle, max(l_quantity)::DOUBLE + 500 AS T2, avg(l_quantity) + 1300 AS T30, max(l_discount)::DOUBLE + 14 AS P2, avg(l_quantity) + 500 AS P30 FROM lineitem GROUP BY 1, 2"


def engines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_returnflag").alias("unit_id"), F.col("l_linenumber").alias("cycle"))
    return rows.agg((F.max("l_quantity").cast("double") + 500).alias("T2"), (F.avg("l_quantity") + 1300).cast("double").alias("T30"), (F.max("l_discount").cast("double") + 14).alias("P2"), (F.avg("l_quantity") + 500).cast("double").alias("P30"))


_EFF = "T2 * (power(P30 / P2, 0.4 / 1.4) - 1) / (T30 - T2)"
_add(
    "compressor_from_signals", lambda spark, sf_dir: G.compressor_from_signals(engines(spark, sf_dir), "T2", "T30", "P2", "P30", True, True).select("unit_id", "cycle", "efficiency", "pressure_ratio"),
    f"SELECT unit_id, cycle, {_EFF} AS efficiency, P30 / P2 AS pressure_ratio FROM ({ENGINES})", "efficiency pressure_ratio",
)
_add(
    "turbine_from_signals", lambda spark, sf_dir: G.turbine_from_signals(engines(spark, sf_dir), "T30", "T2", "P30", "P2", True, True).select("unit_id", "cycle", "efficiency", "expansion_ratio"),
    f"SELECT unit_id, cycle, (T30 - T2) / (T30 - T30 * power(P30 / P2, -0.33 / 1.33)) AS efficiency, P30 / P2 AS expansion_ratio FROM ({ENGINES})", "efficiency expansion_ratio",
)
_add(
    "analyse_turbofan", lambda spark, sf_dir: G.analyse_turbofan(engines(spark, sf_dir)).drop("early_efficiency", "degradation"),
    f"SELECT unit_id, max(cycle) AS n_cycles, avg(e) AS mean_efficiency, avg(e) FILTER (life > 0.9) AS late_efficiency, regr_slope(e, cycle) AS trend FROM (SELECT *, {_EFF} AS e, cycle / max(cycle) OVER (PARTITION BY unit_id) AS life FROM ({ENGINES})) GROUP BY 1", "mean_efficiency late_efficiency trend",
)


def by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One measure of several fields, each called by its name, over the series' means."""
    x = _series(spark, sf_dir).groupBy("series").agg(F.avg("q").alias("q"), F.avg("p").alias("p"))
    calls = {
        "limiting_current": compute("electrochemistry", "limiting_current", "q", 2.0)["i"], "rate": compute("kinetics", "michaelis_menten", 5.0, 2.0, "q")["rate"], "volume": compute("reactors", "cstr_volume", "q", 0.5, 0.1, 2.0)["volume"],
        "absorption_factor": compute("separations", "absorption", 0.5, 0.01, 0, 1.5, "q")["absorption_factor"], "S": compute("crystallization", "supersaturation", "q", 20.0)["S"], "Z_real": compute("impedance", "randles", "q", 10.0, 100.0, 1e-3)["Z_real"],
        "rpm": compute("motor", "motor_frequencies", 50.0, 4.0, F.col("q") / 100)["rpm_rotor"], "FTF": compute("bearing", "defect_frequencies", "q", 8.0, 40.0, 15.0, 1500.0)["FTF"], "N": compute("fatigue", "basquin", "q", 900.0, -0.2)["N"],
        "gear_ratio": compute("gear", "mesh_frequencies", 20.0, "q", 1500.0)["gear_ratio"], "critical_rpm": compute("rotor", "critical_speed", 2.0, "p", 0.0, 1.0)["critical_rpm"], "ln_gamma1": compute("activity", "margules", F.col("q") / 60, 0.5, 0.8)["ln_gamma1"],
        "Re": compute("flow", "reynolds", "q", 0.1, 1e-3)["Re"], "eta": compute("turbomachinery", "brayton_ideal", 288.0, 1400.0, "q")["thermal_efficiency"],
    }
    return x.select("series", *[v.alias(k) for k, v in calls.items()])


_by_name = {
    "limiting_current": "q / (1 + q / 2)", "rate": "5 * q / (2 + q)", "volume": "q * 0.5 / (0.1 * 2 * 0.5)", "absorption_factor": "1.5 / q", "S": "q / 20", "Z_real": "10 + 100 / (1 + power(0.1 * q, 2))", "rpm": "1500 * (1 - q / 100)",
    "FTF": "12.5 * (1 - 0.2 * cos(radians(15)))", "N": "0.5 * power(q / 900, -5)", "gear_ratio": "q / 20", "critical_rpm": "sqrt(p / 2) * 30 / pi()", "ln_gamma1": "power(1 - q / 60, 2) * (0.5 + 0.6 * q / 60)", "Re": "q * 100", "eta": "1 - power(q, -0.4 / 1.4)",
}
_add("by_name", by_name, f"SELECT series, {', '.join(f'{v} AS {k}' for k, v in _by_name.items())} FROM (SELECT series, avg(q) AS q, avg(p) AS p FROM ({SERIES}) GROUP BY series)", " ".join(_by_name))
