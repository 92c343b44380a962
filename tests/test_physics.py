import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.functions.physics import chemical as C
from sigloom.functions.physics import control as L
from sigloom.functions.physics import fluids as U
from sigloom.functions.physics import machines as M
from sigloom.functions.physics import thermal as T
from sigloom.functions.physics import turbines as G


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_closed_forms(spark):
    near = lambda x, rel=1e-3: pytest.approx(x, rel=rel)
    assert value(spark, C.butler_volmer(0.0, 2.0)).i == 0
    assert value(spark, C.arrhenius(1e10, 50000, 300)).k == near(1e10 * math.exp(-50000 / (8.314462618 * 300)))
    two = value(spark, C.arrhenius_two_temperatures(1.0, 300, 2.0, 310))
    assert value(spark, C.arrhenius(two.pre_exponential, two.activation_energy, 310)).k == near(2.0)
    assert value(spark, C.michaelis_menten(10, 2, 2)).rate == near(5)
    assert value(spark, C.batch_reactor_time(1, 0.1, 0.9)).time == near(math.log(10) / 0.1)
    assert value(spark, C.cstr_volume(10, 0.5, 0.1, 2)).volume == near(50) and value(spark, C.pfr_volume(10, 0.5, 0.1, 2)).volume == near(10 * math.log(2) / 0.2)
    assert value(spark, C.power_law_rate(2.0, F.array(F.lit(3.0), F.lit(2.0)), F.array(F.lit(1.0), F.lit(2.0)))).rate == near(24)
    m = value(spark, C.mixed_potential(0.0, 0.5, 1e-3, 1e-4, 0.1, 0.1))
    assert m.i_corr == near(1e-4 * 10 ** ((0.5 - m.E_corr) / 0.1))
    assert value(spark, T.radiation(500, 300)).heat_flux == near(5.670374e-8 * (500**4 - 300**4))
    assert value(spark, T.convection(1, 1, 1e-5, 0.7, 0.026, 350, 300)).Nu == near(0.664 * math.sqrt(1e5) * 0.7 ** (1 / 3))
    x = value(spark, T.heat_exchanger(100, 60, 20, 40, 1000, 2000, 1000))
    assert x.LMTD == near((60 - 40) / math.log(60 / 40)) and 0 < x.effectiveness < 1
    assert value(spark, T.margules(0.5, 1.0)).gamma1 == near(math.exp(0.25))
    w, n = value(spark, T.wilson_binary(0.3, 0.5, 0.8)), value(spark, T.nrtl_binary(0.3, 0.5, 0.8))
    assert [w.gamma1, w.gamma2] == near(T.wilson([0.3, 0.7], [[1, 0.5], [0.8, 1]])["gamma"].tolist()) and [n.gamma1, n.gamma2] == near(T.nrtl([0.3, 0.7], [[0, 0.5], [0.8, 0]])["gamma"].tolist())
    d = value(spark, M.defect_frequencies(9, 7.94, 39.04, 0, 1800))
    assert d.BPFO + d.BPFI == near(9 * 30) and d.BPFO == near(4.5 * 30 * (1 - 7.94 / 39.04))
    assert value(spark, M.randles(1e-6, 10, 100, 1e-5)).Z_real == near(110) and value(spark, M.randles(1e9, 10, 100, 1e-5)).Z_real == near(10)
    assert value(spark, U.scales(1.0, 1e-6, 1.0)).kolmogorov_length == near(1e-6**0.75)


def test_turbines(spark):
    c = value(spark, G.compressor(288.15, 600, 101325, 1013250))
    assert 0.82 < c.efficiency < 0.87 and c.confidence == 1 and c.warnings == []
    assert value(spark, G.compressor(288.15, 400, 101325, 1013250)).warnings == ["impossible"]
    p = value(spark, G.isentropic_to_polytropic(0.85, 10))
    assert value(spark, G.polytropic_to_isentropic(p, 10)) == pytest.approx(0.85) and p > 0.85
    assert value(spark, G.brayton_ideal(300, 1400, 10)).thermal_efficiency == pytest.approx(1 - 10 ** (-0.4 / 1.4))
    assert value(spark, G.corrected(288.15, 101325, 1000, 50)).N_corrected == pytest.approx(1000)
    e = value(spark, G.turbine(1400, 800, 1e6, 1e5))
    assert 0.7 < e.efficiency < 1.1


def test_aggregates(spark):
    t = np.arange(2000) / 1000
    y = 3 * np.sin(2 * np.pi * 50 * t) + 0.3 * np.sin(2 * np.pi * 150 * t)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(t, y)], "t double, y double")
    row = df.agg(*M.harmonics("y", "t", 50.0, 4)).first()
    assert row.fundamental == pytest.approx(3, rel=1e-3) and row.thd == pytest.approx(0.1, rel=1e-2)
    row = df.agg(*M.condition_indicators("y"), *M.power_factor("y", "y")).first()
    assert row.rms == pytest.approx(y.std(), rel=1e-3) and row.pf == pytest.approx(1)
    rtd = spark.createDataFrame([(float(x), math.exp(-x / 5) / 5) for x in np.arange(0, 200, 0.1)], "t double, E double").agg(*C.residence_time("t", "E")).first()
    assert rtd.mean_residence_time == pytest.approx(5, rel=0.02)


def test_numeric():
    out = C.batch_reactor([1.0, 0.0], (0, 10), [0.3], [[-1], [1]], [[1], [0]])
    assert out["C_final"] == pytest.approx([math.exp(-3), 1 - math.exp(-3)], rel=1e-4)
    assert C.cstr([0.0, 0.0], (0, 200), [0.1], [[-1], [1]], [[1], [0]], 10.0, [1.0, 0.0])["C_final"][0] == pytest.approx(0.5, rel=1e-4)
    hot = C.nonisothermal_batch([1.0], 300, (0, 50), [1e3], [2e4], [-5e4], [[-1]], [[1]], 1000, 4.18)
    assert hot["T_final"] > 300 and hot["T_max"] >= hot["T_final"] - 1e-9
    assert C.distillation_stages(0.5, 0.95, 0.05, 1.0 - 1e-9, 2.5, 2.0)["n_stages"] > 5
    z = T.cubic(300, 1e5, 190.6, 4.6e6, 0.011)
    assert 0.99 < z["Z"] < 1 and 0.99 < z["fugacity_coeff"] < 1
    f = T.flash([0.5, 0.5], [2.0, 0.5])
    assert f["V"] == pytest.approx(0.5) and f["y"].tolist() == pytest.approx([2 / 3, 1 / 3])
    water = [[8.07131, 1730.63, 233.426]]
    assert T.bubble_point([1.0], 760, water)["T"] == pytest.approx(373.15, abs=0.1) and T.dew_point([1.0], 760, water)["T"] == pytest.approx(373.15, abs=0.1)
    col = T.shortcut_column(0.95, 0.05, 2.5, 1.0, 0.5)
    assert col["N_actual"] > col["N_min"] > 5 and col["R_actual"] == pytest.approx(1.2 * col["R_min"])
    rows = T.heat_equation(np.sin(np.pi * np.linspace(0, 1, 51)), 1.0, 1e-4, 0.02, 100, 0, 0)
    assert rows[-1][25] == pytest.approx(math.exp(-(np.pi**2) * 0.01), rel=1e-3)
    st = T.stefan(350, 300, 1, 1000, 4000, 3e5, 100)
    assert st["lambda"] * math.exp(st["lambda"] ** 2) * math.erf(st["lambda"]) == pytest.approx(st["stefan_number"] / math.sqrt(math.pi), rel=1e-6)
    cycles = M.rainflow([-2, 1, -3, 5, -1, 3, -4, 4, -2])
    assert sum(n for r, _, n in cycles if r == 4) == 1.5 and sum(n for _, _, n in cycles) == 4
    assert M.strain_life(0.005, 1000, 0.5, -0.09, -0.6, 2e5)["N"] > 100
    modal = M.modal(np.eye(2), [[2, -1], [-1, 2]])
    assert modal["natural_frequencies"] == pytest.approx([1, math.sqrt(3)]) and M.participation(modal["mode_shapes"], np.eye(2), [1, 1])["cumulative_mass_ratio"][-1] == pytest.approx(1)
    w = 2 * np.pi * np.logspace(-2, 4, 60)
    zz = 10 + 1 / (1 / 100 + 1j * w * 1e-4)
    fit = M.fit_randles(w / 2 / np.pi, zz.real, zz.imag)
    assert fit["R_s"] == pytest.approx(10, rel=0.1) and fit["R_ct"] == pytest.approx(100, rel=0.1)
    v = np.sin(2 * np.pi * 50 * np.arange(5000) / 5000) * math.sqrt(2)
    v[1000:2000] *= 0.5
    assert [e[0] for e in M.voltage_events(v, 5000, 1, 50)["events"]] == ["sag"]
    assert U.slope(np.logspace(0, 2, 50), np.logspace(0, 2, 50) ** (-5 / 3))["is_kolmogorov"]


def test_control():
    s = L.step_response([1], [1, 1])
    assert s["y_final"] == 1 and s["rise_time"] == pytest.approx(math.log(9), abs=0.05) and s["settling_time"] == pytest.approx(math.log(50), abs=0.05)
    assert L.routh([1, 2, 3, 1])["stable"] and L.routh([1, 1, 2, 8])["rhp_poles"] == 2
    assert L.nyquist([1], [1, 2, 1])["stable"] and not L.nyquist([10], [1, 2, 1, -1])["stable"]
    m = L.margins([1], [1, 3, 3, 1])
    assert m["gain_margin_db"] == pytest.approx(20 * math.log10(8), abs=0.05)
    assert np.allclose(L.lyapunov_equation([[-1, 0], [0, -2]])["P"], [[0.5, 0], [0, 0.25]])
    assert sorted(L.place([[0, 1], [0, 0]], [0, 1], [-1, -2])["achieved"].real) == pytest.approx([-2, -1])
    u = np.random.default_rng(0).normal(size=300)
    y = np.zeros(300)
    for k in range(1, 300):
        y[k] = 0.7 * y[k - 1] + 2 * u[k - 1]
    a = L.arx(y, u, 1, 1)
    assert a["a"][0] == pytest.approx(-0.7) and a["b"][0] == pytest.approx(2) and a["fit_percent"] == pytest.approx(100)
    z = 5 + np.random.default_rng(1).normal(size=200)
    f = L.filter_sequence(z, [[1]], [[1]], [[1e-6]], [[1]])
    assert f["states"][-1][0] == pytest.approx(5, abs=0.3)
    sm = L.smooth(f["states"], f["covariances"], [[1]], [[1e-6]])
    assert sm["smoothed_states"][0][0] == pytest.approx(sm["smoothed_states"][-1][0], abs=0.05)


def test_fields(spark):
    n, h = 12, 0.5
    rows = [("f", i, j, k, -float(j) * h, float(i) * h, 0.0) for i in range(n) for j in range(n) for k in range(4)]
    df = spark.createDataFrame(rows, "field_id string, ix int, iy int, iz int, u double, v double, w double")
    g = U.invariants(U.divergence(U.gradients(df, (h, h, h))), 1e-3).collect()
    assert all(r.omega_z == pytest.approx(2) and r.divergence == pytest.approx(0) and r.enstrophy == pytest.approx(2) and r.Q == pytest.approx(1) for r in g)
    flat = U.vorticity(U.gradients(df.where("iz = 0").drop("iz", "w"), (h, h)))
    assert all(r.omega_z == pytest.approx(2) for r in flat.collect())
    t = U.turbulence(df).first()
    assert t.tke == pytest.approx((t.cov_uu + t.cov_vv) / 2) and t.tau_uv == pytest.approx(-t.cov_uv)
    x, y = np.meshgrid(np.linspace(-3, 3, 61), np.linspace(-3, 3, 61), indexing="ij")
    spots = U.vortex_centres(np.exp(-((x - 1) ** 2) - y**2) - np.exp(-((x + 1.5) ** 2) - y**2), 0.1, 0.1)
    assert len(spots) == 2 and {round(s["circulation"] > 0) for s in spots} == {0, 1}
    assert U.profile_error([0, 0.5, 1], [0, 1, 0], [0.25], [0.5])["passed"]


def test_cavity_and_columns(spark):
    from sigloom.functions.physics import cavity, columns

    y, u = cavity.profile(1000)
    assert u.min() == -0.38289 and cavity.check(y, u + 0.01, 1000)["passed"] and not cavity.check(y, u + 0.06, 1000)["passed"]
    assert cavity.lookup(spark).where("component = 'u'").count() == 7 * 17
    with pytest.raises(ValueError):
        cavity.profile(7)
    col = columns.simulate(20, 10, 0.5, 2.5, 3.0, 0.5)
    assert col["converged"] and col["x_distillate"] > 0.9 > 0.1 > col["x_bottoms"] and (np.diff(col["x"]) < 0).all()
    assert 0.5 * col["x_distillate"] + 0.5 * col["x_bottoms"] == pytest.approx(0.5, abs=1e-6)
    t = columns.tray(0.5, 0.5, 1, 1, 2.5)
    assert t["x"] + t["y"] == pytest.approx(1.0)
    cool = columns.cooling_crystalliser(0.3, 330, 300, 0.01, 1e6, 1e-7, 2, 1, (-1.2, 0.0045, 0.0))
    assert (np.diff(cool["C"]) <= 1e-9).all() and cool["mu0"][-1] > 0
    with pytest.raises(ImportError):
        columns.umap()


def test_by_name():
    from sigloom.functions.physics import dispatch

    assert dispatch.compute("equilibrium", "flash", [0.4, 0.6], [3.0, 0.5])["phase"] == "two_phase"
    assert dispatch.compute("stability", "routh", [1, 2, 20, 40])["stable"] is False  # poles on the axis
    for field, methods in dispatch.FIELDS.items():
        assert all(callable(f) for f in methods.values()), field
    for bad in (("nothing", "x"), ("heat", "x")):
        with pytest.raises(ValueError, match="no such"):
            dispatch.compute(*bad)
