import math

import numpy as np
import pytest

from sigloom.functions import kernels as K
from sigloom.functions import mathx as M
from sigloom.operators import Signals
from sigloom.operators import engines as E

R = np.random.default_rng(42)
T = np.arange(1000.0)
WALK, NOISE, SINE, TREND = np.cumsum(R.normal(size=1000)), R.normal(size=1000), np.sin(np.linspace(0, 20 * np.pi, 1000)), T + 10 * R.normal(size=1000)


def frame(spark, series, entity="e"):
    rows = [(entity, s, float(i), float(v), None, "time") for s, y in series.items() for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "entity_id string, signal_id string, I double, y double, unit string, dimension string")


def test_signal_kernels():
    assert 0.3 < K.hurst_rs(T, NOISE)["hurst"] < 0.75 and K.hurst_rs(T, TREND)["hurst"] > 0.6 and K.hurst_rs(T, WALK)["hurst_r2"] > 0.5
    assert 0.35 < K.hurst(T, NOISE)["hurst"] < 0.65 and K.hurst(T, WALK)["hurst"] > 0.9
    assert K.permutation_entropy(T, NOISE)["permutation_entropy"] > 0.95 and K.permutation_entropy(T, T)["permutation_entropy"] == 0
    assert K.sample_entropy(T, NOISE[:500])["sample_entropy"] > K.sample_entropy(T, SINE[:500])["sample_entropy"] > 0
    assert abs(K.fft(T, SINE)["dominant_freq"] - 0.01) < 0.002 and K.spectral_slope(T, WALK)["slope"] > 1.2
    assert K.rqa(T, SINE)["determinism"] > K.rqa(T, NOISE)["determinism"]
    h = K.hilbert(T, SINE)
    assert abs(h["amplitude_mean"] - 1) < 0.05 and abs(h["frequency_mean"] - 0.01) < 0.001
    logistic = [0.3]
    for _ in range(999):
        logistic.append(4 * logistic[-1] * (1 - logistic[-1]))
    assert K.lyapunov(T, np.array(logistic))["is_chaotic"] and K.typology(T, SINE)["repetition"] == "periodic"
    assert sum(K.wavelet(T, NOISE)["energy_by_scale"]) == pytest.approx(1)
    r, v = [], 1.0
    for e in R.normal(size=3000):
        r.append(math.sqrt(v) * e)
        v = 0.1 + 0.15 * r[-1] ** 2 + 0.75 * v
    g = K.garch(None, np.cumsum(r))
    assert g["garch_method"] == "mle" and abs(g["garch_persistence"] - 0.9) < 0.12
    assert K.attractor(T, SINE)["attractor_type"] == "limit_cycle"


@pytest.mark.parametrize("name", sorted(E.KERNELS))
def test_every_kernel_takes_short_constant_and_wild_series(spark, name):
    series = {"a": NOISE[:130], "b": WALK[:130], "c": np.full(130, 2.0), "d": SINE[:130]}
    got = E.apply(Signals(frame(spark, series)), name)
    assert got.columns[0] == "entity_id" and got.count() >= 1
    E.apply(Signals(frame(spark, {"a": NOISE[:3], "b": SINE[:3]})), name).count()


def test_sampled_kernels_over_all_vectors():
    """Without a bound, every vector is used; series shorter than the bound give the same with it."""
    short = WALK[:400]
    assert K.rqa(None, short) == K.rqa(None, short, most=None) and K.rqa(None, WALK, most=None) != K.rqa(None, WALK)
    x = M.embed(WALK, 3, 1)
    near = M.distances(x) < 0.1 * np.ptp(WALK)
    assert K.rqa(None, WALK, most=None)["recurrence_rate"] == pytest.approx((near.sum() - len(x)) / (len(x) * (len(x) - 1)))
    assert K.lyapunov(None, NOISE, most=None)["lyapunov"] == pytest.approx(K.lyapunov(None, NOISE, most=10**6)["lyapunov"])


def test_recurrence_query_takes_all_vectors_and_ties(spark):
    """Over 500 points; many distances of the second series are the radius itself, which is not near."""
    steps = np.tile([0.0, 2, 2, 9, 4, 10, 1, 3, 3, 7], 60) + 1e6
    series = {"walk": WALK, "steps": np.append(steps, 30 + 1e6)}
    got = {r.signal_id: r for r in E.apply(Signals(frame(spark, series)), "rqa").collect()}
    for name, y in series.items():
        x = M.embed(y, 3, 1)
        near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) < 0.1 * np.ptp(y)
        off = int(near.sum()) - len(x)
        runs = [len(r) for k in range(1, len(x)) for r in "".join("01"[b] for b in np.diagonal(near, k).astype(int)).split("0") if len(r) > 1]
        tall = [len(r) for row in near for r in "".join("01"[b] for b in row.astype(int)).split("0") if len(r) > 1]
        assert got[name].recurrence_rate == pytest.approx(off / (len(x) * (len(x) - 1)), rel=1e-12)
        assert got[name].max_diagonal == max(runs) and got[name].avg_diagonal == pytest.approx(np.mean(runs))
        assert got[name].determinism == pytest.approx(min(1, sum(runs) / off)) and got[name].trapping_time == pytest.approx(np.mean(tall) if tall else 0)


def test_density_without_the_square():
    x = np.concatenate([R.normal(size=(150, 4)) * 0.2, R.normal(size=(150, 4)) * 0.2 + 3, R.uniform(-5, 8, (60, 4))])
    close = M.distances(x) <= 0.5
    core = close.sum(1) >= 5
    got = M.dbscan(x, 0.5, 5)
    # core points that are close share a cluster; noise has no core point near it
    for i in np.flatnonzero(core):
        assert (got[np.flatnonzero(close[i] & core)] == got[i]).all()
    assert all((got[i] < 0) == (not (close[i] & core).any()) for i in range(len(x)))
    d = M.distances(x)
    assert np.allclose(np.concatenate([rows for _, rows in M.distance_rows(x, 50)]), d)


def test_pair_kernels():
    a = R.normal(size=600)
    b = np.roll(a, 2) + 0.3 * R.normal(size=600)
    assert K.granger(a, b)["is_causal"] and K.granger(a, b)["f_stat"] > K.granger(b, a)["f_stat"]
    assert K.cointegration(WALK, 2 * WALK + NOISE)["is_cointegrated"] and not K.cointegration(WALK, np.cumsum(R.normal(size=1000)))["is_cointegrated"]
    x, y = R.normal(size=20), R.normal(size=17)
    d = np.full((21, 18), np.inf)
    d[0, 0] = 0
    for i in range(20):
        for j in range(17):
            d[i + 1, j + 1] = abs(x[i] - y[j]) + min(d[i, j], d[i, j + 1], d[i + 1, j])
    assert K.dtw(x, y)["dtw_distance"] == pytest.approx(d[20, 17]) and K.dtw(x, x)["dtw_distance"] == 0
    tau = np.mean([np.sign((x[i] - x[j]) * (b[i] - b[j])) for i in range(20) for j in range(i)])
    assert K.copula(x, b[:20])["kendall_tau"] == pytest.approx(tau)
    assert K.divergence(NOISE, NOISE)["js"] == pytest.approx(0) and K.divergence(NOISE, NOISE + 1)["wasserstein"] == pytest.approx(1)


def test_entity_kernels():
    x = np.column_stack([WALK, 2 * WALK + 0.01 * NOISE, NOISE])
    assert K.pca(x, list("abc"), T)["variance_1"][0] > 0.6
    tree = K.tree(x, list("abc"), T)
    assert len(tree["distance"]) == 2 and {tree["source"][0], tree["target"][0]} == {"a", "b"}
    turn = np.column_stack([np.cos(0.1 * T), np.sin(0.1 * T)])
    assert np.allclose(np.abs(K.dmd(turn, ["a", "b"], T)["frequency"]), 0.1 / (2 * np.pi), atol=1e-6)
    blobs = np.vstack([R.normal(m, 0.1, (50, 2)) for m in (0, 5, 10)])
    label, _, _ = M.kmeans(blobs, 3)
    assert len({tuple(label[i * 50 : i * 50 + 50]) for i in range(3)}) == 3 and all(len(set(label[i * 50 : i * 50 + 50])) == 1 for i in range(3))
    assert M.outlier_factor(np.vstack([blobs[:50], [[9, 9]]])).argmax() == 50 and set(M.dbscan(blobs, 0.5, 5)) >= {0, 1, 2}
    assert M.f_tail(4.0, 2, 10) == pytest.approx(0.0531, abs=2e-4)


def test_entities_do_not_mix(spark):
    one, two = frame(spark, {"a": NOISE[:200], "b": WALK[:200]}, "x"), frame(spark, {"a": SINE[:200], "b": TREND[:200]}, "y")
    for name in ("granger", "hurst", "pca"):
        both = sorted(map(str, E.apply(Signals(one.union(two)), name).collect()))
        apart = sorted(map(str, E.apply(Signals(one), name).collect() + E.apply(Signals(two), name).collect()))
        assert both == apart


def test_windows_and_points(spark):
    s = Signals(frame(spark, {"a": NOISE[:460]}))
    rows = E.windowed(s, "permutation_entropy").orderBy("window").collect()
    assert [r.window for r in rows] == list(range(14)) and rows[3].permutation_entropy == pytest.approx(K.permutation_entropy(None, NOISE[60:260])["permutation_entropy"])
    at = E.around(s, "permutation_entropy", 455.0).first()
    assert at.permutation_entropy == pytest.approx(K.permutation_entropy(None, NOISE[260:460])["permutation_entropy"])


def test_work_order(spark):
    out = E.run_order(Signals(frame(spark, {"walk": WALK, "sine": SINE})))
    assert set(out) == {"hurst", "lyapunov", "fft", "garch", "wavelet", "rqa", "sample_entropy"} and out["hurst"].count() >= 1


def test_attractor_uses_the_whole_signal():
    t = np.arange(6500)
    late = np.where(t < 5000, np.sin(0.1 * t), np.random.default_rng(5).normal(size=len(t)))
    head, whole = K.attractor(t[:5000], late[:5000]), K.attractor(t, late)
    assert head["attractor_type"] == "limit_cycle"
    assert (whole["attractor_dim"], whole["correlation_dim"]) != (head["attractor_dim"], head["correlation_dim"])


def test_quantiles_in_blocks(monkeypatch):
    monkeypatch.setattr(K, "_rows", lambda n: [(a, min(n, a + 7)) for a in range(0, n, 7)])
    x = np.random.default_rng(1).normal(size=(150, 3)).round(1)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))[np.triu_indices(150, 1)]
    got, total = K._quantiles(x, (0.02, 0.5))
    assert total == (d > 0).sum() and np.allclose(got, np.quantile(d[d > 0], (0.02, 0.5)), rtol=1e-12)
