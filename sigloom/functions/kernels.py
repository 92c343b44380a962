"""Kernels on series: f(I, y) for a signal, f(a, b) for a pair of aligned series, f(matrix) for an entity's signals.

Each returns a dict (one row), or a dict of arrays (a row for each element). Short or degenerate series give NaN, and the
method is named where there are several. Quadratic kernels keep the usual limits on vectors, as documented with each.
"""

from __future__ import annotations

import math

import numpy as np

from sigloom.functions import mathx as M
from sigloom.functions.physics import control, machines

NAN = float("nan")


# ---------------------------------------------------------------- signals


def hurst_rs(I, y, least=10):
    n = len(y)
    sizes = [n >> k for k in range(int(math.log2(n / least)) + 1)] if n >= 2 * least else []
    found = []
    for w in (s for s in sizes if s >= least):
        x = y[: n // w * w].reshape(-1, w)
        walk = np.cumsum(x - x.mean(1, keepdims=True), 1)
        s = x.std(1, ddof=1)
        if (s > 0).any():
            found.append((w, ((walk.max(1) - walk.min(1))[s > 0] / s[s > 0]).mean()))
    if len(sizes) < 3 or len(found) < 2:
        return {"hurst": 0.5, "hurst_r2": 0.0, "hurst_method": "rs"}
    slope, _, r2 = M.line(np.log([f[0] for f in found]), np.log([f[1] for f in found]))
    return {"hurst": float(np.clip(slope, 0, 1)), "hurst_r2": r2, "hurst_method": "rs"}


def hurst(I, y, least=10):
    """Detrended fluctuations."""
    n = len(y)
    sizes, w = [], least
    while w <= n // 4:
        sizes.append(w)
        w = int(w * 1.5)
    if len(sizes) < 3:
        return {"hurst": 0.5, "hurst_r2": 0.0, "hurst_method": "dfa"}
    walk, found = np.cumsum(y - y.mean()), []
    for w in sizes:
        x = walk[: n // w * w].reshape(-1, w)
        t = np.arange(w) - (w - 1) / 2
        trend = x.mean(1, keepdims=True) + (x @ t / (t @ t))[:, None] * t
        found.append(math.sqrt(((x - trend) ** 2).mean()))
    if min(found) <= 0:
        return {"hurst": 0.5, "hurst_r2": 0.0, "hurst_method": "dfa"}
    slope, _, r2 = M.line(np.log(sizes), np.log(found))
    return {"hurst": float(np.clip(slope, 0, 1)), "hurst_r2": r2, "hurst_method": "dfa"}


def acf_decay(I, y, lags=50):
    out = {"acf_decay_rate": NAN, "half_life": NAN, "acf_1": NAN, "acf_5": NAN}
    if len(y) < lags + 10:
        return out
    a = M.acf(y, lags)
    out |= {"acf_1": float(a[1]), "acf_5": float(a[5])}
    k = np.flatnonzero(a > 0.01)
    if len(k) > 5:
        rate = -M.line(k, np.log(a[k]))[0]
        out |= {"acf_decay_rate": rate, "half_life": math.log(2) / rate if rate > 0 else math.inf}
    return out


def spectral_slope(I, y):
    n = len(y)
    f = np.arange(n // 2) / n if n else np.zeros(0)
    use = (f > 0.01) & (f < 0.4)
    if n < 16 or use.sum() < 5:
        return {"slope": 0.0, "slope_r2": 0.0}
    power = np.abs(np.fft.fft(y - y.mean())[: n // 2]) ** 2
    slope, _, r2 = M.line(np.log(f[use]), np.log(power[use] + 1e-10))
    return {"slope": -slope, "slope_r2": r2}


def fft(I, y):
    names = ("spectral_centroid", "spectral_bandwidth", "low_high_ratio", "spectral_rolloff", "dominant_freq", "total_power")
    n = len(y)
    if n < 16:
        return dict.fromkeys(names, NAN)
    power, f = np.abs(np.fft.fft(y - y.mean())[1 : n // 2]) ** 2, np.arange(1, n // 2) / n
    total = power.sum()
    if total < 1e-10:
        return dict.fromkeys(names, NAN)
    p = power / total
    centre = (f * p).sum()
    high = p[f >= 0.1].sum() if (f >= 0.1).any() else 1e-10
    roll = f[min(int(np.searchsorted(np.cumsum(p), 0.85)), len(f) - 1)]
    return dict(zip(names, map(float, (centre, math.sqrt((((f - centre) ** 2) * p).sum()), p[f < 0.1].sum() / high, roll, f[power.argmax()], total))))


def _hilbert(I, y):
    z = M.analytic(y - y.mean())
    phase = np.unwrap(np.angle(z))
    dt = float(np.median(np.diff(I)))
    return np.abs(z), phase, np.gradient(phase) / (2 * np.pi * dt + 1e-10)


def hilbert_points(I, y):
    if len(y) < 10:
        return {"I": I, **{k: np.full(len(I), NAN) for k in ("amplitude", "phase", "frequency")}}
    return dict(zip(("I", "amplitude", "phase", "frequency"), (I, *_hilbert(I, y))))


def hilbert(I, y):
    names = [f"{c}_{k}" for c in ("amplitude", "phase", "frequency") for k in ("mean", "std")]
    if len(y) < 10:
        return dict.fromkeys(names, NAN)
    return dict(zip(names, (float(v) for x in _hilbert(I, y) for v in (x.mean(), x.std()))))


def wavelet(I, y):
    if len(y) < 16:
        return {"energy_by_scale": [], "dominant_scale": -1, "scale_entropy": NAN, "low_high_ratio": NAN, "finest_std": NAN}
    levels = M.wavelet_levels(y - y.mean())
    energy = np.array([(x * x).sum() for x in levels])
    p = energy / max(energy.sum(), 1e-300)
    q, half = p[p > 0], len(p) // 2
    return {
        "energy_by_scale": p.tolist(), "dominant_scale": int(p.argmax()), "scale_entropy": float(-(q * np.log(q)).sum()),
        "low_high_ratio": float(p[:half].sum() / max(p[half:].sum(), 1e-10)), "finest_std": float(levels[-1].std()),
    }


def _matches(y, dim, tolerance):
    x = np.stack([y[i : i + len(y) - dim] for i in range(dim)], 1)
    total = 0
    for at in range(0, len(x), 512):  # in blocks, so that memory does not grow with the square
        d = np.abs(x[at : at + 512, None, 0] - x[None, at:, 0])
        for j in range(1, dim):
            np.maximum(d, np.abs(x[at : at + 512, None, j] - x[None, at:, j]), out=d)
        close = d < tolerance
        total += int(np.triu(close[:, : len(close)], 1).sum() + close[:, len(close) :].sum())
    return total


def sample_entropy(I, y, m=2, r=0.2):
    tolerance = r * y.std(ddof=1) if len(y) >= m + 2 else NAN
    if not tolerance > 0:
        return {"sample_entropy": 0.0 if tolerance == 0 else NAN}
    a, b = _matches(y, m + 1, tolerance), _matches(y, m, tolerance)
    return {"sample_entropy": NAN if b == 0 else -math.log(a / b) if a else math.inf}


def permutation_entropy(I, y, order=3):
    n = len(y) - order + 1
    if n < 1:
        return {"permutation_entropy": NAN, "n_patterns": 0}
    ranks = np.argsort(M.embed(y, order, 1), 1, kind="stable")
    _, count = np.unique(ranks, axis=0, return_counts=True)
    p = count / n
    return {"permutation_entropy": float(abs((p * np.log2(p)).sum()) / math.log2(math.factorial(order))), "n_patterns": len(count)}


def entropy_rate(I, y, window=100, step=50):
    """Change of permutation entropy from each window to the next."""
    at = range(0, max(0, len(y) - window) + 1, step)
    e = np.array([permutation_entropy(None, y[a : a + window])["permutation_entropy"] for a in at])
    return {"I": np.array([I[min(a + window // 2, len(I) - 1)] for a in at]), "current_entropy": e, "entropy_rate": np.append(0.0, np.diff(e))}


def _delay(y):
    a = M.acf(y, min(len(y) // 4, 200))
    for k in range(1, len(a) - 1):
        if a[k] <= 0 or (a[k] < a[k - 1] and a[k] <= a[k + 1]):
            return k
    return 1


def lyapunov(I, y, most=300):
    """Rosenstein's divergence of near neighbours, over `most` starting vectors spread over the series (None: all), in blocks."""
    out = {"lyapunov": NAN, "is_chaotic": False, "embedding_dim": -1, "delay": -1, "lyapunov_method": "insufficient_data"}
    if len(y) < 100 or y.std() == 0:
        return out
    delay, dim = _delay(y), min(10, max(3, len(y) // 50))
    x = M.embed(y, dim, delay)
    if len(x) < 30:
        return out
    m = len(x) - 10
    use = np.arange(m) if most is None else np.unique(np.linspace(0, m - 1, min(most, m)).astype(int))
    near = np.empty(len(use), np.int64)
    for a in range(0, len(use), 256):
        some = use[a : a + 256]
        d = sum((x[some, j, None] - x[None, :m, j]) ** 2 for j in range(dim))
        d[np.abs(some[:, None] - np.arange(m)) <= max(3, delay)] = np.inf
        near[a : a + 256] = d.argmin(1)
    grow = [np.log(np.maximum(np.sqrt(((x[use + k] - x[near + k]) ** 2).sum(1)), 1e-12)).mean() for k in range(10)]
    slope = M.line(np.arange(10), grow)[0]
    return {"lyapunov": slope, "is_chaotic": slope > 0.01, "embedding_dim": dim, "delay": delay, "lyapunov_method": "rosenstein"}


def embedding(I, y):
    a = M.acf(y, max(1, len(y) // 2)) if len(y) > 3 else np.ones(2)
    below = np.flatnonzero(a < 0)
    delay = int(below[0]) if len(below) else max(1, len(y) // 10)
    return {"embedding_delay": delay, "embedding_dim": max(2, min(int(math.log2(delay + 1)) + 2, 10))}


def _rows(n):
    """Blocks of rows, so that a block of distances to n vectors has some million elements."""
    step = max(1, 2_000_000 // max(1, n))
    return [(a, min(n, a + step)) for a in range(0, n, step)]


def _gaps(x, y):
    return np.sqrt(sum((x[:, None, j] - y[None, :, j]) ** 2 for j in range(x.shape[1])))


def _pairs(x):
    """The positive distances of all pairs, in blocks."""
    for a, b in _rows(len(x)):
        d = _gaps(x[a:b], x[a:])[np.arange(len(x) - a) > np.arange(b - a)[:, None]]
        yield d[d > 0]


def _quantiles(x, shares):
    """Exact quantiles of those distances, and their number: digits of 16 bits, from the highest, of the ranks asked for."""
    total = sum(len(d) for d in _pairs(x))
    if not total:
        return [NAN] * len(shares), 0
    places = [q * (total - 1) for q in shares]
    ranks = sorted({r for p in places for r in (math.floor(p), math.ceil(p))})
    known, left = dict.fromkeys(ranks, 0), {r: r for r in ranks}
    for shift in (48, 32, 16, 0):
        counts = {v: np.zeros(1 << 16, np.int64) for v in known.values()}
        for d in _pairs(x):
            bits = d.view(np.uint64) >> np.uint64(shift)
            for v, count in counts.items():
                mine = bits[bits >> np.uint64(16) == v] if shift < 48 else bits
                count += np.bincount((mine & np.uint64(0xFFFF)).astype(np.int64), minlength=1 << 16)
        for r in ranks:
            below = np.cumsum(counts[known[r]])
            digit = int(np.searchsorted(below, left[r], side="right"))
            left[r] -= int(below[digit - 1]) if digit else 0
            known[r] = known[r] << 16 | digit
    value = {r: float(np.uint64(v).view(np.float64)) for r, v in known.items()}
    return [value[math.floor(p)] + (value[math.ceil(p)] - value[math.floor(p)]) * (p - math.floor(p)) for p in places], total


def attractor(I, y):
    """Delay by the first minimum of mutual information, dimension by false neighbours, correlation dimension by counts in 20 radii.

    All vectors are used, in blocks: the time grows with their square, the memory in proportion.
    """
    out = {"attractor_dim": -1, "attractor_delay": -1, "correlation_dim": NAN, "lyapunov": NAN, "attractor_type": "unknown"}
    if len(y) < 100 or y.std() == 0:
        return out
    info = []
    for k in range(1, min(50, len(y) // 10)):
        p = np.histogram2d(y[:-k], y[k:], 16)[0] / (len(y) - k)
        q = p.sum(1)[:, None] * p.sum(0)[None]
        info.append(float((p[p > 0] * np.log(p[p > 0] / q[p > 0])).sum()))
        if len(info) > 2 and info[-2] < info[-3] and info[-2] <= info[-1]:
            break
    delay = len(info) - 1 if len(info) > 2 else 1
    dim = 10
    for k in range(1, 10):
        x = M.embed(y, k + 1, delay)
        if len(x) < 20:
            break
        gap = np.empty(len(x))
        for a, b in _rows(len(x)):
            d = _gaps(x[a:b, :k], x[:, :k])
            d[np.arange(b - a), np.arange(a, b)] = np.inf
            near = d.argmin(1)
            gap[a:b] = np.abs(x[a:b, k] - x[near, k]) / np.maximum(d[np.arange(b - a), near], 1e-12)
        if (gap > 15).mean() < 0.01:
            dim = k
            break
    x = M.embed(y, dim, delay)
    (low, high), total = _quantiles(x, (0.02, 0.5))
    corr = NAN
    if total > 100:
        radii = np.geomspace(low, high, 20)
        counts = sum(np.searchsorted(np.sort(d), radii) for d in _pairs(x)) / total
        slope, _, r2 = M.line(np.log(radii[counts > 0]), np.log(counts[counts > 0]))
        corr = slope if r2 >= 0.9 else NAN
    kind = "unknown" if math.isnan(corr) else "fixed_point" if corr < 0.5 else "limit_cycle" if corr < 1.5 else "torus" if corr < 2.5 else "strange"
    return {"attractor_dim": dim, "attractor_delay": delay, "correlation_dim": corr, "lyapunov": lyapunov(I, y)["lyapunov"], "attractor_type": kind}


def basin(I, y):
    x = M.embed(y, 3, 1)
    if len(x) < 20:
        return {"basin": "unknown", "stability": NAN, "transition_prob": NAN, "mean_distance": NAN}
    base = x[: max(5, len(x) * 3 // 10)]
    centre = base.mean(0)
    own, d = np.linalg.norm(base - centre, axis=1), np.linalg.norm(x - centre, axis=1)
    limit = own.mean() + 3 * own.std()
    now = d[-max(5, len(x) // 10) :].mean()
    p = 1 / (1 + math.exp(-float(np.clip((now - limit) / max(own.std(), 1e-10), -50, 50))))
    return {"basin": "home" if now <= limit else "escaped", "stability": float((d <= limit).mean()), "transition_prob": p, "mean_distance": float(d.mean())}


def garch(I, y):
    """Zero-mean GARCH(1, 1) on differences by maximum likelihood; by moments where that does not settle."""
    names = ("garch_omega", "garch_alpha", "garch_beta", "garch_persistence", "garch_loglik", "garch_method")
    r = np.diff(y)
    r = r[np.isfinite(r)]
    if len(r) < 20 or r.std() < 1e-10:
        return dict(zip(names, (NAN,) * 5 + ("insufficient_data",)))
    scale = r.std()
    x2 = (r / scale) ** 2

    def loss(p):
        omega, alpha, beta = np.exp(p[0]), 1 / (1 + np.exp(-p[1])), 1 / (1 + np.exp(-p[2]))
        if alpha + beta >= 0.999:
            return 1e10
        v, total = x2.mean(), 0.0
        for e in x2:
            total += math.log(v) + e / v
            v = omega + alpha * e + beta * v
        return total / 2

    p = M.simplex(loss, np.array([math.log(0.1), -2.2, 1.4]), 120)
    omega, alpha, beta = float(np.exp(p[0])) * scale**2, float(1 / (1 + np.exp(-p[1]))), float(1 / (1 + np.exp(-p[2])))
    value = loss(p)
    if value < 1e9:
        like = -value - len(r) * (math.log(scale) + 0.5 * math.log(2 * math.pi))
        return dict(zip(names, (omega, alpha, beta, alpha + beta, like, "mle")))
    return garch_moments(I, y)


def garch_moments(I, y):
    r2 = np.diff(y) ** 2
    lasting = float(np.clip(np.corrcoef(r2[:-1], r2[1:])[0, 1], 0, 0.999)) if r2.std() > 0 else 0.5
    alpha = float(np.clip(0.15 * lasting, 0.01, 0.3))
    beta = float(np.clip(lasting - alpha, 0, 0.99))
    return dict(zip(("garch_omega", "garch_alpha", "garch_beta", "garch_persistence", "garch_loglik", "garch_method"), (float(r2.mean()) * max(1 - alpha - beta, 0.001), alpha, beta, alpha + beta, NAN, "moments")))


def _runs(bits):
    """Lengths of runs of ones along the last axis of a matrix padded with noughts."""
    edge = np.diff(np.pad(bits.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    return np.nonzero(edge == -1)[1] - np.nonzero(edge == 1)[1]


def rqa(I, y, most=500):
    """Recurrence in an embedding of 3/1, radius a tenth of the range; diagonals of the upper triangle, columns of the whole.

    `most` vectors spread over the series are used, or all (None): a diagonal and a row at a time, so memory is in proportion.
    """
    names = ("recurrence_rate", "determinism", "laminarity", "rqa_entropy", "trapping_time", "max_diagonal", "avg_diagonal")
    if len(y) < 50 or np.ptp(y) == 0:
        return dict.fromkeys(names, NAN)
    x = M.embed(y, 3, 1)
    if most is not None:
        x = x[np.linspace(0, len(x) - 1, min(most, len(x))).astype(int)]
    n, radius, sides = len(x), 0.1 * np.ptp(y), list(x.T.copy())

    def close(left, right):
        # from differences, in order: a product of the vectors would settle ties with the radius by rounding
        return np.sqrt(sum((c[left] - c[right]) ** 2 for c in sides)) < radius

    off, tall, lines, block = 0, [], [], max(1, (1 << 20) // n)
    for a in range(0, n, block):
        near = close((slice(a, a + block), None), (None, slice(None)))
        off += int(near.sum()) - int(near[np.arange(len(near)), np.arange(a, a + len(near))].sum())
        tall.append(_runs(near))
    for k in range(1, n):
        lines.append(_runs(close(slice(k, None), slice(n - k))[None]))
    lines, upright = np.concatenate(lines), np.concatenate(tall)
    long, tall = lines[lines >= 2], upright[upright >= 2]
    p = np.bincount(long)[1:] / len(long) if len(long) else np.zeros(1)
    p = p[p > 0]
    values = (off / (n * (n - 1)), min(1.0, long.sum() / off) if off else 0.0, min(1.0, tall.sum() / off) if off else 0.0, float(-(p * np.log(p)).sum()), tall.mean() if len(tall) else 0.0, long.max() if len(long) else 0, long.mean() if len(long) else 0.0)
    return dict(zip(names, map(float, values)))


def typology(I, y):
    """Predictability, repetition, a standard form, symmetry and the place of the power."""
    n = len(y)
    if n < 30 or y.std() == 0:
        return {"predictability": "unknown", "repetition": "unknown", "standard_form": "constant" if n and y.std() == 0 else "unknown", "symmetry": NAN, "frequency_content": "unknown", "dominant_ratio": NAN}
    a = M.acf(y, min(50, n // 3))
    power = np.abs(np.fft.rfft(y - y.mean())[1:]) ** 2
    ratio = float(power.max() / power.sum())
    slow = power[: max(1, len(power) // 5)].sum() / power.sum()
    t = np.linspace(0, 1, n)
    fit = lambda x: M.line(x, y)[2]
    flat = spectral_slope(I, y)["slope"]
    form = (
        "sinusoid" if ratio > 0.5 else "ramp" if fit(t) > 0.9 else "parabolic" if np.corrcoef(np.polyval(np.polyfit(t, y, 2), t), y)[0, 1] ** 2 > 0.9
        else "step" if np.abs(y[: n // 2].mean() - y[n // 2 :].mean()) > 3 * max(y[: n // 2].std(), y[n // 2 :].std()) else "impulse" if np.abs(y - y.mean()).max() > 8 * y.std()
        else "white_noise" if flat < 0.5 else "pink_noise" if flat < 1.5 else "brown_noise"
    )
    d = np.sort(y - np.median(y))
    return {
        "predictability": "deterministic" if a[min(10, len(a) - 1)] > 0.8 else "stochastic" if a[min(10, len(a) - 1)] < 0.1 else "mixed",
        "repetition": "periodic" if ratio > 0.5 else "quasi_periodic" if ratio > 0.2 else "aperiodic", "standard_form": form,
        "symmetry": float(np.corrcoef(d, -d[::-1])[0, 1]), "frequency_content": "low" if slow > 0.8 else "high" if slow < 0.2 else "broad", "dominant_ratio": ratio,
    }


def laplace_series(I, y):
    """First and second differences of second order, one-sided at the ends."""
    if len(y) < 4:
        return {"I": I, "gradient": np.full(len(I), NAN), "laplacian": np.full(len(I), NAN), "field": ["short"] * len(I)}
    g = np.gradient(y, edge_order=2)
    lap = np.empty(len(y))
    lap[1:-1] = y[2:] - 2 * y[1:-1] + y[:-2]
    lap[0], lap[-1] = 2 * y[0] - 5 * y[1] + 4 * y[2] - y[3], 2 * y[-1] - 5 * y[-2] + 4 * y[-3] - y[-4]
    return {"I": I, "gradient": g, "laplacian": lap, "field": np.where(lap > 0.1, "source", np.where(lap < -0.1, "sink", "neutral")).tolist()}


def regimes(I, y):
    """Windows of a twentieth of the series; a jump of their means by over two deviations of the means begins a regime."""
    w = max(20, len(y) // 20)
    if len(y) < 2 * w:
        return {"regime": np.array([0]), "start": np.array([float(I[0]) if len(I) else NAN]), "mean": np.array([float(y.mean()) if len(y) else NAN])}
    at = np.arange(0, len(y) - w + 1, w // 2)
    means = np.array([y[a : a + w].mean() for a in at])
    jump = np.append(True, np.abs(np.diff(means)) > 2 * means.std())
    return {"regime": np.arange(jump.sum()), "start": I[at[jump]], "mean": means[jump]}


def flicker(I, y, rate=200.0, nominal=50.0):
    """Fluctuation of the voltage's size, for samples at a steady rate."""
    return machines.flicker(y, rate, nominal) if len(y) > 1 else dict.fromkeys(("pst", "max_fluctuation_percent", "std_fluctuation_percent"), NAN)


def voltage_events(I, y, rate=200.0, nominal=50.0, frequency=50.0):
    """Sags, swells and interruptions, with beginning and length in seconds."""
    found = machines.voltage_events(y, rate, nominal, frequency)["events"]
    return {"kind": np.array([e[0] for e in found], object), "start": np.array([e[1] for e in found], float), "duration": np.array([e[2] for e in found], float)}


def kalman(I, y, q=0.1, r=1.0):
    """A local level filtered forward and smoothed back (Rauch, Tung and Striebel), from level 0 with variance 1."""
    if not len(y):
        return {k: np.zeros(0) for k in ("I", "level", "variance", "innovation", "smoothed", "smoothed_variance")}
    found = control.filter_sequence(y, 1.0, 1.0, q, r)
    smooth = control.smooth(found["states"], found["covariances"], 1.0, q)
    return {
        "I": I, "level": found["states"][:, 0], "variance": found["covariances"][:, 0, 0], "innovation": found["innovations"][:, 0],
        "smoothed": smooth["smoothed_states"][:, 0], "smoothed_variance": smooth["smoothed_covariances"][:, 0, 0],
    }


def noise(I, y, q=0.1, r=1.0):
    """Variances of the steps and of what is left, as estimated from the filtered level."""
    if len(y) < 3:
        return {"process_noise": NAN, "measurement_noise": NAN}
    found = control.noise(y, control.filter_sequence(y, 1.0, 1.0, q, r)["states"], 1.0, 1.0)
    return {"process_noise": float(found["Q"][0, 0]), "measurement_noise": float(found["R"][0, 0])}


# ---------------------------------------------------------------- pairs (a, b aligned, directed from a to b where it matters)


def granger(a, b, lags=5):
    """Whether a helps to foretell b: F-test of b on its past with and without that of a, the best of the lags."""
    out = {"f_stat": NAN, "p_value": 1.0, "lag": 0, "is_causal": False}
    if len(b) < lags + 10 or a.std() == 0 or b.std() == 0:
        return out
    for k in range(1, lags + 1):
        past = lambda x, k=k: np.stack([x[k - j : len(x) - j] for j in range(1, k + 1)], 1)
        own = np.column_stack([np.ones(len(b) - k), past(b)])
        both = np.column_stack([own, past(a)])
        free = len(b) - k - both.shape[1]
        _, r0 = M.ols(own, b[k:])
        _, r1 = M.ols(both, b[k:])
        f = (r0 - r1) / k / max(r1 / free, 1e-300)
        p = M.f_tail(f, k, free)
        if p < out["p_value"]:
            out = {"f_stat": float(f), "p_value": p, "lag": k, "is_causal": p < 0.05}
    return out


def cointegration(a, b):
    """Augmented Dickey-Fuller statistic of the residuals of b on a; the p-value is from a table of four steps."""
    if len(a) < 30 or a.std() == 0:
        return {"coint_stat": NAN, "coint_p": 1.0, "is_cointegrated": False}
    x = np.column_stack([np.ones(len(a)), a])
    coef, _ = M.ols(x, b)
    r = b - x @ coef
    k = min(int(12 * (len(r) / 100) ** 0.25), len(r) // 3)
    d = np.diff(r)
    cols = np.column_stack([np.ones(len(d) - k), r[k:-1]] + [d[k - j : len(d) - j] for j in range(1, k + 1)])
    coef, rss = M.ols(cols, d[k:])
    s2 = rss / max(1, len(cols) - cols.shape[1])
    stat = float(coef[1] / math.sqrt(max(s2 * np.linalg.pinv(cols.T @ cols)[1, 1], 1e-300)))
    p = 0.01 if stat < -3.43 else 0.05 if stat < -2.86 else 0.10 if stat < -2.57 else 0.5
    return {"coint_stat": stat, "coint_p": p, "is_cointegrated": p < 0.05}


def dtw(a, b):
    """Dynamic time warping with absolute costs, a diagonal at a time: memory is one diagonal."""
    n, m = len(a), len(b)
    if not n or not m:
        return {"dtw_distance": NAN, "dtw_normalized": NAN}
    two, one = np.full(n + 1, np.inf), np.full(n + 1, np.inf)
    two[0] = 0
    for k in range(2, n + m + 1):
        i = np.arange(max(1, k - m), min(n, k - 1) + 1)
        now = np.full(n + 1, np.inf)
        now[i] = np.abs(a[i - 1] - b[k - i - 1]) + np.minimum(np.minimum(one[i - 1], one[i]), two[i - 1])
        two, one = one, now
    return {"dtw_distance": float(one[n]), "dtw_normalized": float(one[n] / (n + m))}


def copula(a, b):
    n = len(a)
    if n < 20:
        return dict.fromkeys(("tail_lower", "tail_upper", "kendall_tau", "spearman"), NAN)
    u, v = (np.argsort(np.argsort(x, kind="stable"), kind="stable") / n + 0.5 / n for x in (a, b))
    low = np.mean([((u <= q) & (v <= q)).mean() / q for q in (0.05, 0.10, 0.15)])
    high = np.mean([((u > 1 - q) & (v > 1 - q)).mean() / q for q in (0.05, 0.10, 0.15)])
    order = v[np.argsort(u)]
    swaps = 0  # inversions by merging, in place of all pairs
    width = 1
    while width < n:
        for at in range(0, n, 2 * width):
            left, right = order[at : at + width], order[at + width : at + 2 * width]
            swaps += int((len(left) - np.searchsorted(left, right, "right")).sum())
            order[at : at + 2 * width] = np.sort(order[at : at + 2 * width])
        width *= 2
    return {"tail_lower": float(low), "tail_upper": float(high), "kendall_tau": 1 - 4 * swaps / (n * (n - 1)), "spearman": float(np.corrcoef(u, v)[0, 1])}


def divergence(a, b, bins=50):
    if len(a) < 10 or len(b) < 10:
        return {"kl_symmetric": NAN, "js": NAN, "wasserstein": NAN}
    lo, hi = min(a.min(), b.min()), max(a.max(), b.max())
    p, q = (np.histogram(x, bins, (lo, hi if hi > lo else lo + 1))[0] / len(x) + 1e-10 for x in (a, b))
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    kl = lambda x, y: float((x * np.log(x / y)).sum())
    every = np.sort(np.concatenate([a, b]))
    gap = np.abs(np.searchsorted(np.sort(a), every[:-1], "right") / len(a) - np.searchsorted(np.sort(b), every[:-1], "right") / len(b))
    return {"kl_symmetric": (kl(p, q) + kl(q, p)) / 2, "js": (kl(p, m) + kl(q, m)) / 2, "wasserstein": float((gap * np.diff(every)).sum())}


# ---------------------------------------------------------------- entities (rows: index, columns: signals in order)


def pca(x, names, index):
    z = M.standard(x)
    u, s, v = np.linalg.svd(z, full_matrices=False)
    sign = np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])  # the largest loading is positive
    v = v * sign[:, None]
    share = s**2 / max((s**2).sum(), 1e-300)
    load = np.zeros((len(names), 3))
    load[:, : min(3, len(v))] = v[:3].T
    return {"signal_id": names, "pc1": load[:, 0], "pc2": load[:, 1], "pc3": load[:, 2], "variance_1": np.full(len(names), share[0]), "variance_3": np.full(len(names), share[:3].sum())}


def pca_coordinates(x, names, index):
    z = M.standard(x)
    _, _, v = np.linalg.svd(z, full_matrices=False)
    sign = np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])
    c = np.zeros((len(z), 3))
    c[:, : min(3, len(v))] = z @ (v * sign[:, None])[:3].T
    return {"I": index, "manifold_x": c[:, 0], "manifold_y": c[:, 1], "manifold_z": c[:, 2]}


def dmd(x, names, index):
    """Dynamic modes at 99 % of the energy."""
    z = x.T
    if z.shape[1] < 5:
        return {"mode": np.zeros(0, int), "growth": np.zeros(0), "frequency": np.zeros(0), "is_stable": [], "recon_error": np.zeros(0)}
    a, b = z[:, :-1], z[:, 1:]
    u, s, v = np.linalg.svd(a, full_matrices=False)
    r = int(np.searchsorted(np.cumsum(s**2) / (s**2).sum(), 0.99)) + 1
    u, s, v = u[:, :r], s[:r], v[:r]
    step = u.T @ b @ v.T / s
    e = np.linalg.eigvals(step)
    order = np.argsort(-np.abs(e), kind="stable")
    e = e[order]
    error = np.linalg.norm(b - u @ (step @ (u.T @ a))) / max(np.linalg.norm(b), 1e-300)
    return {"mode": np.arange(len(e)), "growth": np.log(np.maximum(np.abs(e), 1e-300)), "frequency": np.angle(e) / (2 * np.pi), "is_stable": (np.abs(e) <= 1).tolist(), "recon_error": np.full(len(e), error)}


def clustering(x, names, index, k=3):
    z = M.standard(x)
    label, centres, _ = M.kmeans(z, min(k, len(z)))
    first = {c: i for i, c in enumerate(dict.fromkeys(label.tolist()))}  # numbered in order of appearance
    return {"I": index, "regime_id": np.array([first[c] for c in label]), "centroid_distance": np.linalg.norm(z - centres[label], axis=1)}


def density_clustering(x, names, index, eps=0.5, least=5):
    return {"I": index, "regime_id": M.dbscan(M.standard(x), eps, least)}


def tree(x, names, index):
    d = M.distances(M.standard(x).T)
    edges = M.spanning_tree(d)
    degree = np.bincount([i for e in edges for i in e[:2]], minlength=len(names)) if edges else np.zeros(len(names), int)
    return {
        "source": [names[a] for a, _, _ in edges], "target": [names[b] for _, b, _ in edges], "distance": np.array([w for _, _, w in edges]),
        "source_degree": np.array([int(degree[a]) for a, _, _ in edges], int), "target_degree": np.array([int(degree[b]) for _, b, _ in edges], int),
        "hubs": [sorted(names[i] for i in np.flatnonzero(degree >= 3))] * len(edges), "leaves": [sorted(names[i] for i in np.flatnonzero(degree == 1))] * len(edges),
    }


def outliers(x, names, index, k=5):
    f = np.minimum(M.outlier_factor(M.standard(x.T), k), 10)
    return {"signal_id": names, "lof_score": f, "is_outlier": (f > 1.5).tolist()}


def hull(x, names, index):
    """Area of the hull of the first two principal coordinates, and each point's distance from the centre."""
    z = M.standard(x)
    _, _, v = np.linalg.svd(z, full_matrices=False)
    p = z @ v[:2].T if len(v) > 1 else np.column_stack([z[:, 0], np.zeros(len(z))])
    points = sorted(set(map(tuple, p.round(12))))

    def half(ps):
        out = []
        for q in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    ring = np.array(half(points) + half(points[::-1])) if len(points) > 2 else np.array(points)
    area = float(abs(ring[:, 0] @ np.roll(ring[:, 1], -1) - ring[:, 1] @ np.roll(ring[:, 0], -1)) / 2) if len(ring) > 2 else 0.0
    d = np.linalg.norm(z - z.mean(0), axis=1)
    return {"hull_area": area, "n_boundary": len(ring), "mean_distance": float(d.mean()), "max_distance": float(d.max()), "hull_method": "pca_2d"}


def modes(x, names, index, most=10):
    """Signals by the mean, deviation and skewness of their gradients and laplacians, in a mixture chosen by BIC."""
    rows = []
    for y in x.T:
        for d in (np.gradient(y), np.append(0, np.append(np.diff(y, 2), 0)) if len(y) > 2 else np.zeros(1)):
            s = d.std()
            rows += [d.mean(), s, ((d - d.mean()) ** 3).mean() / s**3 if s > 0 else 0.0]
    z = M.standard(np.array(rows).reshape(-1, 6))
    best = (np.ones((len(z), 1)), math.inf)
    for k in range(2, min(most, len(z) - 1) + 1):
        found = M.mixture(z, k)
        if found[1] < best[1]:
            best = found
    r = best[0]
    return {"signal_id": names, "mode_id": r.argmax(1), "mode_affinity": r.max(1), "mode_entropy": -(r * np.log(np.maximum(r, 1e-300))).sum(1)}
