"""Numerical routines in NumPy alone, where larger libraries would otherwise be needed."""

from __future__ import annotations

import itertools
import math

import numpy as np


def line(x, y) -> tuple[float, float, float]:
    """Slope, intercept and r squared of the least-squares line."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    dx, dy = x - x.mean(), y - y.mean()
    sxx, syy, sxy = dx @ dx, dy @ dy, dx @ dy
    if sxx == 0:
        return 0.0, float(y.mean()), 0.0
    slope = sxy / sxx
    return float(slope), float(y.mean() - slope * x.mean()), float(sxy * sxy / (sxx * syy)) if syy > 0 else 0.0


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d if abs(1 + num * d) > tiny else tiny)
            c = 1 + num / c if abs(1 + num / c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * h


def f_tail(f: float, d1: int, d2: int) -> float:
    """P(F > f) of the F distribution."""
    return 1.0 if f <= 0 else beta_cdf(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def analytic(y: np.ndarray) -> np.ndarray:
    """The analytic signal: negative frequencies dropped, positive ones doubled."""
    n = len(y)
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.fft.ifft(np.fft.fft(y) * h)


def embed(y: np.ndarray, dim: int, delay: int) -> np.ndarray:
    n = len(y) - (dim - 1) * delay
    return np.stack([y[i * delay : i * delay + n] for i in range(dim)], 1) if n > 0 else np.zeros((0, dim))


def acf(y: np.ndarray, lags: int) -> np.ndarray:
    """Autocorrelation with the number of terms as the divisor."""
    d, v = y - y.mean(), y.var()
    return np.array([1.0] + [(d[k:] @ d[:-k]) / ((len(y) - k) * v) for k in range(1, lags + 1)]) if v > 0 else np.zeros(lags + 1)


def distances(x: np.ndarray) -> np.ndarray:
    s = (x * x).sum(1)
    return np.sqrt(np.maximum(s[:, None] + s[None, :] - 2 * x @ x.T, 0))


def ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Coefficients and the sum of squared residuals."""
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    r = y - x @ b
    return b, float(r @ r)


def standard(x: np.ndarray) -> np.ndarray:
    s = x.std(0)
    return (x - x.mean(0)) / np.where(s > 0, s, 1)


def kmeans(x: np.ndarray, k: int, seed: int = 42, starts: int = 10) -> tuple[np.ndarray, np.ndarray, float]:
    """Labels, centres and inertia of the best of some runs of Lloyd's algorithm from k-means++ seeds."""
    r = np.random.default_rng(seed)
    best = None
    for _ in range(starts):
        centres = x[[r.integers(len(x))]]
        while len(centres) < k:
            d = ((x[:, None] - centres[None]) ** 2).sum(2).min(1)
            centres = np.vstack([centres, x[r.choice(len(x), p=d / d.sum()) if d.sum() > 0 else r.integers(len(x))]])
        for _ in range(100):
            d = ((x[:, None] - centres[None]) ** 2).sum(2)
            label = d.argmin(1)
            new = np.array([x[label == j].mean(0) if (label == j).any() else centres[j] for j in range(k)])
            if np.allclose(new, centres):
                break
            centres = new
        inertia = float(d.min(1).sum())
        if best is None or inertia < best[2]:
            best = label, centres, inertia
    return best


def spanning_tree(d: np.ndarray) -> list[tuple[int, int, float]]:
    """Prim's algorithm on a full distance matrix."""
    n = len(d)
    near, by, free, out = d[0].copy(), np.zeros(n, int), np.ones(n, bool), []
    free[0] = False
    for _ in range(n - 1):
        j = int(np.where(free, near, np.inf).argmin())
        out.append((int(by[j]), j, float(near[j])))
        free[j] = False
        closer = d[j] < near
        near[closer], by[closer] = d[j][closer], j
    return out


def distance_rows(x: np.ndarray, block: int = 512):
    """First row and distances to all rows, some rows at a time: memory is a block, not the square."""
    s = (x * x).sum(1)
    for a in range(0, len(x), block):
        yield a, np.sqrt(np.maximum(s[a : a + block, None] + s[None, :] - 2 * x[a : a + block] @ x.T, 0))


def outlier_factor(x: np.ndarray, k: int = 5) -> np.ndarray:
    """Local outlier factor."""
    n = len(x)
    k = min(k, n - 1)
    if k < 1:
        return np.ones(n)
    near, gap = np.empty((n, k), np.int64), np.empty((n, k))
    for a, d in distance_rows(x):
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        near[a : a + len(d)] = np.argsort(d, 1)[:, :k]
        gap[a : a + len(d)] = np.take_along_axis(d, near[a : a + len(d)], 1)
    density = 1 / np.maximum(np.maximum(gap[:, -1][near], gap).mean(1), 1e-10)
    return density[near].mean(1) / density


def dbscan(x: np.ndarray, eps: float, least: int) -> np.ndarray:
    """Clusters by density; -1: noise. Points that are reached are looked up in a grid of cells as wide as eps, a cell's neighbours at a time."""
    label, now = np.full(len(x), -1), 0
    if not len(x):
        return label
    # cells by the first coordinates: what is within eps lies in a cell beside at the most
    cell = np.floor(x[:, :3] / eps).astype(np.int64)
    cells: dict[tuple[int, ...], np.ndarray] = {}
    keys, back = np.unique(cell, axis=0, return_inverse=True)
    order = np.argsort(back.ravel(), kind="stable")
    for key, rows in zip(map(tuple, keys.tolist()), np.split(order, np.cumsum(np.bincount(back.ravel()))[:-1])):
        cells[key] = rows
    steps = list(itertools.product((-1, 0, 1), repeat=cell.shape[1]))

    def close(i: int) -> np.ndarray:
        rows = np.concatenate([cells[k] for k in (tuple(np.add(cell[i], d).tolist()) for d in steps) if k in cells])
        d = x[rows] - x[i]
        return np.sort(rows[np.einsum("ij,ij->i", d, d) <= eps * eps * (1 + 1e-12)])

    core = np.array([len(close(i)) >= least for i in range(len(x))])
    for i in np.flatnonzero(core):
        if label[i] < 0:
            todo = [int(i)]
            while todo:
                j = todo.pop()
                if label[j] < 0:
                    label[j] = now
                    if core[j]:
                        rows = close(j)
                        todo += rows[label[rows] < 0].tolist()
            now += 1
    return label


def mixture(x: np.ndarray, k: int, seed: int = 42, steps: int = 100) -> tuple[np.ndarray, float]:
    """Responsibilities and BIC of a Gaussian mixture with full covariances, by expectation maximisation."""
    n, d = x.shape
    label, centres, _ = kmeans(x, k, seed, 3)
    resp = np.eye(k)[label]
    old = -np.inf
    for _ in range(steps):
        weight = resp.sum(0) + 1e-10
        centres = resp.T @ x / weight[:, None]
        logs = np.empty((n, k))
        for j in range(k):
            c = x - centres[j]
            cov = (resp[:, j, None] * c).T @ c / weight[j] + 1e-6 * np.eye(d)
            low = np.linalg.cholesky(cov)
            z = np.linalg.solve(low, c.T)
            logs[:, j] = np.log(weight[j] / n) - np.log(np.diag(low)).sum() - 0.5 * (d * np.log(2 * np.pi) + (z * z).sum(0))
        top = logs.max(1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(logs - top).sum(1))
        resp = np.exp(logs - total[:, None])
        if abs(total.sum() - old) < 1e-6 * max(1, abs(old)):
            break
        old = total.sum()
    free = k - 1 + k * d + k * d * (d + 1) / 2
    return resp, float(free * np.log(n) - 2 * total.sum())


def simplex(f, start: np.ndarray, steps: int = 400) -> np.ndarray:
    """Nelder-Mead."""
    n = len(start)
    points = [np.array(start, float)] + [np.array(start, float) + np.eye(n)[i] * (0.1 * abs(start[i]) + 0.05) for i in range(n)]
    value = [f(p) for p in points]
    for _ in range(steps):
        order = np.argsort(value)
        points, value = [points[i] for i in order], [value[i] for i in order]
        if abs(value[-1] - value[0]) < 1e-10 * (abs(value[0]) + 1e-10):
            break
        mean = np.mean(points[:-1], 0)
        over = mean + (mean - points[-1])
        v = f(over)
        if v < value[0]:
            far = mean + 2 * (mean - points[-1])
            w = f(far)
            points[-1], value[-1] = (far, w) if w < v else (over, v)
        elif v < value[-2]:
            points[-1], value[-1] = over, v
        else:
            inner = mean + 0.5 * (points[-1] - mean)
            w = f(inner)
            if w < value[-1]:
                points[-1], value[-1] = inner, w
            else:
                points = [points[0]] + [points[0] + 0.5 * (p - points[0]) for p in points[1:]]
                value = [value[0]] + [f(p) for p in points[1:]]
    return points[int(np.argmin(value))]


#: The Daubechies wavelet of four vanishing moments, decomposition low-pass.
DB4 = np.array([-0.010597401784997278, 0.032883011666982945, 0.030841381835986965, -0.18703481171888114, -0.02798376941698385, 0.6308807679295904, 0.7148465705525415, 0.23037781330885523])


def wavelet_levels(y: np.ndarray, most: int = 8) -> list[np.ndarray]:
    """Approximation, then details from coarse to fine, with symmetric ends."""
    high = DB4[::-1] * np.array([-1, 1] * 4)
    details, a = [], np.asarray(y, float)
    for _ in range(min(most, max(0, int(np.log2(len(y) / 7))) if len(y) >= 14 else 0)):
        ends = np.pad(a, 7, mode="symmetric")
        details.append(np.convolve(ends, high, "valid")[1::2])
        a = np.convolve(ends, DB4, "valid")[1::2]
    return [a, *details[::-1]]
