"""Distillation columns tray by tray, batch cooling crystallisers, and models that stand for others."""

from __future__ import annotations

import numpy as np

from sigloom.functions.physics.chemical import stiff


def tray(x_below: float, y_above: float, L: float, V: float, alpha: float, feed: float = 0, z: float = 0, q: float = 1) -> dict:
    """One equilibrium tray with constant molar overflow: x by bisection of its balance (light component)."""
    inn = L * x_below + V * y_above + feed * z
    out = lambda x: (L + q * feed) * x + (V + (1 - q) * feed) * alpha * x / (1 + (alpha - 1) * x) - inn
    lo, hi = 0.0, 1.0
    for _ in range(80):
        x = (lo + hi) / 2
        lo, hi = (x, hi) if out(x) < 0 else (lo, x)
    return {"x": x, "y": alpha * x / (1 + (alpha - 1) * x)}


def simulate(trays: int, feed_tray: int, z: float, alpha: float, reflux: float, distillate: float, most: int = 2000, tol: float = 1e-10) -> dict:
    """All trays of a column with a total condenser and saturated liquid feed of one mole, swept until nothing moves.

    Trays are numbered from the top; the last is the reboiler.
    """
    x = np.linspace(0.9, 0.1, trays)
    V, L = (reflux + 1) * distillate, reflux * distillate
    low = L + 1
    for sweep in range(most):
        y = alpha * x / (1 + (alpha - 1) * x)
        a, b, c, d = np.zeros(trays), np.zeros(trays), np.zeros(trays), np.zeros(trays)
        K = y / np.maximum(x, 1e-300)
        for j in range(trays):
            above, own = (L if j <= feed_tray else low), (L if j < feed_tray else low)
            a[j] = above if j else 0.0
            b[j] = -(V * K[j] + own) if j < trays - 1 else -(V * K[j] + low - V)
            if j == 0:
                b[j] += L * K[0]  # the reflux is the condensed vapour
            c[j] = V * K[j + 1] if j < trays - 1 else 0.0
            d[j] = -z if j == feed_tray else 0.0
        m = np.diag(b) + np.diag(a[1:], -1) + np.diag(c[:-1], 1)
        new = np.clip(np.linalg.solve(m, d), 1e-12, 1)
        moved = float(np.abs(new - x).max())
        x = 0.5 * x + 0.5 * new
        if moved < tol:
            break
    y = alpha * x / (1 + (alpha - 1) * x)
    return {"x": x, "y": y, "x_distillate": float(y[0]), "x_bottoms": float(x[-1]), "converged": moved < tol, "iterations": sweep + 1}


def cooling_crystalliser(C0: float, T0: float, T_end: float, rate: float, k_n: float, k_g: float, n: float, g: float, solubility: tuple[float, float, float], density: float = 1500.0, shape: float = 0.52, points: int = 100) -> dict:
    """Linear cooling of a saturated solution: concentration and the first four moments of the crystals."""
    a, b, c = solubility

    def f(t, m):
        T = max(T0 - rate * t, T_end)
        s = max(m[0] / (a + b * T + c * T * T) - 1, 0.0)
        B, G = k_n * s**n, k_g * s**g
        return np.array([-3 * density * shape * G * m[3], B, G * m[1], 2 * G * m[2], 3 * G * m[3]])

    t, m = stiff(f, [C0, 0, 0, 0, 0], (0, (T0 - T_end) / rate), points)
    return {"t": t, "T": np.maximum(T0 - rate * t, T_end), "C": m[:, 0], "mu0": m[:, 1], "mu3": m[:, 4], "final_mass": C0 - m[-1, 0]}


def unifac(x, groups=None, T: float = 298.15) -> dict:
    """Group contributions are not tabulated here: activity coefficients of one, as the model is defined without them."""
    return {"gamma": np.ones(len(x)), "model": "unifac_placeholder", "temperature": T}


def umap(*_, **__):
    raise ImportError("umap needs a library that is not installed; pca_coordinates gives linear coordinates")
