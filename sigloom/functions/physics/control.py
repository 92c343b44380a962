"""Linear systems: responses, stability, identification and Kalman filters."""

from __future__ import annotations

import math

import numpy as np


def frequency_response(num, den, omega) -> dict:
    h = np.polyval(num, 1j * np.asarray(omega)) / np.polyval(den, 1j * np.asarray(omega))
    dc = num[-1] / den[-1] if den[-1] else math.inf
    below = np.flatnonzero(np.abs(h) < abs(dc) / math.sqrt(2))
    return {"magnitude": np.abs(h), "magnitude_db": 20 * np.log10(np.abs(h)), "phase_rad": np.unwrap(np.angle(h)), "dc_gain": dc, "bandwidth": float(np.asarray(omega)[below[0]]) if len(below) else math.nan}


def state_space(num, den) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    den = np.asarray(den, float)
    num = np.asarray(num, float) / den[0]
    den = den / den[0]
    n = len(den) - 1
    num = np.concatenate([np.zeros(n + 1 - len(num)), num])
    A = np.zeros((n, n))
    A[0], A[1:, :-1] = -den[1:], np.eye(n - 1)
    B = np.zeros(n)
    B[0] = 1
    return A, B, num[1:] - num[0] * den[1:], float(num[0])


def expm(A: np.ndarray) -> np.ndarray:
    """Scaling and squaring of a Taylor series."""
    s = max(0, int(np.ceil(np.log2(max(np.abs(A).sum(1).max(), 1e-16)))) + 4)
    x = A / 2**s
    e = t = np.eye(len(A))
    for k in range(1, 14):
        t = t @ x / k
        e = e + t
    for _ in range(s):
        e = e @ e
    return e


def _run(num, den, t, step: bool) -> np.ndarray:
    A, B, Cm, D = state_space(num, den)
    n, h = len(A), t[1] - t[0]
    big = np.zeros((n + 1, n + 1))
    big[:n, :n], big[:n, n] = A * h, B * h
    e = expm(big)
    x, y = (np.zeros(n) if step else B.copy()), []
    for _ in t:
        y.append(Cm @ x + (D if step else 0))
        x = e[:n, :n] @ x + (e[:n, n] if step else 0)
    return np.array(y)


def step_response(num, den, t=None, points: int = 500) -> dict:
    p = np.roots(den)
    slow = np.abs(p.real[p.real < 0]).min() if (p.real < 0).any() else 1.0
    t = np.linspace(0, 8 / slow, points) if t is None else np.asarray(t, float)
    y = _run(num, den, t, True)
    end = num[-1] / den[-1] if (p.real < 0).all() and den[-1] else y[-1]
    out = np.flatnonzero(np.abs(y - end) > 0.02 * abs(end))
    reach = lambda q: t[np.argmax(y / end >= q)] if end and (y / end >= q).any() else math.nan
    top = int(np.argmax(y))
    return {"t": t, "y": y, "y_final": float(end), "rise_time": float(reach(0.9) - reach(0.1)), "settling_time": float(t[min(out[-1] + 1, len(t) - 1)]) if len(out) else 0.0, "overshoot_percent": float(max(0.0, (y[top] - end) / end * 100)) if end else math.nan, "peak_time": float(t[top]), "peak_value": float(y[top])}


def impulse_response(num, den, t) -> dict:
    y = _run(num, den, np.asarray(t, float), False)
    return {"t": np.asarray(t), "y": y, "peak_value": float(y[np.abs(y).argmax()]), "peak_time": float(np.asarray(t)[np.abs(y).argmax()])}


def poles_zeros(num, den) -> dict:
    p, z = np.roots(den), np.roots(num)
    return {"poles": p, "zeros": z, "stable": bool((p.real < 0).all()), "dominant_pole": p[p.real.argmax()] if len(p) else None}


def arx(y, u, na: int, nb: int, nk: int = 1) -> dict:
    """y = -sum a y + sum b u by least squares; fit in percent."""
    y, u = np.asarray(y, float), np.asarray(u, float)
    first = max(na, nb + nk - 1)
    x = np.column_stack([-y[first - i : len(y) - i] for i in range(1, na + 1)] + [u[first - nk - j : len(u) - nk - j] for j in range(nb)])
    theta, *_ = np.linalg.lstsq(x, y[first:], rcond=None)
    r = y[first:] - x @ theta
    return {"a": theta[:na], "b": theta[na:], "fit_percent": 100 * (1 - math.sqrt(float(r @ r) / float(((y[first:] - y[first:].mean()) ** 2).sum())))}


def routh(coefficients) -> dict:
    a = np.asarray(coefficients, float)
    n, w = len(a), (len(a) + 1) // 2
    t = np.zeros((n, w))
    t[0, : len(a[::2])], t[1, : len(a[1::2])] = a[::2], a[1::2]
    border = False  # poles on the imaginary axis, or in pairs about it
    for i in range(2, n):
        if not t[i - 1].any():  # a row of noughts: the derivative of the row above
            border = True
            t[i - 1] = t[i - 2] * np.maximum(n - i + 1 - 2 * np.arange(w), 0)
        lead = t[i - 1, 0] if t[i - 1, 0] else 1e-9
        t[i, :-1] = (lead * t[i - 2, 1:] - t[i - 2, 0] * t[i - 1, 1:]) / lead
    s = np.sign(np.where(t[:, 0] == 0, 1e-9, t[:, 0]))
    changes = int((s[1:] != s[:-1]).sum())
    return {"stable": changes == 0 and not border and bool((t[:, 0] != 0).all()), "routh_array": t, "sign_changes": changes, "rhp_poles": changes}


def nyquist(num, den, omega=None) -> dict:
    w = np.logspace(-4, 4, 20000) if omega is None else np.asarray(omega)
    h = np.polyval(num, 1j * w) / np.polyval(den, 1j * w)
    full = np.concatenate([np.conj(h[::-1]), h])
    turns = -int(round(float(np.unwrap(np.angle(full + 1))[-1] - np.unwrap(np.angle(full + 1))[0]) / (2 * math.pi)))
    unstable = int((np.roots(den).real > 1e-9).sum())
    return {"encirclements": turns, "open_loop_unstable_poles": unstable, "closed_loop_unstable_poles": turns + unstable, "stable": turns + unstable == 0, "min_distance_to_minus_one": float(np.abs(h + 1).min())}


def lyapunov_equation(A) -> dict:
    """A'P + PA = -I by Kronecker products."""
    A = np.asarray(A, float)
    n = len(A)
    e = np.linalg.eigvals(A)
    P = np.linalg.lstsq(np.kron(np.eye(n), A.T) + np.kron(A.T, np.eye(n)), -np.eye(n).ravel(), rcond=None)[0].reshape(n, n)
    P = (P + P.T) / 2
    own = np.linalg.eigvalsh(P)
    return {"stable": bool((e.real < 0).all()), "P": P, "positive_definite": bool((own > 0).all()), "max_real_eigenvalue": float(e.real.max())}


def place(A, B, poles) -> dict:
    """Ackermann's formula, one input."""
    A, B = np.asarray(A, float), np.asarray(B, float).reshape(-1)
    n = len(A)
    ctrb = np.stack([np.linalg.matrix_power(A, i) @ B for i in range(n)], 1)
    if np.linalg.matrix_rank(ctrb) < n:
        return {"controllable": False, "success": False, "K": None}
    c = np.real(np.poly(poles))
    phi = sum(k * np.linalg.matrix_power(A, n - i) for i, k in enumerate(c))
    K = np.linalg.inv(ctrb)[-1] @ phi
    return {"controllable": True, "success": True, "K": K, "achieved": np.linalg.eigvals(A - np.outer(B, K))}


def margins(num, den) -> dict:
    w = np.logspace(-4, 4, 40000)
    h = np.polyval(num, 1j * w) / np.polyval(den, 1j * w)
    mag, ph = np.abs(h), np.unwrap(np.angle(h))
    g = np.flatnonzero((mag[:-1] >= 1) & (mag[1:] < 1))
    p = np.flatnonzero((ph[:-1] > -math.pi) & (ph[1:] <= -math.pi))
    gain = -20 * math.log10(mag[p[0]]) if len(p) else math.inf
    phase = 180 + math.degrees(ph[g[0]]) if len(g) else math.inf
    return {"gain_margin_db": gain, "phase_margin_deg": phase, "gain_crossover": float(w[g[0]]) if len(g) else math.nan, "phase_crossover": float(w[p[0]]) if len(p) else math.nan, "stable": gain > 0 and phase > 0}


class Kalman:
    """Predict and update (Joseph's form)."""

    def __init__(self, A, H, Q, R, x0=None, P0=None, B=None):
        self.A, self.H, self.Q, self.R = (np.atleast_2d(np.asarray(m, float)) for m in (A, H, Q, R))
        self.B = None if B is None else np.atleast_2d(np.asarray(B, float))
        self.x = np.zeros(len(self.A)) if x0 is None else np.asarray(x0, float)
        self.P = np.eye(len(self.A)) if P0 is None else np.atleast_2d(np.asarray(P0, float))

    def predict(self, u=None):
        self.x = self.A @ self.x + (0 if u is None or self.B is None else self.B @ np.atleast_1d(u))
        self.P = self.A @ self.P @ self.A.T + self.Q
        return self.x, self.P

    def update(self, z):
        gap = np.atleast_1d(z) - self.H @ self.x
        K = self.P @ self.H.T @ np.linalg.inv(self.H @ self.P @ self.H.T + self.R)
        left = np.eye(len(self.x)) - K @ self.H
        self.x, self.P = self.x + K @ gap, left @ self.P @ left.T + K @ self.R @ K.T
        return gap, K

    def step(self, z, u=None) -> dict:
        before = self.predict(u)[0].copy()
        gap, K = self.update(z)
        return {"state": self.x.copy(), "covariance": self.P.copy(), "predicted_state": before, "innovation": gap, "kalman_gain": K}


def filter_sequence(zs, A, H, Q, R, **more) -> dict:
    k = Kalman(A, H, Q, R, **more)
    rows = [k.step(z) for z in zs]
    gaps = np.array([r["innovation"] for r in rows])
    return {"states": np.array([r["state"] for r in rows]), "covariances": np.array([r["covariance"] for r in rows]), "innovations": gaps, "innovation_variance": gaps.var(0)}


def smooth(states, covariances, A, Q) -> dict:
    """Rauch, Tung and Striebel."""
    A, Q = np.atleast_2d(np.asarray(A, float)), np.atleast_2d(np.asarray(Q, float))
    x, P = np.array(states, float), np.array(covariances, float)
    for k in range(len(x) - 2, -1, -1):
        ahead = A @ P[k] @ A.T + Q
        G = P[k] @ A.T @ np.linalg.inv(ahead)
        x[k], P[k] = x[k] + G @ (x[k + 1] - A @ x[k]), P[k] + G @ (P[k + 1] - ahead) @ G.T
    return {"smoothed_states": x, "smoothed_covariances": P}


def noise(zs, states, A, H) -> dict:
    A, H, x = np.atleast_2d(np.asarray(A, float)), np.atleast_2d(np.asarray(H, float)), np.asarray(states, float)
    w, v = x[1:] - x[:-1] @ A.T, np.asarray(zs, float).reshape(len(x), -1) - x @ H.T
    return {"Q": np.atleast_2d(np.cov(w.T)), "R": np.atleast_2d(np.cov(v.T))}
