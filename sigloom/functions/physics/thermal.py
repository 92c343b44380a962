"""Heat, phases and gases."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from sigloom.functions.physics.base import SIGMA, R, Value, c, out, pick


def convection(U: Value, L: Value, nu: Value, Pr: Value, k: Value, T_surface: Value, T_fluid: Value, geometry: str = "plate") -> Column:
    re = c(U) * c(L) / c(nu)
    p = c(Pr)
    third = F.pow(p, F.lit(1 / 3))
    nusselt = {
        "plate": F.when(re < 5e5, 0.664 * F.sqrt(re) * third).otherwise(0.037 * F.pow(re, F.lit(0.8)) * third),
        "cylinder": 0.3 + 0.62 * F.sqrt(re) * third / F.pow(1 + F.pow(0.4 / p, F.lit(2 / 3)), F.lit(0.25)),
        "sphere": 2 + 0.6 * F.sqrt(re) * third,
        "pipe": 0.023 * F.pow(re, F.lit(0.8)) * F.pow(p, F.lit(0.4)),
    }[geometry]
    h = nusselt * c(k) / c(L)
    return out(Re=re, Pr=p, Nu=nusselt, h=h, q=h * (c(T_surface) - c(T_fluid)))


def radiation(T1: Value, T2: Value, e1: Value = 1, e2: Value = 1, F12: Value = 1, A1: Value = 1) -> Column:
    b1, b2 = SIGMA * F.pow(c(T1), F.lit(4.0)), SIGMA * F.pow(c(T2), F.lit(4.0))
    r = (1 - c(e1)) / c(e1) / c(A1) + 1 / (c(A1) * c(F12)) + (1 - c(e2)) / c(e2) / c(A1)
    return out(Q=(b1 - b2) / r, heat_flux=(b1 - b2) / r / c(A1), Eb1=b1, Eb2=b2, R_total=r)


def heat_exchanger(T_h_in: Value, T_h_out: Value, T_c_in: Value, T_c_out: Value, C_h: Value, C_c: Value, UA: Value, counter: bool = True) -> Column:
    a = c(T_h_in) - (c(T_c_out) if counter else c(T_c_in))
    b = c(T_h_out) - (c(T_c_in) if counter else c(T_c_out))
    mean = F.when(F.abs(a - b) < 0.01, (a + b) / 2).otherwise((a - b) / F.ln(a / b))
    least, most = F.least(c(C_h), c(C_c)), F.greatest(c(C_h), c(C_c))
    r, ntu = least / most, c(UA) / least
    if counter:
        e = F.when(F.abs(r - 1) < 1e-9, ntu / (1 + ntu)).otherwise((1 - F.exp(-ntu * (1 - r))) / (1 - r * F.exp(-ntu * (1 - r))))
    else:
        e = (1 - F.exp(-ntu * (1 + r))) / (1 + r)
    return out(Q=c(UA) * mean, LMTD=mean, NTU=ntu, C_r=r, effectiveness=e, Q_max=least * (c(T_h_in) - c(T_c_in)))


def exergy(T: Value, T0: Value, P: Value, P0: Value, h: Value, h0: Value, s: Value, s0: Value, n: Value = 1) -> Column:
    heat, push = (c(h) - c(h0)) - c(T0) * (c(s) - c(s0)), R * c(T0) * F.ln(c(P) / c(P0))
    return out(ex_physical=heat, ex_thermal=heat - push, ex_mechanical=push, Ex_flow=c(n) * heat)


def fugacity(T: Value, P: Value, Z: Value, A: Value, B: Value) -> Column:
    """Peng and Robinson."""
    z, a, b, q = c(Z), c(A), c(B), math.sqrt(2)
    ln = z - 1 - F.ln(z - b) - a / (2 * q * b) * F.ln((z + (1 + q) * b) / (z + (1 - q) * b))
    return out(fugacity_coeff=F.exp(ln), fugacity=F.exp(ln) * c(P), mu_deviation=R * c(T) * ln)


def _gamma(l1: Column, l2: Column, x1: Column) -> Column:
    return out(gamma1=F.exp(l1), gamma2=F.exp(l2), ln_gamma1=l1, ln_gamma2=l2, G_E_RT=x1 * l1 + (1 - x1) * l2)


def margules(x1: Value, A12: Value, A21: Value | None = None) -> Column:
    a, b, x = c(A12), c(A12 if A21 is None else A21), c(x1)
    return _gamma((1 - x) * (1 - x) * (a + 2 * (b - a) * x), x * x * (b + 2 * (a - b) * (1 - x)), x)


def van_laar(x1: Value, A: Value, B: Value) -> Column:
    a, b, x = c(A), c(B), c(x1)
    d = a * x + b * (1 - x)
    return _gamma(a * F.pow(b * (1 - x) / d, F.lit(2.0)), b * F.pow(a * x / d, F.lit(2.0)), x)


def wilson_binary(x1: Value, L12: Value, L21: Value) -> Column:
    a, b, x = c(L12), c(L21), c(x1)
    y = 1 - x
    d = a / (x + a * y) - b / (b * x + y)
    return _gamma(-F.ln(x + a * y) + y * d, -F.ln(b * x + y) - x * d, x)


def nrtl_binary(x1: Value, t12: Value, t21: Value, alpha: Value = 0.3) -> Column:
    x, a, b = c(x1), c(t12), c(t21)
    y = 1 - x
    g, h = F.exp(-c(alpha) * a), F.exp(-c(alpha) * b)
    sq = lambda z: F.pow(z, F.lit(2.0))
    return _gamma(y * y * (b * sq(h / (x + y * h)) + a * g / sq(y + x * g)), x * x * (a * sq(g / (y + x * g)) + b * h / sq(x + y * h)), x)


def wilson(x, L) -> dict:
    x, L = np.asarray(x, float), np.array(L, float)
    np.fill_diagonal(L, 1)
    s = L @ x
    ln = 1 - np.log(s) - L.T @ (x / s)
    return {"gamma": np.exp(ln), "ln_gamma": ln, "G_E_RT": float(x @ ln)}


def nrtl(x, tau, alpha=0.3) -> dict:
    x, tau = np.asarray(x, float), np.array(tau, float)
    np.fill_diagonal(tau, 0)
    G = np.exp(-alpha * tau)
    s, t = G.T @ x, (tau * G).T @ x
    ln = t / s + (G * (tau - (t / s)[None])) @ (x / s)
    return {"gamma": np.exp(ln), "ln_gamma": ln, "G_E_RT": float(x @ ln)}


def uniquac(x, r, q, tau, z=10) -> dict:
    x, r, q, tau = (np.asarray(v, float) for v in (x, r, q, tau))
    phi, theta = x * r / (x @ r), x * q / (x @ q)
    li = z / 2 * (r - q) - (r - 1)
    comb = np.log(phi / x) + z / 2 * q * np.log(theta / phi) + li - phi / x * (x @ li)
    s = tau.T @ theta
    res = q * (1 - np.log(s) - tau @ (theta / s))
    return {"gamma": np.exp(comb + res), "gamma_C": np.exp(comb), "gamma_R": np.exp(res), "phi": phi, "theta": theta}


def ideal(x) -> dict:
    return {"gamma": np.ones(len(x)), "G_E_RT": 0.0}


def cubic(T: float, P: float, Tc: float, Pc: float, omega: float = 0, kind: str = "PR") -> dict:
    """Largest real root above B of van der Waals, Soave-Redlich-Kwong or Peng-Robinson."""
    tr, pr = T / Tc, P / Pc
    if kind == "VDW":
        A, B, u, w = 27 / 64 * pr / tr**2, pr / (8 * tr), 0, 0
    elif kind == "SRK":
        m = 0.480 + 1.574 * omega - 0.176 * omega**2
        A, B, u, w = 0.42748 * (1 + m * (1 - math.sqrt(tr))) ** 2 * pr / tr**2, 0.08664 * pr / tr, 1, 0
    else:
        m = 0.37464 + 1.54226 * omega - 0.26992 * omega**2
        A, B, u, w = 0.45724 * (1 + m * (1 - math.sqrt(tr))) ** 2 * pr / tr**2, 0.07780 * pr / tr, 2, -1
    roots = np.roots([1, -(1 + B - u * B), A + w * B * B - u * B - u * B * B, -(A * B + w * B * B + w * B**3)])
    real = roots[np.abs(roots.imag) < 1e-9].real
    Z = float(max(z for z in real if z > B))
    if kind == "VDW":
        ln = Z - 1 - math.log(Z - B) - A / Z
    elif kind == "SRK":
        ln = Z - 1 - math.log(Z - B) - A / B * math.log(1 + B / Z)
    else:
        s = math.sqrt(2)
        ln = Z - 1 - math.log(Z - B) - A / (2 * s * B) * math.log((Z + (1 + s) * B) / (Z + (1 - s) * B))
    return {"Z": Z, "V": Z * R * T / P, "fugacity_coeff": math.exp(ln), "A": A, "B": B}


def vle(T: float, P: float, z, antoine) -> dict:
    """Vapour and liquid of a feed at T (K) and P (mmHg): K-values by Raoult's law and Antoine's equation, then a flash."""
    a = np.asarray(antoine, float)
    K = 10 ** (a[:, 0] - a[:, 1] / (T - 273.15 + a[:, 2])) / P
    return flash(z, K) | {"K": K}


def flash(z, K, steps: int = 50) -> dict:
    """Vapour share by bisection of Rachford and Rice's equation."""
    z, K = np.asarray(z, float), np.asarray(K, float)
    f = lambda v: float((z * (K - 1) / (1 + v * (K - 1))).sum())
    if f(0) <= 0 or f(1) >= 0:
        v = 0.0 if f(0) <= 0 else 1.0
    else:
        lo, hi = 0.0, 1.0
        for _ in range(steps):
            v = (lo + hi) / 2
            lo, hi = (v, hi) if f(v) > 0 else (lo, v)
    x = z / (1 + v * (K - 1))
    return {"V": v, "x": x / x.sum(), "y": K * x / (K * x).sum(), "phase": "liquid" if v == 0 else "vapor" if v == 1 else "two_phase"}


def bubble_point(x, P: float, antoine) -> dict:
    """Temperature (K) at which sum x K = 1, K from Antoine's A, B, C (log10 mmHg, Celsius; P in mmHg)."""
    x, a = np.asarray(x, float), np.asarray(antoine, float)
    K = lambda T: 10 ** (a[:, 0] - a[:, 1] / (T - 273.15 + a[:, 2])) / P
    lo, hi = 200.0, 700.0
    for _ in range(80):
        T = (lo + hi) / 2
        lo, hi = (T, hi) if (x * K(T)).sum() < 1 else (lo, T)
    y = x * K(T)
    return {"T": T, "y": y / y.sum(), "K": K(T)}


def dew_point(y, P: float, antoine) -> dict:
    y, a = np.asarray(y, float), np.asarray(antoine, float)
    K = lambda T: 10 ** (a[:, 0] - a[:, 1] / (T - 273.15 + a[:, 2])) / P
    lo, hi = 200.0, 700.0
    for _ in range(80):
        T = (lo + hi) / 2
        lo, hi = (T, hi) if (y / K(T)).sum() > 1 else (lo, T)
    x = y / K(T)
    return {"T": T, "x": x / x.sum(), "K": K(T)}


def shortcut_column(x_D: float, x_B: float, alpha: float, q: float, z_F: float) -> dict:
    """Fenske's least stages, Underwood's least reflux, Gilliland's stages at 1.2 times that (Eduljee's form)."""
    n = math.log(x_D / (1 - x_D) * (1 - x_B) / x_B) / math.log(alpha)
    f = lambda t: alpha * z_F / (alpha - t) + (1 - z_F) / (1 - t) - (1 - q)
    lo, hi = 1 + 1e-9, alpha - 1e-9
    for _ in range(100):
        t = (lo + hi) / 2
        lo, hi = (t, hi) if f(t) < 0 else (lo, t)
    least = alpha * x_D / (alpha - t) + (1 - x_D) / (1 - t) - 1
    r = 1.2 * least
    y = 0.75 * (1 - ((r - least) / (r + 1)) ** 0.5668)
    return {"N_min": n, "R_min": least, "R_actual": r, "N_actual": (n + y) / (1 - y), "theta": t}


def heat_equation(T, alpha: float, dt: float, dx: float, steps: int, left: float, right: float) -> np.ndarray:
    """Crank and Nicolson with fixed ends: a row for each step."""
    T = np.array(T, float)
    n, r = len(T), alpha * dt / (2 * dx * dx)
    m = np.eye(n) * (1 + 2 * r) - r * (np.eye(n, k=1) + np.eye(n, k=-1))
    e = np.eye(n) * (1 - 2 * r) + r * (np.eye(n, k=1) + np.eye(n, k=-1))
    for a in (m, e):
        a[0] = a[-1] = 0
    m[0, 0] = m[-1, -1] = 1
    inverse, rows = np.linalg.inv(m), [T]
    for _ in range(steps):
        b = e @ rows[-1]
        b[0], b[-1] = left, right
        rows.append(inverse @ b)
    return np.array(rows)


def stefan(T_hot: float, T_melt: float, k: float, rho: float, cp: float, L: float, t: float) -> dict:
    """One-phase Stefan problem: lambda exp(lambda^2) erf(lambda) = Ste / sqrt(pi)."""
    ste = cp * (T_hot - T_melt) / L
    lo, hi = 1e-9, 5.0
    for _ in range(100):
        x = (lo + hi) / 2
        lo, hi = (x, hi) if x * math.exp(x * x) * math.erf(x) < ste / math.sqrt(math.pi) else (lo, x)
    a = k / (rho * cp)
    return {"s": 2 * x * math.sqrt(a * t), "lambda": x, "stefan_number": ste, "thermal_diffusivity": a}


def regime(Re: Value) -> Column:
    return pick((c(Re) < 2300, "laminar"), (c(Re) < 4000, "transitional"), other="turbulent")
