"""Kinetics, reactors, electrodes and separations."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from sigloom.functions.physics.base import FARADAY, R, Value, c, out, over, pick


def butler_volmer(eta: Value, i0: Value, alpha: Value = 0.5, n: Value = 1, T: Value = 298.15) -> Column:
    f = c(n) * FARADAY / (R * c(T))
    there, back = c(i0) * F.exp(c(alpha) * f * c(eta)), c(i0) * F.exp(-(1 - c(alpha)) * f * c(eta))
    return out(i=there - back, i_anodic=there, i_cathodic=-back)


def tafel(eta: Value, i0: Value, alpha: Value = 0.5, n: Value = 1, T: Value = 298.15) -> Column:
    slope = math.log(10) * R * c(T) / (c(n) * FARADAY)
    ba, bc = slope / c(alpha), slope / (1 - c(alpha))
    e = c(eta)
    return out(i=pick((e >= 0, c(i0) * F.pow(F.lit(10.0), e / ba)), other=-c(i0) * F.pow(F.lit(10.0), -e / bc)), b_anodic=ba, b_cathodic=bc, region=pick((e >= 0, "anodic"), other="cathodic"))


def limiting_current(i_L: Value, i_kinetic: Value) -> Column:
    i = over(i_L, 1 + over(i_L, i_kinetic))
    share = over(i, i_L)
    return out(i=i, i_over_i_L=share, surface_concentration_ratio=1 - share, limitation=pick((share > 0.9, "mass_transfer"), (share < 0.1, "kinetic"), other="mixed"))


def mixed_potential(E_a: Value, E_c: Value, i0_a: Value, i0_c: Value, b_a: Value, b_c: Value) -> Column:
    """Where the anodic Tafel line meets the cathodic one."""
    E = (F.log10(over(i0_c, i0_a)) + over(E_c, b_c) + over(E_a, b_a)) / (over(1, b_a) + over(1, b_c))
    return out(E_corr=E, i_corr=c(i0_a) * F.pow(F.lit(10.0), over(E - c(E_a), b_a)), polarization_anodic=E - c(E_a), polarization_cathodic=E - c(E_c))


def exchange_current_density(i0_ref: Value, T_ref: Value, T: Value, E_a: Value) -> Column:
    ratio = F.exp(-c(E_a) / R * (1 / c(T) - 1 / c(T_ref)))
    return out(i0=c(i0_ref) * ratio, ratio=ratio)


def polarization_curve(eta: Value, i0: Value, alpha: Value = 0.5, n: Value = 1, T: Value = 298.15, i_L: Value | None = None) -> Column:
    """Current by Butler and Volmer at each overpotential, held by the limiting current where one is given."""
    i = butler_volmer(eta, i0, alpha, n, T)["i"]
    if i_L is not None:
        i = i / (1 + F.abs(i) / c(i_L))
    return out(eta=c(eta), i=i, log_abs_i=F.log10(F.abs(i) + 1e-20))


def arrhenius(A: Value, Ea: Value, T: Value) -> Column:
    x = c(Ea) / (R * c(T))
    return out(k=c(A) * F.exp(-x), exponential_factor=F.exp(-x), Ea_RT=x)


def arrhenius_two_temperatures(k1: Value, T1: Value, k2: Value, T2: Value) -> Column:
    Ea = -R * F.ln(over(k2, k1)) / (1 / c(T2) - 1 / c(T1))
    return out(activation_energy=Ea, pre_exponential=c(k1) * F.exp(Ea / (R * c(T1))), Ea_kJ_mol=Ea / 1000, ratio_k2_k1=over(k2, k1))


def power_law_rate(k: Value, concentrations: Column, orders: Column) -> Column:
    """Arrays of concentrations and orders."""
    terms = F.zip_with(concentrations, orders, lambda x, n: F.pow(x, n))
    return out(rate=c(k) * F.aggregate(terms, F.lit(1.0), lambda a, x: a * x), overall_order=F.aggregate(orders, F.lit(0.0), lambda a, x: a + x))


def michaelis_menten(V_max: Value, K_m: Value, S: Value) -> Column:
    share = over(S, c(K_m) + c(S))
    return out(rate=c(V_max) * share, saturation_fraction=share)


def langmuir_hinshelwood(k: Value, K_A: Value, K_B: Value, P_A: Value, P_B: Value) -> Column:
    a, b = c(K_A) * c(P_A), c(K_B) * c(P_B)
    d = 1 + a + b
    return out(rate=c(k) * a * b / (d * d), coverage_A=a / d, coverage_B=b / d, total_coverage=(a + b) / d, vacant_fraction=1 / d)


def conversion(N_A0: Value, N_A: Value) -> Column:
    x = over(c(N_A0) - c(N_A), N_A0)
    return out(conversion=x, moles_reacted=c(N_A0) - c(N_A), moles_remaining=c(N_A), percent_conversion=100 * x)


def yield_and_selectivity(N_desired: Value, N_A0: Value, N_A: Value, N_undesired: Value = 0, stoich: Value = 1) -> Column:
    used = c(N_A0) - c(N_A)
    return out(**{"yield": over(c(N_desired) * c(stoich), used), "selectivity": over(N_desired, c(N_desired) + c(N_undesired)), "conversion": over(used, N_A0), "overall_yield": over(c(N_desired) * c(stoich), N_A0)})


def batch_reactor_time(C_A0: Value, k: Value, X: Value, order: int = 1) -> Column:
    x, k_, a = c(X), c(k), c(C_A0)
    time = {0: a * x / k_, 1: -F.ln(1 - x) / k_, 2: x / (k_ * a * (1 - x))}.get(order, (F.pow(1 - x, F.lit(1.0 - order)) - 1) / ((order - 1.0) * k_ * F.pow(a, F.lit(order - 1.0))))
    return out(time=time, conversion=x)


def cstr_volume(F_A0: Value, X: Value, k: Value, C_A0: Value, order: int = 1) -> Column:
    exit_ = c(C_A0) * (1 - c(X))
    rate = c(k) * F.pow(exit_, F.lit(float(order)))
    v = over(c(F_A0) * c(X), rate)
    return out(volume=v, space_time=over(v * c(C_A0), F_A0), exit_concentration=exit_, rate=rate)


def pfr_volume(F_A0: Value, X: Value, k: Value, C_A0: Value, order: int = 1) -> Column:
    """The zero-order integral is C_A0 X / k before it is multiplied by the feed."""
    x, k_, a = c(X), c(k), c(C_A0)
    integral = {0: a * x / k_, 1: -F.ln(1 - x) / (k_ * a), 2: x / (1 - x) / (k_ * a * a)}[order]
    v = c(F_A0) * integral
    return out(volume=v, space_time=over(v * a, F_A0), volumetric_flow=over(F_A0, a))


def equilibrium_constant(delta_G: Value, T: Value) -> Column:
    x = -c(delta_G) / (R * c(T))
    return out(K=F.exp(x), ln_K=x, spontaneous_forward=c(delta_G) < 0)


def residence_time(t: Value, E: Value) -> list[Column]:
    """Aggregates over rows of t and E at even steps: weights are E over its sum."""
    w, t = c(E), c(t)
    mean = F.sum(t * w) / F.sum(w)
    var = F.sum(t * t * w) / F.sum(w) - mean * mean
    return [mean.alias("mean_residence_time"), var.alias("variance"), F.sqrt(var).alias("standard_deviation"), over(var, mean * mean).alias("dispersion")]


def absorption(y_in: Value, y_out: Value, x_in: Value = 0, L_G: Value = 1.5, H: Value = 1) -> Column:
    a = over(L_G, H)
    base = c(H) * c(x_in)
    far = F.ln((c(y_in) - base) / (c(y_out) - base) * (1 - 1 / a) + 1 / a) / (1 - 1 / a)
    ntu = F.when(F.abs(a - 1) < 0.01, (c(y_in) - c(y_out)) / (c(y_out) - base)).otherwise(far)
    return out(NTU=ntu, HTU=1.0, height=ntu, absorption_factor=a)


def distillation_stages(x_feed: float, x_distillate: float, x_bottoms: float, q: float, alpha: float, reflux: float) -> dict:
    """Stages stepped off between the equilibrium curve and the operating lines (McCabe and Thiele)."""
    stages, y, feed = [], x_distillate, None
    vapour = 1 - q
    slope = (reflux + q) / vapour if vapour > 0 else math.inf
    while len(stages) < 100:
        x = y / (alpha - (alpha - 1) * y)
        stages.append((x, y))
        if x <= x_bottoms:
            break
        if feed is None and x <= x_feed:
            feed = len(stages)
        y = (reflux * x + x_distillate) / (reflux + 1) if feed is None else slope * (x - x_bottoms) + x_bottoms
    return {"n_stages": len(stages), "feed_stage": feed or len(stages), "stages": stages}


def rates(y: np.ndarray, k, stoich, orders) -> np.ndarray:
    """Change of each species: stoich[i, j] of species i in reaction j of rate k[j] prod y ** orders[:, j]."""
    y = np.maximum(y, 0)
    return np.asarray(stoich, float) @ (np.asarray(k, float) * np.prod(y[:, None] ** np.asarray(orders, float), 0))


def stiff(f, y0, span: tuple[float, float], points: int = 100, inner: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Backward Euler with Newton steps, twice at half step for Richardson's extrapolation."""

    def step(y, t, h):
        z = y + h * f(t, y)
        for _ in range(12):
            g = z - y - h * f(t + h, z)
            eps = 1e-7 * np.maximum(np.abs(z), 1e-7)
            jac = np.eye(len(z)) - h * np.stack([(f(t + h, z + eps[i] * np.eye(len(z))[i]) - f(t + h, z)) / eps[i] for i in range(len(z))], 1)
            d = np.linalg.solve(jac, g)
            z = z - d
            if np.abs(d).max() <= 1e-11 * (1 + np.abs(z).max()):
                break
        return z

    t = np.linspace(*span, points)
    y = [np.array(y0, float)]
    for a, b in zip(t[:-1], t[1:]):
        now, h = y[-1], (b - a) / inner
        for i in range(inner):
            at = a + i * h
            half = step(step(now, at, h / 2), at + h / 2, h / 2)
            now = np.maximum(2 * half - step(now, at, h), 0)
        y.append(now)
    return t, np.array(y)


def batch_reactor(y0, span, k, stoich, orders, points: int = 100) -> dict:
    t, y = stiff(lambda _, y: rates(y, k, stoich, orders), y0, span, points)
    return {"t": t, "C": y, "C_final": y[-1], "conversion": 1 - y[-1][0] / y0[0] if y0[0] else math.nan}


def cstr(y0, span, k, stoich, orders, tau: float, C_in, points: int = 100) -> dict:
    t, y = stiff(lambda _, y: (np.asarray(C_in) - y) / tau + rates(y, k, stoich, orders), y0, span, points)
    return {"t": t, "C": y, "C_final": y[-1], "steady_state": bool(np.abs(y[-1] - y[-2]).max() < 1e-6 * (1 + np.abs(y[-1]).max()))}


def pfr(C0, volume: tuple[float, float], k, stoich, orders, flow: float, points: int = 100) -> dict:
    v, y = stiff(lambda _, y: rates(y, k, stoich, orders) / flow, C0, volume, points)
    return {"V": v, "C": y, "C_exit": y[-1], "conversion": 1 - y[-1][0] / C0[0] if C0[0] else math.nan, "space_time": (volume[1] - volume[0]) / flow}


def nonisothermal_batch(y0, T0: float, span, k0, Ea, delta_H, stoich, orders, rho: float, Cp: float, volume: float = 1, UA: float = 0, T_coolant: float = 298, points: int = 100) -> dict:
    def f(_, z):
        y, T = z[:-1], z[-1]
        k = np.asarray(k0) * np.exp(-np.asarray(Ea) / (R * T))
        r = k * np.prod(np.maximum(y, 0)[:, None] ** np.asarray(orders, float), 0)
        return np.append(np.asarray(stoich, float) @ r, (-(np.asarray(delta_H) @ r) * volume - UA * (T - T_coolant)) / (rho * Cp * volume))

    t, z = stiff(f, [*y0, T0], span, points)
    return {"t": t, "C": z[:, :-1], "T": z[:, -1], "T_final": z[-1, -1], "T_max": z[:, -1].max()}


def crystal_growth(sigma: Value, k_n: Value, n: Value, k_g: Value, g: Value) -> Column:
    """Nucleation and growth by powers of the supersaturation."""
    s = F.greatest(c(sigma), F.lit(0.0))
    return out(B=c(k_n) * F.pow(s, c(n)), G=c(k_g) * F.pow(s, c(g)), mass_growth_rate=3 * c(k_g) * F.pow(s, c(g)))


def solubility(T: Value, A: Value, B: Value, C: Value) -> Column:
    return out(C_sat=c(A) + c(B) * c(T) + c(C) * c(T) * c(T), dC_dT=c(B) + 2 * c(C) * c(T))


def supersaturation(C: Value, C_sat: Value) -> Column:
    s = over(C, C_sat)
    return out(S=s, sigma=s - 1, delta_C=c(C) - c(C_sat), metastable=(s > 1) & (s <= 1.5), labile=s > 1.5)


def moments(sigma: float, span, k_n: float, k_g: float, n: float = 2, g: float = 1, start=(0, 0, 0, 0), points: int = 100) -> dict:
    """Population balance by its first four moments."""
    s = max(sigma, 0)
    B, G = k_n * s**n, k_g * s**g
    t, m = stiff(lambda _, m: np.array([B, G * m[0], 2 * G * m[1], 3 * G * m[2]]), start, span, points)
    return {"t": t, "moments": m, "mean_size": m[-1][1] / m[-1][0] if m[-1][0] > 0 else math.nan}
