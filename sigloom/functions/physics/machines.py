"""Bearings, gears, rotors, fatigue, motors, power and impedance."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from sigloom.functions import mathx as M
from sigloom.functions.physics.base import Value, c, out, over, pick

# ---------------------------------------------------------------- closed forms


def defect_frequencies(n_balls: Value, d_ball: Value, d_pitch: Value, angle_deg: Value, rpm: Value) -> Column:
    f, r = c(rpm) / 60, c(d_ball) / c(d_pitch) * F.cos(F.radians(c(angle_deg)))
    return out(BPFO=c(n_balls) / 2 * f * (1 - r), BPFI=c(n_balls) / 2 * f * (1 + r), BSF=c(d_pitch) / (2 * c(d_ball)) * f * (1 - r * r), FTF=f / 2 * (1 - r), shaft_frequency=f)


def mesh_frequencies(pinion: Value, gear: Value, rpm: Value) -> Column:
    f = c(rpm) / 60
    return out(GMF=c(pinion) * f, gear_ratio=over(gear, pinion), gear_shaft_freq=f * over(pinion, gear), GMF_harmonics=F.transform(F.array(*[F.lit(float(k)) for k in range(1, 6)]), lambda k: k * c(pinion) * f))


def basquin(S: Value, S_f: Value, b: Value) -> Column:
    n = 0.5 * F.pow(c(S) / c(S_f), 1 / c(b))
    return out(N=n, damage_per_cycle=1 / n)


def paris(delta_K: Value, C: Value, m: Value) -> Column:
    return c(C) * F.pow(c(delta_K), c(m))


def crack_life(a0: Value, a_c: Value, delta_sigma: Value, C: Value, m: float) -> Column:
    """Cycles from one crack length to another: Paris' law with a stress range, delta_K = delta_sigma sqrt(pi a), integrated."""
    k = c(C) * F.pow(c(delta_sigma) * math.sqrt(math.pi), F.lit(m))
    e = 1 - m / 2
    n = F.ln(c(a_c) / c(a0)) / k if e == 0 else (F.pow(c(a_c), F.lit(e)) - F.pow(c(a0), F.lit(e))) / (k * e)
    return out(N=n, da_dN_start=paris(c(delta_sigma) * F.sqrt(math.pi * c(a0)), C, m))


def critical_speed(m: Value, k: Value, rpm_low: Value, rpm_high: Value) -> Column:
    """Natural frequency of a rotor on its shaft, as a speed, and whether a range of speeds holds it."""
    w = F.sqrt(c(k) / c(m))
    rpm = w * 30 / math.pi
    return out(natural_frequency=w, critical_rpm=rpm, in_range=(rpm >= c(rpm_low)) & (rpm <= c(rpm_high)))


def unbalance(m: Value, k: Value, damping: Value, e: Value, omega: Value) -> Column:
    w2 = c(omega) * c(omega)
    stiff, loss = c(k) - c(m) * w2, c(damping) * c(omega)
    natural = F.sqrt(c(k) / c(m))
    zeta = c(damping) / (2 * F.sqrt(c(k) * c(m)))
    return out(amplitude=c(m) * c(e) * w2 / F.sqrt(stiff * stiff + loss * loss), phase=F.atan2(loss, stiff), critical_speed=natural, critical_speed_rpm=natural * 30 / math.pi, damping_ratio=zeta, amplification_factor=1 / (2 * zeta))


def rotor_stability(m: Value, k: Value, damping: Value, k_cross: Value) -> Column:
    """Stable where the damping holds the cross-coupled stiffness at the natural frequency."""
    w = F.sqrt(c(k) / c(m))
    zeta = c(damping) / (2 * F.sqrt(c(k) * c(m)))
    margin = c(damping) * w - c(k_cross)
    return out(natural_frequency=w, damping_ratio=zeta, log_decrement=2 * math.pi * zeta / F.sqrt(1 - zeta * zeta), stability_margin=margin, stable=margin > 0)


def motor_frequencies(line: Value, poles: Value, slip: Value) -> Column:
    sync = 2 * c(line) / c(poles)
    return out(sync_freq=sync, rotor_freq=sync * (1 - c(slip)), slip_freq=c(slip) * c(line), rpm_sync=60 * sync, rpm_rotor=60 * sync * (1 - c(slip)), broken_bar_lower=c(line) * (1 - 2 * c(slip)), broken_bar_upper=c(line) * (1 + 2 * c(slip)))


def randles(omega: Value, R_s: Value, R_ct: Value, C_dl: Value, sigma: Value = 0) -> Column:
    """With Warburg's element in the charge-transfer branch."""
    w = c(omega)
    re, im = c(R_ct) + c(sigma) / F.sqrt(w), -c(sigma) / F.sqrt(w)
    size = re * re + im * im
    a, b = re / size, -im / size + w * c(C_dl)
    d = a * a + b * b
    zr, zi = c(R_s) + a / d, -b / d
    return out(Z_real=zr, Z_imag=zi, Z_mag=F.sqrt(zr * zr + zi * zi), Z_phase=F.atan2(zi, zr), frequency=w / (2 * math.pi))


def constant_phase(omega: Value, R_s: Value, R_ct: Value, Q: Value, n: Value) -> Column:
    y, t = c(Q) * F.pow(c(omega), c(n)), c(n) * math.pi / 2
    a, b = 1 / c(R_ct) + y * F.cos(t), y * F.sin(t)
    d = a * a + b * b
    zr, zi = c(R_s) + a / d, -b / d
    return out(Z_real=zr, Z_imag=zi, Z_mag=F.sqrt(zr * zr + zi * zi), Z_phase=F.atan2(zi, zr))


# ---------------------------------------------------------------- aggregates over rows of a series


def condition_indicators(y: Value) -> list[Column]:
    a = F.abs(c(y))
    rms, peak, mean, root = F.sqrt(F.avg(a * a)), F.max(a), F.avg(a), F.avg(F.sqrt(a))
    return [rms.alias("rms"), peak.alias("peak"), over(peak, rms).alias("crest_factor"), (F.kurtosis(c(y)) + 3).alias("kurtosis"), F.skewness(c(y)).alias("skewness"), over(peak, root * root).alias("clearance_factor"), over(peak, mean).alias("impulse_factor"), over(rms, mean).alias("shape_factor")]


def amplitude(y: Value, t: Value, freq: float) -> Column:
    """Amplitude at one frequency: a single-bin transform as an aggregate of products."""
    w = 2 * math.pi * freq
    re, im = F.sum(c(y) * F.cos(w * c(t))), F.sum(c(y) * F.sin(w * c(t)))
    return 2 * F.sqrt(re * re + im * im) / F.count(c(y))


def decibels(a: Column, b: Column) -> Column:
    return 20 * F.log10((a + 1e-12) / (b + 1e-12))


def broken_rotor_bar(y: Value, t: Value, line: float, slip: float) -> list[Column]:
    main, low, high = (amplitude(y, t, f) for f in (line, line * (1 - 2 * slip), line * (1 + 2 * slip)))
    worst = F.greatest(decibels(low, main), decibels(high, main))
    return [worst.alias("brb_indicator_db"), decibels(low, main).alias("brb_lower_db"), decibels(high, main).alias("brb_upper_db"), pick((worst > -35, "severe"), (worst > -45, "moderate"), (worst > -54, "incipient"), other="healthy").alias("severity")]


def eccentricity(y: Value, t: Value, line: float, rotor: float) -> list[Column]:
    main, low, high = (amplitude(y, t, f) for f in (line, line - rotor, line + rotor))
    worst = F.greatest(decibels(low, main), decibels(high, main))
    return [worst.alias("dynamic_eccentricity_db"), pick((worst > -30, "severe"), (worst > -40, "moderate"), other="healthy").alias("condition")]


def bearing_fault_current(y: Value, t: Value, line: float, bearing: float, sidebands: int = 3) -> list[Column]:
    main = amplitude(y, t, line)
    worst = F.greatest(*[decibels(amplitude(y, t, abs(line + s * k * bearing)), main) for k in range(1, sidebands + 1) for s in (-1, 1)])
    return [worst.alias("bearing_indicator_db"), pick((worst > -40, "fault"), (worst > -50, "warning"), other="healthy").alias("condition")]


def sidebands(y: Value, t: Value, mesh: float, shaft: float, n: int = 3) -> list[Column]:
    main = amplitude(y, t, mesh)
    total = sum((amplitude(y, t, mesh + s * k * shaft) for k in range(1, n + 1) for s in (-1, 1)), F.lit(0.0))
    return [main.alias("GMF_amplitude"), over(total, main).alias("sideband_ratio"), (over(total, main) > 0.5).alias("fault_indicator")]


def harmonics(y: Value, t: Value, fundamental: float, n: int = 10) -> list[Column]:
    first, rest = amplitude(y, t, fundamental), [amplitude(y, t, fundamental * k) for k in range(2, n + 1)]
    return [first.alias("fundamental"), (F.sqrt(sum((x * x for x in rest), F.lit(0.0))) / first).alias("thd"), F.array(first, *rest).alias("harmonics")]


def power_factor(v: Value, i: Value) -> list[Column]:
    p, s = F.avg(c(v) * c(i)), F.sqrt(F.avg(c(v) * c(v))) * F.sqrt(F.avg(c(i) * c(i)))
    return [p.alias("P"), s.alias("S"), F.sqrt(F.greatest(s * s - p * p, F.lit(0.0))).alias("Q"), over(p, s).alias("pf")]


def miner(ranges: Value, counts: Value, S_f: Value, b: Value) -> list[Column]:
    d = F.sum(c(counts) / (0.5 * F.pow(c(ranges) / 2 / c(S_f), 1 / c(b))))
    return [d.alias("damage"), over(1, d).alias("remaining_life"), (d >= 1).alias("failed")]


def synchronous_average(df, keys: list[str], y: str, row: str, period: int):
    """Mean by phase and the noise about it: a group for each phase."""
    phase = F.pmod(F.col(row), F.lit(period))
    return df.groupBy(*keys, phase.alias("phase")).agg(F.avg(y).alias("tsa"), F.stddev_pop(y).alias("residual"), F.count(F.lit(1)).alias("n_averages"))


def nyquist_features(zr: Value, zi: Value) -> list[Column]:
    low, high, top = F.min(c(zr)), F.max(c(zr)), F.max(-c(zi))
    return [low.alias("R_s"), (high - low).alias("R_p"), high.alias("R_total"), top.alias("Z_imag_max"), F.max_by(c(zr), -c(zi)).alias("Z_real_at_max")]


# ---------------------------------------------------------------- kernels


def strain_life(amplitude_: float, sigma_f: float, eps_f: float, b: float, c_: float, E: float) -> dict:
    f = lambda n: sigma_f / E * (2 * n) ** b + eps_f * (2 * n) ** c_ - amplitude_
    lo, hi = 0.0, 12.0
    for _ in range(100):
        x = (lo + hi) / 2
        lo, hi = (x, hi) if f(10**x) > 0 else (lo, x)
    n = 10**x
    return {"N": n, "elastic": sigma_f / E * (2 * n) ** b, "plastic": eps_f * (2 * n) ** c_, "transition_life": 0.5 * (eps_f * E / sigma_f) ** (1 / (b - c_))}


def rainflow(y) -> list[tuple[float, float, float]]:
    """Range, mean and count of each cycle; what is left counts half."""
    y = np.asarray(y, float)
    d = np.diff(y)
    y = y[np.append(True, d != 0)] if len(y) else y
    turn = np.append(True, np.append(np.sign(np.diff(y))[1:] != np.sign(np.diff(y))[:-1], True)) if len(y) > 2 else np.ones(len(y), bool)
    stack, out_ = [], []
    for p in y[turn]:
        stack.append(float(p))
        while len(stack) >= 3 and abs(stack[-1] - stack[-2]) >= abs(stack[-2] - stack[-3]):
            a, b = stack[-3], stack[-2]
            if len(stack) == 3:
                out_.append((abs(b - a), (a + b) / 2, 0.5))
                stack.pop(0)
            else:
                out_.append((abs(b - a), (a + b) / 2, 1.0))
                del stack[-3:-1]
    return out_ + [(abs(b - a), (a + b) / 2, 0.5) for a, b in zip(stack, stack[1:])]


def envelope_spectrum(y, fs: float, band: tuple[float, float] | None = None) -> dict:
    y = np.asarray(y, float) - np.mean(y)
    f = np.fft.fftfreq(len(y), 1 / fs)
    if band:
        y = np.fft.ifft(np.where((np.abs(f) >= band[0]) & (np.abs(f) <= band[1]), np.fft.fft(y), 0)).real
    e = np.abs(M.analytic(y))
    s = np.abs(np.fft.rfft(e - e.mean())) * 2 / len(y)
    top = np.argsort(-s, kind="stable")[:10]
    g = np.fft.rfftfreq(len(y), 1 / fs)
    return {"frequencies": g, "envelope_spectrum": s, "peak_frequencies": g[top], "peak_magnitudes": s[top]}


def spectral_kurtosis(y, fs: float, bands: int = 16) -> dict:
    y = np.asarray(y, float)
    f, spectrum = np.fft.fftfreq(len(y), 1 / fs), np.fft.fft(y - y.mean())
    edges = np.linspace(0, fs / 2, bands + 1)
    k = []
    for a, b in zip(edges[:-1], edges[1:]):
        e = np.abs(M.analytic(np.fft.ifft(np.where((np.abs(f) >= a) & (np.abs(f) < b), spectrum, 0)).real)) ** 2
        k.append(float((e**2).mean() / max(e.mean() ** 2, 1e-300) - 2))
    best = int(np.argmax(k))
    return {"band_edges": edges, "kurtosis_per_band": np.array(k), "optimal_band": (edges[best], edges[best + 1]), "max_kurtosis": k[best]}


def orbit(x, y, fs: float, rpm: float) -> dict:
    t = np.arange(len(x)) / fs
    w = np.exp(-2j * np.pi * rpm / 60 * t) * 2 / len(x)
    a, b = (np.asarray(x) - np.mean(x)) @ w, (np.asarray(y) - np.mean(y)) @ w
    forward, backward = abs(a + 1j * b) / 2, abs(np.conj(a) + 1j * np.conj(b)) / 2
    return {"major_axis": forward + backward, "minor_axis": abs(forward - backward), "x_amplitude": abs(a), "y_amplitude": abs(b), "whirl_direction": "forward" if forward >= backward else "backward"}


def voltage_events(y, fs: float, nominal: float, f0: float, sag: float = 0.9, swell: float = 1.1) -> dict:
    """Runs of cycles below, above or without voltage; one that is open at the end is not an event."""
    n = int(round(fs / f0))
    rms = np.sqrt((np.asarray(y, float)[: len(y) // n * n].reshape(-1, n) ** 2).mean(1)) / nominal
    kind = np.where(rms < 0.1, "interruption", np.where(rms < sag, "sag", np.where(rms > swell, "swell", "")))
    cut = np.append(0, np.append(np.flatnonzero(kind[1:] != kind[:-1]) + 1, len(kind)))
    found = [(str(kind[a]), a / f0, (b - a) / f0) for a, b in zip(cut[:-1], cut[1:]) if len(kind) and kind[a] and b < len(kind)]
    return {"events": found, "pu_per_cycle": rms}


def flicker(y, fs: float, nominal: float) -> dict:
    n = max(1, int(fs / 100))
    rms = np.sqrt((np.asarray(y, float)[: len(y) // n * n].reshape(-1, n) ** 2).mean(1))
    d = (rms - rms.mean()) / nominal * 100
    return {"pst": float(np.percentile(np.abs(d), 99)), "max_fluctuation_percent": float(np.abs(d).max()), "std_fluctuation_percent": float(d.std())}


def gear_indicators(y, fs: float, mesh: float, n: int = 5) -> dict:
    y = np.asarray(y, float) - np.mean(y)
    t = np.arange(len(y)) / fs
    own = np.array([abs(y @ np.exp(-2j * np.pi * mesh * k * t)) * 2 / len(y) for k in range(1, n + 1)])
    fit = np.column_stack([f(2 * np.pi * mesh * k * t) for k in range(1, n + 1) for f in (np.cos, np.sin)])
    d = y - fit @ np.linalg.lstsq(fit, y, rcond=None)[0]
    return {"FM0": float(np.ptp(y) / max(own.sum(), 1e-12)), "FM4": float((d**4).mean() / max((d**2).mean() ** 2, 1e-300)), "GMF_energy_ratio": float((own**2).sum() / 2 / max((y**2).mean(), 1e-300)), "total_rms": float(y.std())}


def fit_randles(freq, zr, zi) -> dict:
    w, z = 2 * np.pi * np.asarray(freq, float), np.asarray(zr) + 1j * np.asarray(zi)
    model = lambda p: np.exp(p[0]) + 1 / (1 / (np.exp(p[1]) + np.exp(p[3]) * (1 - 1j) / np.sqrt(w)) + 1j * w * np.exp(p[2]))
    top = int(np.argmax(-z.imag))
    rs, rp = max(z.real.min(), 1e-6), max(np.ptp(z.real), 1e-6)
    p = np.log([rs, rp, 1 / (w[top] * rp), 1e-3 * rp])
    for _ in range(6):
        p = M.simplex(lambda q: float((np.abs(model(q) - z) ** 2).sum()), p, 800)
    rest = float((np.abs(model(p) - z) ** 2).sum())
    r = np.exp(p)
    return {"R_s": r[0], "R_ct": r[1], "C_dl": r[2], "sigma": r[3], "r_squared": 1 - rest / float((np.abs(z - z.mean()) ** 2).sum()), "time_constant": r[1] * r[2]}


def bode_features(freq, mag, phase) -> dict:
    order = np.argsort(freq)
    f, m, p = (np.asarray(v, float)[order] for v in (freq, mag, phase))
    n = max(2, len(f) // 5)
    slope = lambda a: M.line(np.log10(f[a]), np.log10(m[a]))[0]
    return {"corner_freq": float(f[np.abs(m - m.max() / math.sqrt(2)).argmin()]), "low_freq_slope": slope(slice(0, n)), "high_freq_slope": slope(slice(-n, None)), "Z_dc": float(m[0]), "Z_hf": float(m[-1]), "phase_min": float(p.min()), "phase_max": float(p.max())}


def modal(Mass, K, C=None) -> dict:
    """(K - w^2 M) phi = 0 through the Cholesky factor of M; mass-normalised shapes."""
    Mass, K = np.asarray(Mass, float), np.asarray(K, float)
    low = np.linalg.cholesky(Mass)
    inv = np.linalg.inv(low)
    w2, v = np.linalg.eigh(inv @ K @ inv.T)
    shape, w = inv.T @ v, np.sqrt(np.maximum(w2, 0))
    zeta = np.diag(shape.T @ np.asarray(C, float) @ shape) / (2 * np.where(w > 0, w, 1)) if C is not None else np.zeros(len(w))
    return {"natural_frequencies": w, "frequencies_hz": w / (2 * np.pi), "mode_shapes": shape, "damping_ratios": zeta, "damped_frequencies": w * np.sqrt(np.maximum(1 - zeta**2, 0))}


def participation(shapes, Mass, direction) -> dict:
    Mass, d = np.asarray(Mass, float), np.asarray(direction, float)
    g = shapes.T @ Mass @ d
    total = float(d @ Mass @ d)
    return {"participation_factors": g, "effective_mass": g**2, "effective_mass_ratio": g**2 / total, "cumulative_mass_ratio": np.cumsum(g**2) / total, "total_mass": total}


def receptance(omega, Mass, K, C, force, dof: int = 0) -> np.ndarray:
    return np.array([np.linalg.solve(np.asarray(K) - w * w * np.asarray(Mass) + 1j * w * np.asarray(C), np.asarray(force, float))[dof] for w in np.atleast_1d(omega)])
