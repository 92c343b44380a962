"""Velocity fields as rows (field_id, ix, iy[, iz], u, v[, w]): differences along an axis are windows, tensors are expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sigloom.functions.physics.base import Value, c, out, over, pick

AXES = ("ix", "iy", "iz")


def derivative(value: str, axis: str, step: float, axes: tuple[str, ...]) -> Column:
    """Central inside, one-sided at the ends."""
    w = W.partitionBy("field_id", *[a for a in axes if a != axis]).orderBy(axis)
    v, after, before = F.col(value), F.lead(value).over(w), F.lag(value).over(w)
    return F.coalesce((after - before) / (2 * step), (after - v) / step, (v - before) / step)


def gradients(field: DataFrame, steps: tuple[float, ...]) -> DataFrame:
    """Adds d{u,v,w}_d{x,y,z} for as many axes as there are steps."""
    axes = AXES[: len(steps)]
    for axis, step in zip(axes, steps):  # one sort for each axis
        field = field.withColumns({f"d{n}_d{axis[1]}": derivative(n, axis, step, axes) for n in ("u", "v", "w")[: len(steps)]})
    return field


def vorticity(g: DataFrame) -> DataFrame:
    if "du_dz" not in g.columns:
        z = F.col("dv_dx") - F.col("du_dy")
        return g.withColumns({"omega_z": z, "vorticity_magnitude": F.abs(z)})
    x, y, z = F.col("dw_dy") - F.col("dv_dz"), F.col("du_dz") - F.col("dw_dx"), F.col("dv_dx") - F.col("du_dy")
    return g.withColumns({"omega_x": x, "omega_y": y, "omega_z": z, "vorticity_magnitude": F.sqrt(x * x + y * y + z * z)})


def divergence(g: DataFrame) -> DataFrame:
    return g.withColumn("divergence", sum((F.col(f"d{n}_d{a}") for n, a in zip("uvw", "xyz") if f"d{n}_d{a}" in g.columns), F.lit(0.0)))


def invariants(g: DataFrame, nu: float) -> DataFrame:
    """Q, R and delta of the velocity gradient, dissipation, enstrophy and helicity (three dimensions)."""
    A = [[F.col(f"d{n}_d{a}") for a in "xyz"] for n in "uvw"]
    S = [[(A[i][j] + A[j][i]) / 2 for j in range(3)] for i in range(3)]
    O = [[(A[i][j] - A[j][i]) / 2 for j in range(3)] for i in range(3)]  # noqa: E741
    square = lambda m: sum((m[i][j] * m[i][j] for i in range(3) for j in range(3)), F.lit(0.0))
    det = A[0][0] * (A[1][1] * A[2][2] - A[1][2] * A[2][1]) - A[0][1] * (A[1][0] * A[2][2] - A[1][2] * A[2][0]) + A[0][2] * (A[1][0] * A[2][1] - A[1][1] * A[2][0])
    g = vorticity(g)
    q, r = (square(O) - square(S)) / 2, -det
    speed = F.sqrt(F.col("u") ** 2 + F.col("v") ** 2 + F.col("w") ** 2)
    spin = F.col("u") * F.col("omega_x") + F.col("v") * F.col("omega_y") + F.col("w") * F.col("omega_z")
    return g.withColumns({"Q": q, "delta": F.pow(q / 3, F.lit(3.0)) + F.pow(r / 2, F.lit(2.0)), "dissipation": 2 * nu * square(S), "enstrophy": 0.5 * F.col("vorticity_magnitude") ** 2, "helicity": spin, "relative_helicity": over(spin, speed * F.col("vorticity_magnitude"))})


def _tensor(g: DataFrame, sign: int, name: str) -> DataFrame:
    return g.withColumns({f"{name}_{a}{b}": (F.col(f"d{'uvw'[i]}_d{b}") + sign * F.col(f"d{'uvw'[j]}_d{a}")) / 2 for i, a in enumerate("xyz") for j, b in enumerate("xyz") if i <= j and (sign > 0 or i < j)})


def strain_rate(g: DataFrame) -> DataFrame:
    """s_xx, s_xy, ...: the symmetric part of the velocity gradient."""
    return _tensor(g, 1, "s")


def rotation(g: DataFrame) -> DataFrame:
    """r_xy, r_xz, r_yz: its skew part."""
    return _tensor(g, -1, "r")


def laplacian(field: DataFrame, value: str, steps: tuple[float, ...]) -> DataFrame:
    """Adds the sum of second differences of a value; null on the border."""
    axes = AXES[: len(steps)]
    total = F.lit(0.0)
    for axis, step in zip(axes, steps):
        w = W.partitionBy("field_id", *[a for a in axes if a != axis]).orderBy(axis)
        total = total + (F.lead(value).over(w) - 2 * F.col(value) + F.lag(value).over(w)) / (step * step)
    return field.withColumn(f"laplacian_{value}", total)


def speed(field: DataFrame) -> DataFrame:
    return field.withColumn("velocity_magnitude", F.sqrt(sum((F.col(n) * F.col(n) for n in "uvw" if n in field.columns), F.lit(0.0))))


def shape(field: DataFrame) -> DataFrame:
    """Extents of each field, and whether it is whole: every cell once, no velocity missing."""
    axes = [a for a in AXES if a in field.columns]
    sizes = [F.count_distinct(a).alias(f"n_{a[1:]}") for a in axes]
    m = field.groupBy("field_id").agg(*sizes, F.count(F.lit(1)).alias("n_cells"), F.count_if(sum((F.col(n).isNull().cast("int") for n in "uvw" if n in field.columns), F.lit(0)) > 0).alias("n_missing"))
    cells = F.lit(1)
    for a in axes:
        cells = cells * F.col(f"n_{a[1:]}")
    return m.withColumn("is_valid", (F.col("n_cells") == cells) & (F.col("n_missing") == 0))


def analysis(field: DataFrame, steps: tuple[float, ...], nu: float, length: float) -> DataFrame:
    """One row for each field: Reynolds numbers, regime, intensity, and means of energy, dissipation, enstrophy, helicity and Q."""
    m = speed(invariants(gradients(field, steps), nu)).groupBy("field_id").agg(
        *[F.avg(c).alias(f"mean_{c}") for c in ("velocity_magnitude", "dissipation", "enstrophy", "helicity", "Q")], *[F.var_pop(c).alias(f"var_{c}") for c in "uvw"]
    )
    tke = (F.col("var_u") + F.col("var_v") + F.col("var_w")) / 2
    m = m.withColumns({"mean_tke": tke, "reynolds_number": F.col("mean_velocity_magnitude") * length / nu})
    u2 = 2 * F.col("mean_tke") / 3
    taylor = F.sqrt(15 * nu * u2 / F.col("mean_dissipation"))
    kind = pick((F.col("reynolds_number") < 2300, "laminar"), (F.col("reynolds_number") < 4000, "transitional"), other="turbulent")
    return m.withColumns({"taylor_reynolds_number": F.sqrt(u2) * taylor / nu, "turbulence_intensity": F.sqrt(u2) / F.col("mean_velocity_magnitude"), "flow_regime": kind}).drop("var_u", "var_v", "var_w")


def lambda2(gradient: np.ndarray) -> np.ndarray:
    """Middle eigenvalue of S^2 + O^2 for an array of 3x3 gradients."""
    s, o = (gradient + gradient.swapaxes(-1, -2)) / 2, (gradient - gradient.swapaxes(-1, -2)) / 2
    return np.linalg.eigvalsh(s @ s + o @ o)[..., 1]


def turbulence(field: DataFrame, rho: float = 1.0, by: tuple[str, ...] = ("field_id",)) -> DataFrame:
    """Mean flow, kinetic energy and Reynolds stresses of the fluctuations, for each group of rows."""
    m = field.groupBy(*by).agg(
        *[F.avg(x).alias(f"mean_{x}") for x in "uvw"], *[F.covar_pop(a, b).alias(f"cov_{a}{b}") for a, b in ("uu", "vv", "ww", "uv", "uw", "vw")]
    )
    return m.withColumns({"tke": (F.col("cov_uu") + F.col("cov_vv") + F.col("cov_ww")) / 2, **{f"tau_{p}": -rho * F.col(f"cov_{p}") for p in ("uu", "vv", "ww", "uv", "uw", "vw")}})


def scales(epsilon: Value, nu: Value, u2: Value) -> Column:
    e, n = c(epsilon), c(nu)
    taylor = F.sqrt(15 * n * c(u2) / e)
    return out(kolmogorov_length=F.pow(n * n * n / e, F.lit(0.25)), kolmogorov_time=F.sqrt(n / e), kolmogorov_velocity=F.pow(n * e, F.lit(0.25)), taylor_microscale=taylor, taylor_reynolds=F.sqrt(c(u2)) * taylor / n)


def reynolds(U: Value, L: Value, nu: Value) -> Column:
    re = c(U) * c(L) / c(nu)
    return out(Re=re, regime=pick((re < 2300, "laminar"), (re < 4000, "transitional"), other="turbulent"))


def spectrum(u: np.ndarray, v: np.ndarray, w: np.ndarray, d: float, bins: int = 100) -> tuple[np.ndarray, np.ndarray]:
    k = np.stack(np.meshgrid(*[2 * np.pi * np.fft.fftfreq(n, d) for n in u.shape], indexing="ij"))
    size = np.sqrt((k**2).sum(0)).ravel()
    e = sum(np.abs(np.fft.fftn(x - x.mean()) / x.size) ** 2 for x in (u, v, w)).ravel() / 2
    edges = np.linspace(0, size.max(), bins + 1)
    return (edges[:-1] + edges[1:]) / 2, np.histogram(size, edges, weights=e)[0]


def slope(k: np.ndarray, e: np.ndarray) -> dict:
    from sigloom.functions.mathx import line

    use = np.flatnonzero(e > 0)
    use = use[len(use) // 4 : max(len(use) * 3 // 4, len(use) // 4 + 2)]
    s = line(np.log10(k[use]), np.log10(e[use]))[0]
    return {"slope": s, "is_kolmogorov": abs(s + 5 / 3) < 0.3}


def integral_scale(u: np.ndarray, dx: float) -> float:
    """Autocorrelation along the first axis, up to where it is first negative."""
    d = u - u.mean()
    r = np.array([(d[k:] * d[: len(d) - k]).mean() for k in range(len(d) // 2)]) / (d * d).mean()
    end = int(np.argmax(r < 0)) if (r < 0).any() else len(r)
    return float(np.trapezoid(r[:end], dx=dx))


def vortex_centres(omega: np.ndarray, dx: float, dy: float, share: float = 0.5) -> list[dict]:
    """Connected regions above a share of the greatest vorticity, by flood fill."""
    strong, seen, found = np.abs(omega) > share * np.abs(omega).max(), np.zeros(omega.shape, bool), []
    for i, j in zip(*np.nonzero(strong)):
        if seen[i, j]:
            continue
        todo, cells = [(i, j)], []
        while todo:
            a, b = todo.pop()
            if 0 <= a < omega.shape[0] and 0 <= b < omega.shape[1] and strong[a, b] and not seen[a, b] and omega[a, b] * omega[i, j] > 0:
                seen[a, b] = True
                cells.append((a, b))
                todo += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
        p, w = np.array(cells), np.abs([omega[x] for x in cells])
        found.append({"x": float((p[:, 0] * w).sum() / w.sum() * dx), "y": float((p[:, 1] * w).sum() / w.sum() * dy), "circulation": float(sum(omega[x] for x in cells) * dx * dy), "n_cells": len(cells)})
    return found


def two_phase(j_g: Value, j_l: Value, rho_g: Value, rho_l: Value, sigma: Value, D: Value, g: float = 9.81) -> Column:
    """Drift flux (Zuber and Findlay) in a vertical pipe."""
    j = c(j_g) + c(j_l)
    drift = 1.53 * F.pow(c(sigma) * g * (c(rho_l) - c(rho_g)) / (c(rho_l) * c(rho_l)), F.lit(0.25))
    void = c(j_g) / (1.2 * j + drift)
    return out(flow_regime=pick((void < 0.25, "bubbly"), (void < 0.65, "slug"), (void < 0.85, "churn"), other="annular"), drift_velocity=drift, void_fraction=void, beta=over(j_g, j), froude=j / F.sqrt(g * c(D)), weber=c(rho_l) * j * j * c(D) / c(sigma))


def poiseuille(y: Value, H: Value, u_max: Value) -> Column:
    return c(u_max) * 4 * c(y) / c(H) * (1 - c(y) / c(H))


def profile_error(y, u, y_ref, u_ref, tolerance: float = 0.05) -> dict:
    """A computed profile against tabulated points, linearly between its own."""
    gap = np.abs(np.interp(y_ref, y, u) - np.asarray(u_ref))
    return {"max_abs_error": float(gap.max()), "l2_error": math.sqrt(float((gap**2).mean())), "passed": bool(gap.max() < tolerance)}
