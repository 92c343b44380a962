"""Kernels on signals, pairs and entities as grouped operators, and the measures that need no kernel.

A signal's series is one group; a pair is grouped by its own key, so that pairs spread over the cluster and no task holds
an entity; an entity's matrix is one group, for kernels that need all its signals at once. What a kernel returns becomes
one row, or a row for each element of its arrays.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sigloom.functions import kernels as K
from sigloom.functions.columns import corr, div
from sigloom.operators.catalog import KEY, Signals, by_index, view
from sigloom.operators.joins import PAIR, ahead, outer, pairs


@dataclass(frozen=True)
class Kernel:
    name: str
    level: str  # signal, pair (both directions), couple (a < b) or entity
    columns: str
    run: Callable

    @property
    def schema(self) -> str:
        keys = {"signal": "entity_id string, signal_id string", "entity": "entity_id string"}.get(self.level, "entity_id string, signal_a string, signal_b string")
        return f"{keys}, {self.columns}"


KERNELS: dict[str, Kernel] = {}


def kernel(name: str, level: str, columns: str, run: Callable) -> None:
    KERNELS[name] = Kernel(name, level, columns, run)


for _name, _columns, _run in (
    ("hurst", "hurst double, hurst_r2 double, hurst_method string", K.hurst),
    ("hurst_rs", "hurst double, hurst_r2 double, hurst_method string", K.hurst_rs),
    ("acf_decay", "acf_decay_rate double, half_life double, acf_1 double, acf_5 double", K.acf_decay),
    ("spectral_slope", "slope double, slope_r2 double", K.spectral_slope),
    ("fft", "spectral_centroid double, spectral_bandwidth double, low_high_ratio double, spectral_rolloff double, dominant_freq double, total_power double", K.fft),
    ("hilbert", ", ".join(f"{c}_{k} double" for c in ("amplitude", "phase", "frequency") for k in ("mean", "std")), K.hilbert),
    ("hilbert_points", "I double, amplitude double, phase double, frequency double", K.hilbert_points),
    ("wavelet", "energy_by_scale array<double>, dominant_scale int, scale_entropy double, low_high_ratio double, finest_std double", K.wavelet),
    ("sample_entropy", "sample_entropy double", K.sample_entropy),
    ("permutation_entropy", "permutation_entropy double, n_patterns int", K.permutation_entropy),
    ("entropy_rate", "I double, current_entropy double, entropy_rate double", K.entropy_rate),
    ("lyapunov", "lyapunov double, is_chaotic boolean, embedding_dim int, delay int, lyapunov_method string", K.lyapunov),
    ("embedding", "embedding_delay int, embedding_dim int", K.embedding),
    ("attractor", "attractor_dim int, attractor_delay int, correlation_dim double, lyapunov double, attractor_type string", K.attractor),
    ("basin", "basin string, stability double, transition_prob double, mean_distance double", K.basin),
    ("garch", "garch_omega double, garch_alpha double, garch_beta double, garch_persistence double, garch_loglik double, garch_method string", K.garch),
    ("garch_moments", "garch_omega double, garch_alpha double, garch_beta double, garch_persistence double, garch_loglik double, garch_method string", K.garch_moments),
    ("rqa", ", ".join(f"{c} double" for c in ("recurrence_rate", "determinism", "laminarity", "rqa_entropy", "trapping_time", "max_diagonal", "avg_diagonal")), partial(K.rqa, most=None)),
    ("signal_form", "predictability string, repetition string, standard_form string, symmetry double, frequency_content string, dominant_ratio double", K.typology),
    ("laplace_series", "I double, gradient double, laplacian double, field string", K.laplace_series),
    ("regime_detection", "regime int, start double, mean double", K.regimes),
    ("kalman", "I double, level double, variance double, innovation double, smoothed double, smoothed_variance double", K.kalman),
    ("flicker", "pst double, max_fluctuation_percent double, std_fluctuation_percent double", K.flicker),
    ("voltage_events", "kind string, start double, duration double", K.voltage_events),
    ("kalman_noise", "process_noise double, measurement_noise double", K.noise),
):
    kernel(_name, "signal", _columns, _run)
kernel("granger", "pair", "f_stat double, p_value double, lag int, is_causal boolean", K.granger)
kernel("cointegration", "pair", "coint_stat double, coint_p double, is_cointegrated boolean", K.cointegration)
kernel("dtw", "couple", "dtw_distance double, dtw_normalized double", K.dtw)
kernel("copula", "couple", "tail_lower double, tail_upper double, kendall_tau double, spearman double", K.copula)
kernel("divergence", "couple", "kl_symmetric double, js double, wasserstein double", K.divergence)
kernel("pca", "entity", "signal_id string, pc1 double, pc2 double, pc3 double, variance_1 double, variance_3 double", K.pca)
kernel("pca_coordinates", "entity", "I double, manifold_x double, manifold_y double, manifold_z double", K.pca_coordinates)
kernel("dmd", "entity", "mode int, growth double, frequency double, is_stable boolean, recon_error double", K.dmd)
kernel("clustering", "entity", "I double, regime_id int, centroid_distance double", K.clustering)
kernel("density_clustering", "entity", "I double, regime_id int", K.density_clustering)
kernel("mst", "entity", "source string, target string, distance double, source_degree int, target_degree int, hubs array<string>, leaves array<string>", K.tree)
kernel("lof", "entity", "signal_id string, lof_score double, is_outlier boolean", K.outliers)
kernel("convex_hull", "entity", "hull_area double, n_boundary int, mean_distance double, max_distance double, hull_method string", K.hull)
kernel("modes", "entity", "signal_id string, mode_id int, mode_affinity double, mode_entropy double", K.modes)


def frame(keys: dict, found: dict, columns: list[str]) -> pd.DataFrame:
    """One row, or as many as the arrays are long, with the keys before them."""
    long = next((len(v) for v in found.values() if isinstance(v, np.ndarray)), None)
    rows = pd.DataFrame(found) if long is not None else pd.DataFrame([found])
    for k, v in reversed(keys.items()):
        rows.insert(0, k, v)
    return rows[columns]


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def apply(s: Signals, name: str, **how) -> DataFrame:
    """Runs a kernel on every group of its level; `how` goes to the kernel."""
    k = KERNELS[name]
    columns = _columns(k.schema)
    points = s["v_base"].where("I is not null and y is not null").select(*KEY, "I", "y")
    if k.level == "signal":

        def signal(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("I")
            return frame(dict(zip(KEY, key)), k.run(pdf["I"].to_numpy(float), pdf["y"].to_numpy(float), **how), columns)

        return points.groupBy(*KEY).applyInPandas(signal, k.schema)
    if k.level in ("pair", "couple"):

        def pair(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("I")
            return frame(dict(zip(PAIR, key)), k.run(pdf["y_a"].to_numpy(float), pdf["y_b"].to_numpy(float), **how), columns)

        return pairs(points, "y", ordered=k.level == "couple").select(*PAIR, "I", "y_a", "y_b").groupBy(*PAIR).applyInPandas(pair, k.schema)

    def entity(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="I", columns="signal_id", values="y", aggfunc="mean").sort_index()
        wide = wide.fillna(wide.mean())
        return frame({"entity_id": key[0]}, k.run(wide.to_numpy(float), list(wide.columns), wide.index.to_numpy(float), **how), columns)

    return points.groupBy("entity_id").applyInPandas(entity, k.schema)


def windowed(s: Signals, name: str, size: int = 200, step: int = 20, **how) -> DataFrame:
    """A signal kernel over sliding windows of rows: each row goes to the windows that hold it, which are groups of their own."""
    k = KERNELS[name]
    row = F.row_number().over(by_index()) - 1
    numbered = s["v_base"].where("I is not null and y is not null").select(*KEY, "I", "y").withColumns({"row": row, "n": F.count(F.lit(1)).over(W.partitionBy(*KEY))})
    low = F.greatest(F.lit(0), F.ceil((F.col("row") - size + 1) / step)).cast("int")
    high = F.least(F.floor(F.col("row") / step), F.floor((F.col("n") - size) / step)).cast("int")
    held = numbered.where(low <= high).withColumn("window", F.explode(F.sequence(low, high)))
    schema = f"entity_id string, signal_id string, window int, centre double, {k.columns}"
    columns = _columns(schema)

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("I")
        found = k.run(pdf["I"].to_numpy(float), pdf["y"].to_numpy(float), **how)
        return frame({**dict(zip([*KEY, "window"], key)), "centre": float(pdf["I"].iloc[min(size // 2, len(pdf) - 1)])}, found, columns)

    return held.groupBy(*KEY, "window").applyInPandas(one, schema)


def around(s: Signals, name: str, at: float, size: int = 200, **how) -> DataFrame:
    """A signal kernel over the `size` rows about an index, moved inwards at the ends."""
    w = by_index()
    m = s["v_base"].withColumns({"row": F.row_number().over(w), "n": F.count(F.lit(1)).over(W.partitionBy(*KEY)), "at": F.count_if(F.col("I") <= at).over(W.partitionBy(*KEY))})
    first = F.greatest(F.lit(1), F.least(F.col("at") - size // 2, F.col("n") - size + 1))
    kept = m.where((F.col("row") >= first) & (F.col("row") < first + size))
    return apply(Signals(kept.select(*s.observations.columns)), name, **how)


def run_order(s: Signals) -> dict[str, DataFrame]:
    """The kernels that the work order asks for, each on the signals that need it."""
    order = s["v_work_order"]
    out = {}
    for need, name in (("hurst", "hurst"), ("lyapunov", "lyapunov"), ("fft", "fft"), ("garch", "garch"), ("wavelet", "wavelet"), ("rqa", "rqa"), ("sample_entropy", "sample_entropy")):
        wanted = order.where(f"needs_{need}").select(*KEY)
        out[name] = apply(Signals(s.observations.join(wanted, KEY, "left_semi")), name)
    return out


# ---------------------------------------------------------------- measures without a kernel

ABN = "entity_id signal_a signal_b"


def _cells(s: Signals, n: int) -> DataFrame:
    """Each value's bin of equal width between the signal's least and greatest."""
    w = W.partitionBy(*KEY)
    low, high = F.min("y").over(w), F.max("y").over(w)
    cell = F.least(F.floor(F.coalesce(div(F.col("y") - low, high - low), F.lit(0.0)) * n), F.lit(n - 1))
    return s["v_base"].withColumn("cell", cell)


def _h(counts: DataFrame, keys: list[str], *cells: str) -> DataFrame:
    """Entropy in bits of the distribution over `cells`."""
    n = counts.groupBy(*keys, *cells).agg(F.sum("n").alias("n"))
    p = n.withColumn("p", div("n", F.sum("n").over(W.partitionBy(*keys))))
    return p.groupBy(*keys).agg((-F.sum(F.col("p") * F.log2("p"))).alias(f"h_{''.join(cells)}"))


@view("entity_id signal_a signal_b ~mutual_info ~normalized_mi", "e_mutual_info")
def e_mutual_info(s: Signals):
    """Twenty bins of equal width, in bits; over the smaller entropy."""
    joint = pairs(_cells(s, 20), "cell").groupBy(*PAIR, F.col("cell_a").alias("a"), F.col("cell_b").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    m = _h(joint, PAIR, "a").join(_h(joint, PAIR, "b"), PAIR).join(_h(joint, PAIR, "a", "b"), PAIR)
    m = m.withColumn("mutual_info", F.greatest(F.lit(0.0), F.col("h_a") + F.col("h_b") - F.col("h_ab")))
    return m.withColumn("normalized_mi", div("mutual_info", F.least("h_a", "h_b")))


@view("entity_id source target ~transfer_entropy ~normalized_te", "e_transfer_entropy")
def e_transfer_entropy(s: Signals):
    """Ten bins of equal width, one step: what the source's past adds to the target's own, in bits, over the bits of a bin."""
    step = _cells(s, 10).select(*KEY, "I", "cell").withColumn("past", F.lag("cell").over(by_index())).where("past is not null")
    key = ["entity_id", "source", "target"]
    joint = (
        pairs(step, "cell", "past", ordered=False)
        .groupBy("entity_id", F.col("signal_a").alias("source"), F.col("signal_b").alias("target"), F.col("past_a").alias("x"), F.col("past_b").alias("p"), F.col("cell_b").alias("y"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    m = _h(joint, key, "y", "p").join(_h(joint, key, "p", "x"), key).join(_h(joint, key, "p"), key).join(_h(joint, key, "y", "p", "x"), key)
    m = m.withColumn("transfer_entropy", F.greatest(F.lit(0.0), F.col("h_yp") + F.col("h_px") - F.col("h_p") - F.col("h_ypx")))
    return m.withColumn("normalized_te", F.col("transfer_entropy") / F.log2(F.lit(10.0)))


LAPLACE_S = (0.001, 0.003, 0.01, 0.03, 0.1, 0.3, 1.0, 3.0)


@view("entity_id signal_id I ~s ~field", "e_running_laplace")
def e_running_laplace(s: Signals):
    """Sum of y exp(-s tau) dt from the beginning, over the span so far, for each real s: a running sum for each (signal, s)."""
    w = by_index()
    first = F.min("I").over(W.partitionBy(*KEY))
    m = s["v_base"].withColumns({"tau": F.col("I") - first, "dt": F.coalesce(F.col("I") - F.lag("I").over(w), F.lit(0.0))}).withColumn("s", F.explode(F.array(*[F.lit(x) for x in LAPLACE_S])))
    run = W.partitionBy(*KEY, "s").orderBy("I").rowsBetween(W.unboundedPreceding, 0)
    return m.withColumn("field", F.coalesce(div(F.sum(F.col("y") * F.exp(-F.col("s") * F.col("tau")) * F.col("dt")).over(run), "tau"), F.lit(0.0)))


@view("entity_id signal_id ~field_energy ~field_divergence ~dominant_s", "e_laplace_summary")
def e_laplace_summary(s: Signals):
    """Energy over all s, the sum of second differences, and the s whose field is strongest on average."""
    f = s["e_running_laplace"]
    by_s = f.groupBy(*KEY, "s").agg(F.avg(F.abs("field")).alias("m"), F.sum(F.col("field") * F.col("field")).alias("e"))
    m = by_s.groupBy(*KEY).agg(F.sum("e").alias("field_energy"), F.max_by("s", F.struct(F.round("m", 9), "s")).alias("dominant_s"))
    d = s["v_points"].groupBy(*KEY).agg(F.coalesce(F.sum("d2y"), F.lit(0.0)).alias("field_divergence"))
    return m.join(d, KEY)


@view("entity_id signal_id ~realized_volatility ~hd_slope ~mean_hamiltonian", "e_extras")
def e_extras(s: Signals):
    """Root of summed squared differences; slope of the distance from the first value; mean of half the squared speed and distance from the mean."""
    w = by_index()
    mean = F.avg("y").over(W.partitionBy(*KEY))
    m = s["v_points"].withColumns({"r": F.col("y") - F.lag("y").over(w), "away": F.abs(F.col("y") - F.first("y").over(w.rowsBetween(W.unboundedPreceding, 0))), "h": (F.col("dy") * F.col("dy") + F.pow(F.col("y") - mean, F.lit(2.0))) / 2})
    return m.groupBy(*KEY).agg(F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("realized_volatility"), div(F.covar_pop("I", "away"), F.var_pop("I")).alias("hd_slope"), F.avg("h").alias("mean_hamiltonian"))


def segments(points: DataFrame, label: str) -> DataFrame:
    """For each signal and label: points, segments (parted by a gap of over 1.5 usual steps), their mean duration, the mean index and the share of points."""
    own = W.partitionBy(*KEY, label).orderBy("I")
    steps = points.withColumn("step", F.col("I") - F.lag("I").over(by_index()))
    m = steps.withColumn("usual", F.median("step").over(W.partitionBy(*KEY))).withColumn("gap", F.col("I") - F.lag("I").over(own))
    m = m.withColumn("segment", F.count_if(F.col("gap") > 1.5 * F.col("usual")).over(own.rowsBetween(W.unboundedPreceding, W.currentRow)))
    parts = m.groupBy(*KEY, label, "segment").agg(F.count(F.lit(1)).alias("n"), F.sum("I").alias("total"), (F.max("I") - F.min("I")).alias("duration"))
    found = parts.groupBy(*KEY, label).agg(F.sum("n").alias("n_points"), F.count(F.lit(1)).alias("n_segments"), F.avg("duration").alias("duration_mean"), (F.sum("total") / F.sum("n")).alias("mean_index"))
    return found.withColumn("pct_time", 100 * div("n_points", F.sum("n_points").over(W.partitionBy(*KEY))))


@view("entity_id signal_id regime_id n_points n_segments ~duration_mean ~mean_index ~pct_time", "e_regime_stats")
def e_regime_stats(s: Signals):
    """Segments of k-means regimes."""
    return segments(s["v_base"].select(*KEY, "I").join(apply(s, "clustering"), ["entity_id", "I"]), "regime_id")


@view("entity_id signal_id regime_state n_points n_segments ~duration_mean ~mean_index ~pct_time", "e_regime_segments")
def e_regime_segments(s: Signals):
    """Segments of the regime states."""
    return segments(s["v_regime_state"].select(*KEY, "I", "regime_state"), "regime_state")


@view("entity_id signal_a signal_b ~js ~wasserstein", "e_reference_divergence")
def e_reference_divergence(s: Signals):
    """Divergence of each signal's changes of distribution from one reference, the entity's first signal by name."""
    first = s["v_base"].groupBy("entity_id").agg(F.min("signal_id").alias("signal_a"))
    return apply(s, "divergence").join(first, ["entity_id", "signal_a"], "left_semi")


@view("entity_id signal_a signal_b n_points ~correlation ~te_proxy_ab ~te_proxy_ba", "e_layer_pairs")
def e_layer_pairs(s: Signals):
    """The four-layer pair measures: correlation by position, and half the absolute correlation with the other's next value."""
    m = s["v_base"].withColumn("pos", F.row_number().over(by_index())).withColumn("next", F.lead("y").over(by_index()))
    both = pairs(m.select(*KEY, F.col("pos").alias("I"), "y", "next"), "y", "next")
    return both.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n_points"), corr("y_a", "y_b").alias("correlation"), (0.5 * F.abs(corr("y_a", "next_b"))).alias("te_proxy_ab"), (0.5 * F.abs(corr("y_b", "next_a"))).alias("te_proxy_ba"))


@view("entity_id signal_id out_degree in_degree", "e_lead_degrees")
def e_lead_degrees(s: Signals):
    """How many signals one leads and follows: a full outer join of both counts."""
    leads = s["v_lead_lag"].where("lead_lag_direction = 'A_leads_B'")
    a = leads.groupBy("entity_id", F.col("signal_a").alias("signal_id")).agg(F.count(F.lit(1)).alias("out_degree"))
    b = leads.groupBy("entity_id", F.col("signal_b").alias("signal_id")).agg(F.count(F.lit(1)).alias("in_degree"))
    return outer(a, b, KEY, ["out_degree", "in_degree"])


@view("entity_id signal_id I ~next_boundary ~distance", "e_next_boundary")
def e_next_boundary(s: Signals):
    """The first regime boundary at or after each point."""
    m = ahead(s["v_base"].select(*KEY, "I"), s["v_regime_boundaries"].select(*KEY, "regime_boundary"), KEY, "next_boundary", right_at="regime_boundary")
    return m.withColumn("distance", F.col("next_boundary") - F.col("I"))
