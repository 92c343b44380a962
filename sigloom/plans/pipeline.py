"""Whole runs: all exports of the operators with a manifest, and the four layers of kernels."""

from __future__ import annotations

import base64
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.functions.columns import div
from sigloom.operators import Signals
from sigloom.operators.catalog import KEY, VIEWS
from sigloom.operators.engines import KERNELS, apply
from sigloom.operators.joins import PAIR
from sigloom.sources.intake import read

EXPORTS = {
    "signal_class": "v_export_signal_class", "signal_typology": "v_export_signal_typology", "behavioral_geometry": "v_export_behavioral_geometry",
    "dynamical_systems": "v_export_dynamical_systems", "causal_mechanics": "v_export_causal_mechanics", "alerts": "v_alerts", "signal_summary": "v_signal_summary", "system_summary": "v_system_summary",
}
ENGINE_EXPORTS = ("hurst", "lyapunov", "fft", "garch", "sample_entropy", "rqa", "granger", "mst", "lof", "pca", "clustering", "dmd", "dtw", "cointegration", "divergence")


def _write(df: DataFrame, path: str) -> int:
    """Writes and counts in one pass: the count is observed on the way."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    return seen.get["n"]


def export(observations: DataFrame, out: str, primitives: DataFrame | None = None, engines: tuple[str, ...] = ENGINE_EXPORTS) -> dict[str, int]:
    """Every export as Parquet under `out`, and manifest.json with their rows; a failure is raised, not skipped."""
    s = Signals(observations, primitives)
    rows = {name: _write(s.table(view), f"{out}/{name}") for name, view in EXPORTS.items()}
    rows |= {name: _write(apply(s, name), f"{out}/{name}") for name in engines}
    spark = observations.sparkSession
    spark.createDataFrame([(json.dumps({"rows": rows, "columns": {n: [c.lstrip("~") for c in VIEWS[v][1]] for n, v in EXPORTS.items()}}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/manifest")
    return rows


def validate(spark: SparkSession, out: str) -> dict[str, bool]:
    """Whether each export is there with the declared columns and as many rows as the manifest says."""
    said = json.loads(spark.read.text(f"{out}/manifest").first()[0])
    found = {}
    for name, n in said["rows"].items():
        df = spark.read.parquet(f"{out}/{name}")
        found[name] = df.count() == n and set(said["columns"].get(name, df.columns)) <= set(df.columns)
    return found


def primitives(s: Signals) -> DataFrame:
    """One row for each signal with the measures that typology and summaries take over."""
    m = apply(s, "hurst")
    for name in ("lyapunov", "sample_entropy", "permutation_entropy", "garch", "fft"):
        m = m.join(apply(s, name), KEY, "left")
    return m


def four_layers(observations: DataFrame) -> dict[str, DataFrame]:
    """Typology, geometry, dynamics and mechanics by kernels, and a summary."""
    s = Signals(observations)
    typology = s["p_signal_stats"].join(apply(s, "hurst_rs"), KEY).join(apply(s, "sample_entropy"), KEY).join(apply(s, "spectral_slope"), KEY)
    typology = typology.withColumn("signal_class", F.when(F.col("hurst") > 0.6, "trending").when(F.col("hurst") < 0.4, "mean_reverting").otherwise("random"))
    geometry = s["e_layer_pairs"].join(s["e_mutual_info"], PAIR, "left").join(apply(s, "dtw"), PAIR, "left").join(apply(s, "copula"), PAIR, "left")
    dynamics = apply(s, "attractor").join(apply(s, "basin"), KEY)
    te = s["e_transfer_entropy"].select("entity_id", F.col("source").alias("signal_a"), F.col("target").alias("signal_b"), "transfer_entropy")
    there = s["e_layer_pairs"].select(*PAIR, F.col("te_proxy_ab").alias("te_proxy"))
    back = s["e_layer_pairs"].select("entity_id", F.col("signal_b").alias("signal_a"), F.col("signal_a").alias("signal_b"), F.col("te_proxy_ba").alias("te_proxy"))
    mechanics = apply(s, "granger").join(te, PAIR, "left").join(there.unionByName(back), PAIR, "left").join(apply(s, "cointegration"), PAIR, "left")
    mechanics = mechanics.withColumn("is_edge", F.col("is_causal") | (F.coalesce("te_proxy", F.lit(0.0)) > 0.1))
    edges = mechanics.where("is_edge")
    ends = edges.select("entity_id", F.explode(F.array(F.struct(F.col("signal_a").alias("id"), F.lit(1).alias("out")), F.struct(F.col("signal_b").alias("id"), F.lit(0).alias("out")))).alias("e"))
    degree = ends.groupBy("entity_id", F.col("e.id").alias("signal_id")).agg(F.sum("e.out").alias("out_degree"), F.sum(1 - F.col("e.out")).alias("in_degree"))
    role = F.when((F.col("out_degree") > 0) & (F.col("in_degree") == 0), "SOURCE").when((F.col("in_degree") > 0) & (F.col("out_degree") == 0), "SINK").when(F.col("out_degree") > 0, "CONDUIT").otherwise("ISOLATED")
    summary = typology.select(*KEY, "n_points", "mean", "std", "hurst", "signal_class").join(dynamics, KEY, "left").join(degree, KEY, "left")
    summary = summary.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("out_degree", "in_degree")}).withColumn("role", role)
    return {"typology": typology, "geometry": geometry, "dynamics": dynamics, "transitions": apply(s, "regime_detection"), "mechanics": mechanics, "manifold": apply(s, "pca_coordinates"), "summary": summary}


# ---------------------------------------------------------------- work orders


def encode_order(needs: dict[str, list[str]]) -> str:
    """Signal -> kernels, as base64 JSON."""
    return base64.b64encode(json.dumps({"signals": {k: {f"needs_{n}": True for n in v} for k, v in needs.items()}}).encode()).decode()


def decode_order(text: str) -> dict[str, list[str]]:
    signals = json.loads(base64.b64decode(text))["signals"]
    return {k: [n.removeprefix("needs_") for n, on in v.items() if on] for k, v in signals.items()}


def run_order(observations: DataFrame, order: dict[str, list[str]] | None) -> dict[str, DataFrame]:
    """The kernels of an order on its signals; without one, hurst and sample entropy on all."""
    if order is None:
        return {n: apply(Signals(observations), n) for n in ("hurst", "sample_entropy")}
    wanted = {n: sorted(s for s, names in order.items() if n in names) for n in sorted({n for v in order.values() for n in v})}
    if unknown := set(wanted) - set(KERNELS):
        raise ValueError(f"no such kernels: {sorted(unknown)}")
    return {n: apply(Signals(observations.where(F.col("signal_id").isin(signals))), n) for n, signals in wanted.items()}


def run(spark: SparkSession, path: str, out: str) -> dict[str, int]:
    return export(read(spark, path), out)


def violation_share(s: Signals) -> DataFrame:
    return s["v_physics_complete"].withColumn("share", div("n_violations", "n_checks"))
