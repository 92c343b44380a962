"""Physical checks across signals with units: conservation, balances, equations of state and motion.

Global means are one aggregate of one row for each entity, joined back, so that no window takes in a whole table. A
conserved total is over signals whose unit makes them analog.
"""

from pyspark.sql import functions as F

from sigloom.functions.columns import corr, div, flag
from sigloom.operators.catalog import KEY, Signals, by_index, view
from sigloom.sources.intake import ANALOG_UNITS

E = ["entity_id", "I"]
PRESSURE, FLOW, TEMPERATURE, SPEED = ("kPa", "PSI", "bar", "Pa"), ("m³/s", "L/min", "gpm"), ("K", "°C", "°F"), ("m/s", "ft/s")


def _against_mean(df, value: str, mean: str, z: str):
    m = df.groupBy("entity_id").agg(F.avg(value).alias(mean), F.stddev(value).alias("_std"))
    return df.join(m, "entity_id").withColumn(z, div(F.col(value) - F.col(mean), "_std"))


def _of(s: Signals, units: tuple[str, ...], name: str, keep_signal: bool = False):
    more = [F.col("signal_id")] if keep_signal else []
    return s["v_base"].where(F.col("unit").isin(*units)).select(*E, F.col("y").alias(name), *more)


@view("entity_id I ~total_value ~expected_total ~deviation ~deviation_zscore conservation_status")
def conservation_check(s: Signals):
    total = s["v_base"].where(F.col("unit").isin(ANALOG_UNITS)).groupBy(*E).agg(F.sum("y").alias("total_value"))
    m = _against_mean(total, "total_value", "expected_total", "deviation_zscore")
    return m.withColumns({"deviation": F.col("total_value") - F.col("expected_total"), "conservation_status": F.when(F.abs("deviation_zscore") > 3, "conservation_violation").otherwise("conserved")})


@view("entity_id I ~total_inlet ~total_outlet ~net_accumulation balance_status")
def mass_balance(s: Signals):
    """A name with `outlet` is an outlet; one with `in` an inlet; one with `out` an outlet."""
    name = F.col("signal_id")
    kind = F.when(name.contains("outlet"), "outlet").when(name.contains("in"), "inlet").when(name.contains("out"), "outlet")
    flows = s["v_base"].where(F.col("unit").isin("m³/s", "L/min", "gpm", "kg/s", "lb/hr")).withColumn("kind", kind).where("kind is not null")
    m = flows.groupBy(*E).agg(*[F.sum(F.when(F.col("kind") == k, F.col("y")).otherwise(0.0)).alias(f"total_{k}") for k in ("inlet", "outlet")]).withColumn("net_accumulation", F.col("total_inlet") - F.col("total_outlet"))
    return m.withColumn("balance_status", F.when(F.abs("net_accumulation") < 0.01 * F.greatest("total_inlet", F.lit(0.001)), "balanced").otherwise("imbalanced"))


@view("entity_id I ~total_power ~power_variation energy_status")
def energy_balance(s: Signals):
    power = _of(s, PRESSURE, "p").join(_of(s, FLOW, "f"), E).withColumn("power", F.col("p") * F.col("f"))
    m = power.groupBy(*E).agg(F.sum("power").alias("total_power"), F.stddev("power").alias("power_variation"), F.avg("power").alias("mean"))
    return m.withColumn("energy_status", F.when(div("power_variation", "mean") < 0.1, "stable_energy").otherwise("varying_energy"))


@view("entity_id I ~pressure ~temperature ~pv_over_t ~expected_constant ~deviation_zscore thermo_status")
def thermodynamic_consistency(s: Signals):
    m = _of(s, PRESSURE, "pressure").join(_of(s, TEMPERATURE, "temperature"), E).join(_of(s, ("m³", "L", "ft³"), "volume"), E, "left")
    m = m.withColumn("pv_over_t", div(F.col("pressure") * F.coalesce("volume", F.lit(1.0)), "temperature")).where("pv_over_t is not null")
    m = _against_mean(m, "pv_over_t", "expected_constant", "deviation_zscore")
    return m.withColumn("thermo_status", F.when(F.abs("deviation_zscore") > 2, "thermodynamic_anomaly").otherwise("consistent"))


@view("entity_id I ~system_entropy ~entropy_change second_law_status n_violations")
def second_law_check(s: Signals):
    from pyspark.sql import Window as W

    m = s["v_base"].join(s["v_shannon_entropy"].select(*KEY, "normalized_entropy"), KEY).groupBy(*E).agg(F.avg("normalized_entropy").alias("system_entropy"))
    m = m.withColumn("entropy_change", F.col("system_entropy") - F.lag("system_entropy").over(W.partitionBy("entity_id").orderBy("I")))
    bad = flag(F.col("entropy_change") < -0.1)
    n = m.groupBy("entity_id").agg(F.count_if(bad).alias("n_violations"))
    return m.withColumn("second_law_status", F.when(bad, "possible_second_law_violation").otherwise("consistent")).join(n, "entity_id")


@view("entity_id I ~density ~velocity ~drho_dt ~div_mass_flux ~continuity_residual continuity_status")
def continuity_equation(s: Signals):
    m = _of(s, ("kg/m³", "g/cm³"), "density", True).join(_of(s, SPEED, "velocity"), E).withColumn("flux", F.col("density") * F.col("velocity"))
    w = by_index()
    m = m.withColumns({n: (F.lead(c).over(w) - F.lag(c).over(w)) / 2.0 for n, c in (("drho_dt", "density"), ("div_mass_flux", "flux"))}).where("drho_dt is not null and div_mass_flux is not null")
    m = m.withColumn("continuity_residual", F.col("drho_dt") + F.col("div_mass_flux"))
    small = F.abs("continuity_residual") < 0.01 * F.greatest(F.abs("drho_dt"), F.abs("div_mass_flux"), F.lit(0.001))
    return m.withColumn("continuity_status", F.when(small, "satisfied").otherwise("violated"))


@view("entity_id signal_id ~gradient_concentration_corr transport_regime")
def diffusion_check(s: Signals):
    m = s["v_points"].where("dimension = 'space' and dy is not null").groupBy(*KEY).agg(corr(F.abs("dy"), "y").alias("gradient_concentration_corr"))
    c = F.col("gradient_concentration_corr")
    return m.withColumn("transport_regime", F.when(c > 0.5, "diffusion_dominated").when(c < -0.5, "anti_diffusion").otherwise("mixed_transport"))


@view("entity_id I ~pressure ~velocity ~bernoulli_sum ~expected_constant ~deviation_zscore bernoulli_status")
def bernoulli_check(s: Signals):
    m = _of(s, ("kPa", "Pa", "PSI"), "pressure").join(_of(s, SPEED, "velocity"), E).withColumn("bernoulli_sum", F.col("pressure") + 0.5 * F.col("velocity") * F.col("velocity"))
    m = _against_mean(m, "bernoulli_sum", "expected_constant", "deviation_zscore")
    return m.withColumn("bernoulli_status", F.when(F.abs("deviation_zscore") > 2, "bernoulli_violation").otherwise("consistent"))


@view("entity_id signal_id ~avg_temp_gradient ~temp_gradient_variation heat_transfer_regime")
def heat_transfer_check(s: Signals):
    m = s["v_points"].where(F.col("unit").isin(*TEMPERATURE) & (F.col("dimension") == "space") & F.col("dy").isNotNull())
    m = m.groupBy(*KEY).agg(F.avg(F.abs("dy")).alias("avg_temp_gradient"), F.stddev("dy").alias("temp_gradient_variation"))
    v = div("temp_gradient_variation", "avg_temp_gradient")
    return m.withColumn("heat_transfer_regime", F.when(v < 0.2, "steady_conduction").when(v < 0.5, "quasi_steady").otherwise("transient"))


@view("entity_id I ~force ~acceleration ~implied_mass ~avg_mass ~mass_consistency momentum_status")
def momentum_balance(s: Signals):
    """A force against the second difference of every signal at the same index; differences under 1e-9 are rounding."""
    m = _of(s, ("N", "kN", "lbf"), "force").join(s["v_points"].select(*E, F.col("d2y").alias("acceleration")), E).withColumn("implied_mass", div("force", F.when(F.abs("acceleration") > 1e-9, F.col("acceleration")))).where("implied_mass is not null")
    m = _against_mean(m, "implied_mass", "avg_mass", "mass_consistency")
    return m.withColumn("momentum_status", F.when(F.abs("mass_consistency") > 2, "momentum_anomaly").otherwise("consistent"))


@view("check_type n_violations n_checks")
def physics_complete(s: Signals):
    out = None
    for kind, name, bad in (
        ("conservation", "conservation_check", F.col("conservation_status") == "conservation_violation"), ("mass_balance", "mass_balance", F.col("balance_status") == "imbalanced"),
        ("thermodynamic", "thermodynamic_consistency", F.col("thermo_status") == "thermodynamic_anomaly"), ("second_law", "second_law_check", F.col("second_law_status") != "consistent"),
        ("bernoulli", "bernoulli_check", F.col("bernoulli_status") == "bernoulli_violation"),
    ):
        one = s[f"v_{name}"].agg(F.count_if(bad).alias("n_violations"), F.count(F.lit(1)).alias("n_checks")).withColumn("check_type", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out
