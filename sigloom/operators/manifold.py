"""The assembly: phase space, trajectories, summaries, alerts and exports."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sigloom.functions.columns import div
from sigloom.operators.catalog import KEY, Signals, by_index, view
from sigloom.operators.joins import PAIR

AT = "entity_id signal_id I"
S = "entity_id signal_id"


@view(f"{AT} ~y ~phase_x ~phase_y ~phase_z coord_source")
def phase_space(s: Signals):
    known = F.col("kappa").isNotNull()
    zero = F.lit(0.0)
    return s["v_points"].withColumns({"phase_x": F.when(known, F.col("y")), "phase_y": F.when(known, F.col("dy") * 10).otherwise(zero), "phase_z": F.when(known, F.col("kappa") * 100).otherwise(zero), "coord_source": F.lit("local")})


TRAJECTORY = f"{AT} ~phase_x ~phase_y ~phase_z signal_class behavioral_type regime_id ~regime_mean ~regime_std ~phase_velocity"


@view(TRAJECTORY)
def trajectory_base(s: Signals):
    """Steps are taken on the phase space; class, type and regime are joined to it."""
    w = by_index()
    known = F.col("kappa").isNotNull()
    zero = F.lit(0.0)
    phase = {"phase_x": F.when(known, F.col("y")), "phase_y": F.when(known, F.col("dy") * 10).otherwise(zero), "phase_z": F.when(known, F.col("kappa") * 100).otherwise(zero)}
    step = lambda c: F.coalesce(F.pow(F.col(c) - F.lag(c).over(w), F.lit(2.0)), zero)
    m = s["v_regime_assignment"].withColumns(phase).withColumn("phase_velocity", F.sqrt(step("phase_x") + step("phase_y") + step("phase_z")))
    m = m.join(s["v_signal_typology"].select(*KEY, "signal_class", "behavioral_type"), KEY, "left")
    return m.join(s["v_regime_stats"].select(*KEY, "regime_id", "regime_mean", "regime_std"), [*KEY, "regime_id"], "left")


@view(f"{TRAJECTORY} ~arc_length")
def trajectory(s: Signals):
    return s["v_trajectory_base"].withColumn("arc_length", F.sum("phase_velocity").over(by_index().rowsBetween(W.unboundedPreceding, 0)))


@view(
    f"{S} signal_class unit interpolation_valid is_periodic ~estimated_period behavioral_type persistence_class chaos_suspected n_points ~y_mean ~y_std ~y_min ~y_max causal_role n_drives n_driven_by "
    "~shannon_entropy ~normalized_entropy ~permutation_entropy n_regimes"
)
def signal_summary(s: Signals):
    regimes = s["v_regime_assignment"].groupBy(*KEY).agg(F.count_distinct("regime_id").alias("n_regimes"))
    roles = s["v_causal_roles"].select(*KEY, "causal_role", F.col("out_degree").alias("n_drives"), F.col("in_degree").alias("n_driven_by"))
    m = s["v_signal_class"].join(s["v_signal_typology"].select(*KEY, "behavioral_type", "persistence_class", "chaos_suspected"), KEY, "left")
    for other in (s["v_stats_global"], roles, s["v_entropy_complete"].select(*KEY, "shannon_entropy", "normalized_entropy", "permutation_entropy"), regimes):
        m = m.join(other, KEY, "left")
    return m


@view(f"{S} regime_id ~regime_start ~regime_end regime_length ~regime_mean ~regime_std ~regime_min ~regime_max ~regime_avg_velocity ~regime_avg_curvature transition_type ~mean_jump ~volatility_ratio")
def regime_summary(s: Signals):
    """Transitions are the regime rows themselves with what follows them."""
    return s["v_regime_transitions"]


@view(
    "entity_id source target ~instant_correlation optimal_lag ~optimal_correlation coupling_strength lead_lag_direction ~velocity_correlation ~partial_correlation_proxy ~mutual_information_proxy "
    "~combined_causal_strength ~granger_score relationship_strength"
)
def coupling_summary(s: Signals):
    cause = s["v_causal_strength"].select("entity_id", F.col("source").alias("signal_a"), F.col("target").alias("signal_b"), "combined_causal_strength", "granger_score")
    m = s["v_geometry_complete"].join(cause, PAIR, "left").withColumnsRenamed({"signal_a": "source", "signal_b": "target"})
    causal, coupled = F.col("combined_causal_strength"), F.col("optimal_correlation")
    return m.withColumn("relationship_strength", F.when(causal > 0.5, "strong_causal").when(coupled > 0.7, "strong_coupling").when(causal > 0.2, "moderate_causal").when(coupled > 0.3, "moderate_coupling").otherwise("weak"))


@view(
    "n_signals n_total_points ~I_min ~I_max n_analog n_digital n_periodic n_event n_trending n_mean_reverting n_chaotic n_sources n_sinks n_conduits total_regimes ~avg_system_entropy ~physics_violation_rate"
)
def system_summary(s: Signals):
    """One row each from a handful of aggregates."""
    ones = [
        s["v_base"].agg(F.count_distinct("signal_id").alias("n_signals"), F.count(F.lit(1)).alias("n_total_points"), F.min("I").alias("I_min"), F.max("I").alias("I_max")),
        s["v_signal_typology"].agg(
            *[F.count_if(F.col("signal_class") == c).alias(f"n_{c}") for c in ("analog", "digital", "periodic", "event")],
            F.count_if(F.col("behavioral_type").startswith("trending")).alias("n_trending"), *[F.count_if(F.col("behavioral_type") == c).alias(f"n_{c}") for c in ("mean_reverting", "chaotic")],
        ),
        s["v_causal_roles"].agg(*[F.count_if(F.col("causal_role") == r.upper()).alias(f"n_{r}s") for r in ("source", "sink", "conduit")]),
        s["v_regime_assignment"].agg(F.count_distinct("regime_id").alias("total_regimes")),
        s["v_shannon_entropy"].agg(F.avg("shannon_entropy").alias("avg_system_entropy")),
        s["v_physics_complete"].agg(div(F.sum("n_violations"), F.sum("n_checks")).alias("physics_violation_rate")),
    ]
    m = ones[0]
    for other in ones[1:]:
        m = m.crossJoin(other)
    return m


@view("entity_id alert_type signal_id ~alert_at description ~severity")
def alerts(s: Signals):
    none = F.lit(None)
    row = lambda df, kind, at, what, how, signal=F.col("signal_id"): df.select(
        "entity_id", F.lit(kind).alias("alert_type"), signal.cast("string").alias("signal_id"), at.cast("double").alias("alert_at"), what.alias("description"), how.cast("double").alias("severity")
    )
    parts = [
        row(s["v_regime_changes"].where("is_regime_change"), "regime_change", F.col("I"), F.lit("Regime change detected"), F.col("change_score")),
        row(s["v_chaos_proxy"].where("chaos_suspected"), "chaos_suspected", none, F.lit("Chaotic behavior suspected"), F.col("sensitivity_ratio")),
        row(s["v_bifurcation_candidates"].where("bifurcation_type is not null"), "bifurcation", F.col("bifurcation_point"), F.concat(F.lit("Possible bifurcation: "), "bifurcation_type"), F.col("kappa_jump")),
        row(s["v_conservation_check"].where("conservation_status = 'conservation_violation'"), "physics_violation", F.col("I"), F.lit("Conservation violation detected"), F.abs("deviation_zscore"), none),
        row(s["v_zscore"].where("z_category = 'extreme'"), "extreme_outlier", F.col("I"), F.lit("Extreme value detected (z > 3)"), F.abs("z_score")),
    ]
    m = parts[0]
    for other in parts[1:]:
        m = m.unionByName(other)
    return m


@view(f"{S} signal_class class_source unit dimension interpolation_valid is_periodic ~estimated_period max_derivative_order ~unique_ratio ~sparsity ~kappa_consistency")
def export_signal_class(s: Signals):
    return s["v_classification_complete"]


@view(f"{AT} ~y signal_class behavioral_type persistence_class is_periodic is_stationary has_volatility_clustering chaos_suspected ~hurst ~lyapunov")
def export_signal_typology(s: Signals):
    return s["v_base"].join(s["v_signal_typology"], KEY)


@view("entity_id source target ~instant_correlation optimal_lag ~optimal_correlation coupling_strength lead_lag_direction ~velocity_correlation ~mutual_information ~combined_causal_strength")
def export_behavioral_geometry(s: Signals):
    return s["v_coupling_summary"].withColumnRenamed("mutual_information_proxy", "mutual_information")


@view(f"{AT} regime_id ~regime_mean ~regime_std stability_state is_locally_stable ~phase_velocity")
def export_dynamical_systems(s: Signals):
    return s["v_dynamics_complete"]


@view(f"{S} causal_role n_drives n_driven_by net_influence ~total_causal_flow drives driven_by")
def export_causal_mechanics(s: Signals):
    return s["v_causality_complete"].withColumnsRenamed({"out_degree": "n_drives", "in_degree": "n_driven_by"})


@view("signals_json")
def export_signals_json(s: Signals):
    """One JSON array of the signals, in order of their ids: as long as there are signals, which is what is asked for."""
    one = F.struct("entity_id", F.col("signal_id").alias("id"), F.col("signal_class").alias("class"), F.col("behavioral_type").alias("type"), F.col("causal_role").alias("role"), "n_points")
    return s["v_signal_summary"].agg(F.to_json(F.sort_array(F.collect_list(one)), {"ignoreNullFields": "false"}).alias("signals_json"))


@view("entity_id alert_type signal_id ~alert_at description ~severity")
def export_alerts_json(s: Signals):
    """The hundred most severe; equal ones by name and place."""
    order = [F.round("severity", 6).desc_nulls_last(), F.asc_nulls_last("entity_id"), "alert_type", F.asc_nulls_last("signal_id"), F.asc_nulls_last("alert_at")]
    return s["v_alerts"].orderBy(*order).limit(100)


@view("manifold_json")
def manifold_json(s: Signals):
    return s["v_system_summary"].select(F.to_json(F.struct("n_signals", "n_total_points", "n_analog", "n_digital", "n_periodic", "n_event", "total_regimes")).alias("manifold_json"))
