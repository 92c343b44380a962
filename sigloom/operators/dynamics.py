"""Regimes and their changes, stability, basins, attractors and bifurcations."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sigloom.functions.columns import div, flag
from sigloom.operators.catalog import KEY, Signals, by_index, view
from sigloom.operators.joins import range_join

AT = "entity_id signal_id I"
S = "entity_id signal_id"


def _changes(s: Signals):
    """All points with the jump from the last point that has a curvature; those without one have no jump and no change."""
    if "changes" not in s.made:
        before, valid = by_index().rowsBetween(W.unboundedPreceding, -1), F.col("kappa").isNotNull()
        m = s["v_points"].withColumns({f"{c}_prev": F.last(F.when(valid, F.col(c)), ignorenulls=True).over(before) for c in ("dy", "d2y")})
        m = m.join(s["v_derivative_stats"].select(*KEY, "dy_median_abs", "d2y_median_abs"), KEY, "left")
        m = m.withColumns({f"{c}_jump": F.when(valid, F.abs(F.col(c) - F.col(f"{c}_prev"))) for c in ("dy", "d2y")})
        jumps = (F.col("dy_jump") > 3 * F.col("dy_median_abs")) | (F.col("d2y_jump") > 3 * F.col("d2y_median_abs"))
        s.made["changes"] = m.withColumns({"change_score": div("dy_jump", "dy_median_abs") + div("d2y_jump", "d2y_median_abs"), "is_regime_change": flag(jumps)})
    return s.made["changes"]


@view(f"{AT} ~dy ~d2y ~dy_prev ~d2y_prev ~dy_jump ~d2y_jump ~change_score is_regime_change")
def regime_changes(s: Signals):
    return _changes(s).where("kappa is not null")


@view(f"{S} ~regime_boundary ~change_score regime_number")
def regime_boundaries(s: Signals):
    m = s["v_regime_changes"].where("is_regime_change").withColumn("regime_number", F.row_number().over(by_index()).cast("long"))
    return m.withColumnRenamed("I", "regime_boundary")


@view(f"{AT} regime_id")
def regime_assignment(s: Signals):
    """Changes up to each point: a running count over the series, in place of a look-up of the last boundary, and without a join."""
    return _changes(s).withColumn("regime_id", F.count_if("is_regime_change").over(by_index().rowsBetween(W.unboundedPreceding, 0)))


@view(f"{S} regime_id regime_length ~regime_start ~regime_end ~regime_mean ~regime_std ~regime_min ~regime_max ~regime_avg_velocity ~regime_avg_curvature")
def regime_stats(s: Signals):
    return s["v_regime_assignment"].groupBy(*KEY, "regime_id").agg(
        F.count(F.lit(1)).alias("regime_length"), F.min("I").alias("regime_start"), F.max("I").alias("regime_end"), F.avg("y").alias("regime_mean"), F.stddev("y").alias("regime_std"),
        F.min("y").alias("regime_min"), F.max("y").alias("regime_max"), F.avg("dy").alias("regime_avg_velocity"), F.avg("kappa").alias("regime_avg_curvature"),
    )


@view(f"{S} from_regime to_regime ~transition_point ~regime_mean ~mean_jump ~volatility_ratio transition_type")
def regime_transitions(s: Signals):
    w = W.partitionBy(*KEY).orderBy("regime_start")
    m = s["v_regime_stats"].withColumns({f"next_{c}": F.lead(f"regime_{c}").over(w) for c in ("id", "mean", "std")})
    mean, std = F.col("regime_mean"), F.col("regime_std")
    kind = (
        F.when(F.col("next_std") > std * 1.5, "volatility_increase").when(F.col("next_std") < std * 0.67, "volatility_decrease")
        .when(F.col("next_mean") > mean + std, "upward_shift").when(F.col("next_mean") < mean - std, "downward_shift").otherwise("lateral")
    )
    return m.withColumns({"from_regime": F.col("regime_id"), "to_regime": F.col("next_id"), "transition_point": F.col("regime_end"), "mean_jump": F.col("next_mean") - mean, "volatility_ratio": div("next_std", "regime_std"), "transition_type": kind})


@view(f"{S} from_regime to_regime n_transitions ~probability")
def transition_matrix(s: Signals):
    """How often a point in one regime state is followed by one in another."""
    m = s["v_regime_state"].withColumn("to_regime", F.lead("regime_state").over(by_index())).where("to_regime is not null").groupBy(*KEY, F.col("regime_state").alias("from_regime"), "to_regime").agg(F.count(F.lit(1)).alias("n_transitions"))
    return m.withColumn("probability", div("n_transitions", F.sum("n_transitions").over(W.partitionBy(*KEY, "from_regime"))))


@view(f"{AT} ~dy ~d2y ~local_expansion_rate stability_state is_locally_stable")
def stability(s: Signals):
    up, down, bends_up, bends_down = F.col("dy") > 0, F.col("dy") < 0, F.col("d2y") > 0, F.col("d2y") < 0
    kind = F.when(up & bends_down, "converging_up").when(down & bends_up, "converging_down").when(up & bends_up, "diverging_up").when(down & bends_down, "diverging_down").otherwise("neutral")
    return s["v_curvature"].withColumns({"local_expansion_rate": F.abs("dy"), "stability_state": kind, "is_locally_stable": (up & bends_down) | (down & bends_up)})


@view(f"{S} ~basin_center ~basin_depth ~I ~y ~distance_to_center")
def basins(s: Signals):
    valleys = s["v_local_extrema"].where("extrema_type = 'valley'").select(*KEY, F.col("I").alias("basin_center"), F.col("y").alias("basin_depth"))
    near = range_join(valleys, s["v_base"].select(*KEY, "I", "y"), KEY, "distance", -50.0, 50.0, left_at="basin_center")
    return near.withColumn("distance_to_center", F.abs("distance"))


@view(f"{S} ~attractor_value ~bin_center visit_count ~visit_frequency rank_by_visits")
def attractors_all(s: Signals):
    m = s["v_base"].groupBy(*KEY, (F.floor(F.col("y") * 10 + 0.5) / 10).alias("attractor_value")).agg(F.avg("y").alias("bin_center"), F.count(F.lit(1)).alias("visit_count"))
    rank = F.row_number().over(W.partitionBy(*KEY).orderBy(F.desc("visit_count"), "attractor_value")).cast("long")
    return m.withColumns({"visit_frequency": div("visit_count", F.sum("visit_count").over(W.partitionBy(*KEY))), "rank_by_visits": rank})


@view(f"{S} ~attractor_value ~bin_center visit_count ~visit_frequency attractor_type")
def attractors(s: Signals):
    kind = F.when(F.col("rank_by_visits") == 1, "primary").when(F.col("rank_by_visits") <= 3, "secondary").otherwise("minor")
    return s["v_attractors_all"].where("visit_frequency > 0.05").withColumn("attractor_type", kind)


@view(f"{AT} ~phase_velocity ~tangent_magnitude")
def phase_velocity(s: Signals):
    dy, d2y = F.col("dy"), F.col("d2y")
    return s["v_curvature"].withColumns({"phase_velocity": F.sqrt(1 + dy * dy), "tangent_magnitude": F.sqrt(dy * dy + d2y * d2y)})


@view(f"{S} ~bifurcation_point ~kappa ~kappa_prev ~kappa_jump bifurcation_type")
def bifurcation_base(s: Signals):
    m = s["v_curvature"].withColumn("kappa_prev", F.lag("kappa").over(by_index()))
    kind = F.when(F.col("kappa") > F.col("kappa_prev") * 2, "complexity_increase").when(F.col("kappa") < F.col("kappa_prev") * 0.5, "complexity_decrease")
    return m.withColumns({"bifurcation_point": F.col("I"), "kappa_jump": F.abs(F.col("kappa") - F.col("kappa_prev")), "bifurcation_type": kind})


@view(f"{S} ~kappa_p95")
def kappa_thresholds(s: Signals):
    return s["v_curvature"].groupBy(*KEY).agg(F.percentile(F.abs("kappa"), 0.95).alias("kappa_p95"))


@view(f"{S} ~bifurcation_point ~kappa ~kappa_prev ~kappa_jump bifurcation_type")
def bifurcation_candidates(s: Signals):
    return s["v_bifurcation_base"].join(s["v_kappa_thresholds"], KEY).where("kappa_jump > kappa_p95")


@view(f"{AT} regime_id ~regime_mean ~regime_std regime_length stability_state is_locally_stable ~phase_velocity")
def dynamics_complete(s: Signals):
    """The point columns are projections of the regime table's own rows; only the regimes' statistics are joined."""
    m = s["v_regime_assignment"].join(s["v_regime_stats"].select(*KEY, "regime_id", "regime_mean", "regime_std", "regime_length"), [*KEY, "regime_id"], "left")
    up, down, bends_up, bends_down = F.col("dy") > 0, F.col("dy") < 0, F.col("d2y") > 0, F.col("d2y") < 0
    kind = F.when(up & bends_down, "converging_up").when(down & bends_up, "converging_down").when(up & bends_up, "diverging_up").when(down & bends_down, "diverging_down").otherwise("neutral")
    known = F.col("kappa").isNotNull()
    return m.withColumns({"stability_state": F.when(known, kind), "is_locally_stable": F.when(known, (up & bends_down) | (down & bends_up)), "phase_velocity": F.when(known, F.sqrt(1 + F.col("dy") * F.col("dy")))})


@view("entity_id ~system_regime_boundary n_signals_changing change_magnitude")
def system_regime(s: Signals):
    n = s["v_base"].groupBy("entity_id").agg(F.count_distinct("signal_id").alias("n_signals"))
    m = s["v_regime_changes"].where("is_regime_change").groupBy("entity_id", "I").agg(F.count_distinct("signal_id").alias("n_signals_changing")).where("n_signals_changing > 1").join(n, "entity_id")
    kind = F.when(F.col("n_signals_changing") > F.col("n_signals") * 0.5, "major_system_change").when(F.col("n_signals_changing") > 2, "moderate_system_change").otherwise("isolated_change")
    return m.withColumns({"system_regime_boundary": F.col("I"), "change_magnitude": kind})
