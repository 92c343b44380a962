"""How each signal behaves, and which costlier kernels it is worth running on it."""

from pyspark.sql import functions as F

from sigloom.functions.columns import corr, div, flag, share
from sigloom.operators.catalog import KEY, Signals, by_index, view

AT = "entity_id signal_id I"
S = "entity_id signal_id"


@view(f"{S} ~frac_positive_dy ~frac_negative_dy ~trend_direction ~trend_strength ~monotonicity")
def trend_detection(s: Signals):
    dy = F.col("dy")
    m = s["v_points"].where("dy is not null").groupBy(*KEY).agg(
        share(dy > 0).alias("frac_positive_dy"), share(dy < 0).alias("frac_negative_dy"), F.avg(F.signum("dy")).alias("trend_direction"), div(F.avg("dy"), F.stddev("dy")).alias("trend_strength")
    )
    return m.withColumn("monotonicity", F.abs(F.col("frac_positive_dy") - 0.5) * 2)


@view(f"{S} n_mean_crossings n_points ~crossing_rate is_mean_reverting")
def mean_reversion(s: Signals):
    side = s["v_base"].join(s["v_stats_global"].select(*KEY, "y_mean"), KEY).withColumn("side", F.signum(F.col("y") - F.col("y_mean")))
    crossed = side.withColumn("crossed", flag(F.col("side") != F.lag("side").over(by_index())))
    m = crossed.groupBy(*KEY).agg(F.count_if("crossed").alias("n_mean_crossings"), F.count(F.lit(1)).alias("n_points"))
    return m.withColumn("crossing_rate", div("n_mean_crossings", "n_points")).withColumn("is_mean_reverting", F.col("crossing_rate") > 0.1)


@view(f"{S} ~mean_q1 ~mean_q4 ~std_q1 ~std_q4 ~mean_drift ~volatility_drift is_stationary")
def stationarity(s: Signals):
    quarters = s["v_base"].withColumn("q", F.ntile(4).over(by_index())).groupBy(*KEY, "q").agg(F.avg("y").alias("m"), F.stddev("y").alias("d"))
    of = lambda c, q: F.max(F.when(F.col("q") == q, F.col(c)))
    m = quarters.groupBy(*KEY).agg(of("m", 1).alias("mean_q1"), of("m", 4).alias("mean_q4"), of("d", 1).alias("std_q1"), of("d", 4).alias("std_q4"), F.stddev("m").alias("between"), F.avg("d").alias("within"))
    drift = {"mean_drift": div(F.abs(F.col("mean_q4") - F.col("mean_q1")), "between"), "volatility_drift": div(F.abs(F.col("std_q4") - F.col("std_q1")), "within")}
    return m.withColumns(drift).withColumn("is_stationary", flag((F.col("mean_drift") < 1) & (F.col("volatility_drift") < 0.5)))


def _next(df, value: str):
    """value and that of the point one index earlier, where there is one: a lag with a test of the step."""
    w = by_index()
    return df.select(*KEY, "I", value).withColumns({"step": F.col("I") - F.lag("I").over(w), "before": F.lag(value).over(w)}).where("step = 1")


@view(f"{S} ~volatility_autocorr has_volatility_clustering")
def volatility_clustering(s: Signals):
    moves = s["v_points"].where("dy is not null").withColumn("move", F.abs("dy"))
    m = _next(moves, "move").groupBy(*KEY).agg(corr("move", "before").alias("volatility_autocorr"))
    return m.withColumn("has_volatility_clustering", flag(F.col("volatility_autocorr") > 0.3))


@view(f"{AT} ~rolling_std ~volatility_zscore volatility_state")
def burst_detection(s: Signals):
    rolled = s["v_base"].withColumn("rolling_std", F.stddev("y").over(by_index().rowsBetween(-25, 0)))
    m = rolled.groupBy(*KEY).agg(F.avg("rolling_std").alias("m"), F.stddev("rolling_std").alias("d"))
    z = rolled.join(m, KEY).withColumn("volatility_zscore", div(F.col("rolling_std") - F.col("m"), "d"))
    return z.withColumn("volatility_state", F.when(F.col("volatility_zscore") > 2, "burst").when(F.col("volatility_zscore") < -1, "calm").otherwise("normal"))


@view(f"{S} ~autocorr_lag1")
def autocorr_lag1(s: Signals):
    return _next(s["v_base"], "y").groupBy(*KEY).agg(corr("y", "before").alias("autocorr_lag1"))


@view(f"{S} ~autocorr_lag1 persistence_class persistence_source")
def persistence(s: Signals):
    kind = F.when(F.col("autocorr_lag1") > 0.5, "trending").when(F.col("autocorr_lag1") < -0.2, "mean_reverting").otherwise("random")
    return s["v_autocorr_lag1"].withColumns({"persistence_class": kind, "persistence_source": F.lit("autocorr_proxy")})


@view(f"{AT} mean_state volatility_state regime_state")
def regime_state(s: Signals):
    both = s["v_rolling_stats"].join(s["v_stats_global"].select(*KEY, "y_mean", "y_std"), KEY)
    high, low = F.col("rolling_mean") > F.col("y_mean") + F.col("y_std"), F.col("rolling_mean") < F.col("y_mean") - F.col("y_std")
    wild, calm = F.col("rolling_std") > F.col("y_std") * 1.5, F.col("rolling_std") < F.col("y_std") * 0.5
    return both.withColumns(
        {
            "mean_state": F.when(high, "elevated").when(low, "depressed").otherwise("normal"),
            "volatility_state": F.when(wild, "high_volatility").when(calm, "low_volatility").otherwise("normal_volatility"),
            "regime_state": F.when(high & wild, "crisis").when(high, "elevated_stable").when(wild, "volatile").when(low, "depressed").otherwise("stable"),
        }
    )


@view(f"{S} ~sensitivity_ratio ~curvature_variability chaos_suspected")
def chaos_proxy(s: Signals):
    m = s["v_curvature"].groupBy(*KEY).agg(F.avg(div(F.abs("d2y"), F.abs("dy"))).alias("sensitivity_ratio"), div(F.stddev("kappa"), F.avg("kappa")).alias("curvature_variability"))
    return m.withColumn("chaos_suspected", flag((F.col("sensitivity_ratio") > 2) & (F.col("curvature_variability") > 1.5)))


@view(
    f"{S} signal_class behavioral_type is_periodic ~estimated_period ~trend_direction ~trend_strength ~monotonicity ~mean_crossing_rate is_stationary ~mean_drift ~volatility_drift "
    "has_volatility_clustering persistence_class persistence_source chaos_suspected ~hurst ~lyapunov"
)
def signal_typology(s: Signals):
    one = s["v_signal_class"]
    for name in ("trend_detection", "mean_reversion", "stationarity", "volatility_clustering", "persistence", "chaos_proxy"):
        one = one.join(s[f"v_{name}"], KEY, "left")
    known = s.primitives.select(*KEY, "hurst", "lyapunov") if s.primitives is not None else None
    one = one.join(known, KEY, "left") if known is not None else one.withColumns({c: F.lit(None).cast("double") for c in ("hurst", "lyapunov")})
    lasting = F.col("persistence_class")
    kind = (
        F.when(F.col("is_periodic"), "periodic").when(F.col("signal_class") == "digital", "discrete").when(F.col("signal_class") == "event", "event").when(F.col("chaos_suspected"), "chaotic")
        .when((lasting == "trending") & (F.col("monotonicity") > 0.6), "trending_strong").when(lasting == "trending", "trending_weak")
        .when((lasting == "mean_reverting") & F.col("is_mean_reverting"), "mean_reverting").when(lasting == "random", "random_walk").when(F.col("is_stationary"), "stationary").otherwise("unclassified")
    )
    return one.withColumns({"behavioral_type": kind, "mean_crossing_rate": F.col("crossing_rate")})


NEEDS = "needs_hurst needs_lyapunov needs_fft needs_garch needs_wavelet needs_rqa needs_sample_entropy"


@view(f"{S} signal_class {NEEDS}")
def work_order(s: Signals):
    """Which kernels to run on each signal: the requests view of the inventory (number 43)."""
    n = s["v_stats_global"].select(*KEY, F.col("n_points").alias("n_all"))
    t = s["v_signal_typology"].join(n, KEY, "left")
    steady = (F.col("signal_class") == "analog") & ~F.col("is_periodic")
    chaos = flag(F.col("chaos_suspected"))
    return t.withColumns(
        {
            "needs_hurst": flag(steady), "needs_lyapunov": chaos, "needs_fft": flag((F.col("signal_class") == "periodic") | F.col("is_periodic")), "needs_garch": flag(F.col("has_volatility_clustering")),
            "needs_wavelet": flag(F.col("signal_class").isin("analog", "periodic") & ~F.col("is_stationary")), "needs_rqa": chaos & (F.col("n_all") > 500), "needs_sample_entropy": flag(steady),
        }
    )


@view(
    f"{S} signal_class behavioral_type is_periodic ~estimated_period ~trend_direction ~trend_strength ~monotonicity ~mean_crossing_rate is_stationary has_volatility_clustering persistence_class "
    f"chaos_suspected ~hurst ~lyapunov {NEEDS}"
)
def typology_complete(s: Signals):
    return s["v_work_order"]
