"""Summaries of each signal, and points held against them."""

from pyspark.sql import functions as F

from sigloom.functions.columns import corr, div, flag
from sigloom.operators.catalog import KEY, Signals, by_index, view

AT = "entity_id signal_id I"
S = "entity_id signal_id"


@view(f"{S} n_points ~y_min ~y_max ~y_range ~y_mean ~y_std ~y_var ~y_q1 ~y_median ~y_q3 ~y_iqr")
def stats_global(s: Signals):
    q = F.percentile("y", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    one = s["v_base"].groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_points"), F.min("y").alias("y_min"), F.max("y").alias("y_max"), F.avg("y").alias("y_mean"), F.stddev("y").alias("y_std"), F.variance("y").alias("y_var"), q.alias("q")
    )
    return one.withColumns({"y_range": F.col("y_max") - F.col("y_min"), "y_q1": F.col("q")[0], "y_median": F.col("q")[1], "y_q3": F.col("q")[2], "y_iqr": F.col("q")[2] - F.col("q")[0]})


@view(f"{S} ~dy_mean_abs ~dy_std ~dy_median_abs ~dy_p95_abs ~d2y_mean_abs ~d2y_std ~d2y_median_abs ~d2y_p95_abs")
def derivative_stats(s: Signals):
    parts = [x for c in ("dy", "d2y") for x in (F.avg(F.abs(c)).alias(f"{c}_mean_abs"), F.stddev(c).alias(f"{c}_std"), F.percentile(F.abs(c), F.array(F.lit(0.5), F.lit(0.95))).alias(f"{c}_q"))]
    two = s["v_curvature"].groupBy(*KEY).agg(*parts)
    return two.withColumns({f"{c}_{k}_abs": F.col(f"{c}_q")[i] for c in ("dy", "d2y") for i, k in enumerate(("median", "p95"))})


@view(f"{AT} ~y ~z_score z_category")
def zscore(s: Signals):
    z = s["v_base"].join(s["v_stats_global"].select(*KEY, "y_mean", "y_std"), KEY).withColumn("z_score", div(F.col("y") - F.col("y_mean"), "y_std"))
    return z.withColumn("z_category", F.when(F.abs("z_score") > 3, "extreme").when(F.abs("z_score") > 2, "outlier").otherwise("normal"))


@view(f"{AT} ~dy ~d2y ~dy_median_abs ~d2y_median_abs dy_anomaly d2y_anomaly ~anomaly_score")
def derivative_anomaly(s: Signals):
    both = s["v_curvature"].join(s["v_derivative_stats"].select(*KEY, "dy_median_abs", "d2y_median_abs"), KEY)
    over = {f"{c}_anomaly": flag(F.abs(c) > 3 * F.col(f"{c}_median_abs")) for c in ("dy", "d2y")}
    return both.withColumns({**over, "anomaly_score": div(F.abs("dy"), "dy_median_abs") + div(F.abs("d2y"), "d2y_median_abs")})


@view(f"{AT} ~y ~dy ~dy_prev extrema_type")
def local_extrema(s: Signals):
    turns = s["v_points"].where("dy is not null").withColumn("dy_prev", F.lag("dy").over(by_index()))
    kind = F.when((F.col("dy") > 0) & (F.col("dy_prev") < 0), "valley").when((F.col("dy") < 0) & (F.col("dy_prev") > 0), "peak")
    return turns.withColumn("extrema_type", kind)


@view(f"{AT} ~y ~dy trend_direction ~trend_acceleration")
def trend(s: Signals):
    way = F.when(F.col("dy") > 0.001, "up").when(F.col("dy") < -0.001, "down").otherwise("flat")
    return s["v_points"].withColumns({"trend_direction": way, "trend_acceleration": div(F.abs("d2y"), F.abs("dy"))})


@view(f"{AT} ~y ~d2y ~kappa ~instantaneous_volatility ~curvature_volatility ~relative_volatility")
def volatility_proxy(s: Signals):
    both = s["v_curvature"].join(s["v_derivative_stats"].select(*KEY, "d2y_median_abs"), KEY)
    return both.withColumns({"instantaneous_volatility": F.abs("d2y"), "curvature_volatility": F.col("kappa"), "relative_volatility": div(F.abs("d2y"), "d2y_median_abs")})


@view(f"{S} ~acf_lag1 ~acf_lag5 ~acf_lag10")
def autocorrelation(s: Signals):
    w = by_index()
    lagged = s["v_base"].withColumns({f"lag{k}": F.lag("y", k).over(w) for k in (1, 5, 10)})
    return lagged.where("lag10 is not null").groupBy(*KEY).agg(*[corr("y", f"lag{k}").alias(f"acf_lag{k}") for k in (1, 5, 10)])


@view(f"{S} n_points ~y_mean ~y_std ~y_median ~y_iqr ~dy_median_abs ~d2y_median_abs ~acf_lag1 ~acf_lag5 ~acf_lag10")
def statistics_complete(s: Signals):
    return s["v_stats_global"].join(s["v_derivative_stats"], KEY, "left").join(s["v_autocorrelation"], KEY, "left")


@view(f"{AT} ~rolling_mean ~rolling_std ~rolling_min ~rolling_max")
def rolling_stats(s: Signals):
    """Over the last 51 points."""
    w = by_index().rowsBetween(-50, 0)
    return s["v_base"].withColumns({f"rolling_{k}": f("y").over(w) for k, f in (("mean", F.avg), ("std", F.stddev), ("min", F.min), ("max", F.max))})


@view(f"{S} ~y_skewness ~y_kurtosis")
def skewness_kurtosis(s: Signals):
    from sigloom.functions.columns import kurtosis, skewness

    return s["v_base"].groupBy(*KEY).agg(skewness("y").alias("y_skewness"), kurtosis("y").alias("y_kurtosis"))


@view(f"{S} n_runs n_above n_below ~runs_z")
def runs_test(s: Signals):
    """Runs above and below the median against their number in random order (Wald and Wolfowitz)."""
    side = s["v_base"].join(s["v_stats_global"].select(*KEY, "y_median"), KEY).where("y <> y_median").withColumn("above", F.col("y") > F.col("y_median"))
    new = side.withColumn("new", F.coalesce((F.col("above") != F.lag("above").over(by_index())).cast("int"), F.lit(1)))
    n = new.groupBy(*KEY).agg(F.sum("new").alias("n_runs"), F.count_if("above").alias("n_above"), F.count_if(~F.col("above")).alias("n_below"))
    a, b = F.col("n_above").cast("double"), F.col("n_below").cast("double")
    mean = 2 * a * b / (a + b) + 1
    return n.withColumn("runs_z", div(F.col("n_runs") - mean, F.sqrt(div((mean - 1) * (mean - 2), a + b - 1))))
