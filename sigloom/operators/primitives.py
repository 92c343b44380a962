"""The fast primitives: one pass each over a signal or over pairs of signals."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sigloom.functions.columns import corr, div, flag, kurtosis, skewness
from sigloom.operators.catalog import KEY, Signals, by_index, view
from sigloom.operators.joins import PAIR, pairs

S = "entity_id signal_id"
AT = "entity_id signal_id I"
P = "entity_id signal_a signal_b"


@view(f"{S} n_points ~mean ~std ~min ~max ~median ~q25 ~q75 ~skewness ~kurtosis ~unique_ratio ~variance", "p_signal_stats")
def signal_stats(s: Signals):
    q = F.percentile("y", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    m = s["v_base"].groupBy(*KEY).agg(
        F.count("y").alias("n_points"), F.avg("y").alias("mean"), F.stddev_pop("y").alias("std"), F.min("y").alias("min"), F.max("y").alias("max"), q.alias("q"),
        skewness("y").alias("skewness"), kurtosis("y").alias("kurtosis"), div(F.count_distinct("y"), F.count("y")).alias("unique_ratio"), F.var_pop("y").alias("variance"),
    )
    return m.withColumns({"q25": F.col("q")[0], "median": F.col("q")[1], "q75": F.col("q")[2]})


@view(f"{S} signal_type ~variance ~unique_ratio", "p_typology")
def typology(s: Signals):
    u = F.col("unique_ratio")
    return s["p_signal_stats"].withColumn("signal_type", F.when(F.col("variance") < 1e-10, "constant").when(u < 0.01, "digital").when(u < 0.05, "discrete").otherwise("analog"))


@view(f"{P} ~correlation ~covariance n_points", "p_pairwise")
def pairwise(s: Signals):
    m = pairs(s["v_base"], "y").groupBy(*PAIR).agg(corr("y_a", "y_b").alias("correlation"), F.covar_pop("y_a", "y_b").alias("covariance"), F.count(F.lit(1)).alias("n_points"))
    return m.where("n_points >= 10")


@view(f"{P} ~correlation", "p_correlation_matrix")
def correlation_matrix(s: Signals):
    return s["p_pairwise"]


@view(f"{P} ~corr_a_leads ~corr_b_leads n_points", "p_lag_correlation")
def lag_correlation(s: Signals):
    """a with b's last value (b leads), and a's last value with b (a leads)."""
    m = s["v_base"].select(*KEY, "I", "y").withColumn("past", F.lag("y").over(by_index())).where("past is not null")
    both = pairs(m, "y", "past").groupBy(*PAIR).agg(corr("past_a", "y_b").alias("corr_a_leads"), corr("y_a", "past_b").alias("corr_b_leads"), F.count(F.lit(1)).alias("n_points"))
    return both.where("n_points >= 10")


@view(f"{AT} ~y ~dy ~d2y ~central ~curvature sign_change", "p_pointwise")
def pointwise(s: Signals):
    """Backward differences; nought where there is none."""
    w = by_index()
    zero = F.lit(0.0)
    m = s["v_base"].withColumn("dy", F.coalesce(F.col("y") - F.lag("y").over(w), zero))
    m = m.withColumns({"d2y": F.coalesce(F.col("dy") - F.lag("dy").over(w), zero), "central": F.coalesce((F.lead("y").over(w) - F.lag("y").over(w)) / 2.0, zero)})
    return m.withColumns({"curvature": F.abs("d2y") / F.pow(1 + F.col("dy") * F.col("dy"), F.lit(1.5)), "sign_change": flag(F.signum("dy") != F.signum(F.lag("dy").over(w)))})


@view(f"{S} ~dy_mean ~dy_std ~dy_max ~d2y_mean ~d2y_std ~d2y_max n_sign_changes", "p_derivative_stats")
def derivative_stats(s: Signals):
    parts = [x for c in ("dy", "d2y") for x in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"), F.max(F.abs(c)).alias(f"{c}_max"))]
    return s["p_pointwise"].groupBy(*KEY).agg(*parts, F.count_if("sign_change").alias("n_sign_changes"))


@view(f"{AT} ~y ~dy ~d2y", "p_derivatives")
def derivatives(s: Signals):
    w = by_index()
    return s["v_base"].withColumn("dy", F.col("y") - F.lag("y").over(w)).withColumn("d2y", F.col("dy") - F.lag("dy").over(w))


@view(
    f"{S} n_points ~mean ~std ~skewness ~kurtosis ~unique_ratio ~cv_step ~frac_up ~frac_down n_zero_crossings ~sparsity ~energy ~drift index_continuity amplitude_continuity monotonicity sparsity_class "
    "boundedness energy_class has_dc has_trend",
    "p_typology_complete",
)
def typology_complete(s: Signals):
    """One window, one wide aggregate, and labels from it.

    Monotone at 95 % of moves one way; sparse where over half of the values are within a thousandth of the range of the
    median; bounded where the range is under ten deviations; steady power where the mean is more than a deviation from 0.
    """
    w = by_index()
    m = s["v_base"].withColumns({"step": F.col("I") - F.lag("I").over(w), "move": F.col("y") - F.lag("y").over(w), "centre": F.median("y").over(W.partitionBy(*KEY)), "flip": flag(F.signum("y") != F.signum(F.lag("y").over(w)))})
    g = m.groupBy(*KEY).agg(
        F.count("y").alias("n_points"), F.avg("y").alias("mean"), F.stddev_pop("y").alias("std"), skewness("y").alias("skewness"), kurtosis("y").alias("kurtosis"),
        div(F.count_distinct("y"), F.count("y")).alias("unique_ratio"), div(F.stddev_pop("step"), F.avg("step")).alias("cv_step"), div(F.count_if(F.col("move") > 0), F.count("move")).alias("frac_up"),
        div(F.count_if(F.col("move") < 0), F.count("move")).alias("frac_down"), F.count_if("flip").alias("n_zero_crossings"), (F.max("y") - F.min("y")).alias("range"), F.avg(F.col("y") * F.col("y")).alias("energy"),
        corr("I", "y").alias("drift"), F.sum(F.abs(F.col("y") - F.col("centre"))).alias("away"),
    )
    near = m.join(g.select(*KEY, "range"), KEY).groupBy(*KEY).agg(div(F.count_if(F.abs(F.col("y") - F.col("centre")) <= 0.001 * F.col("range")), F.count("y")).alias("sparsity"))
    g = g.join(near, KEY)
    u = F.col("unique_ratio")
    return g.withColumns(
        {
            "index_continuity": F.when(F.col("cv_step") < 0.01, "regular").when(F.col("cv_step") < 0.5, "irregular").otherwise("sparse"),
            "amplitude_continuity": F.when(u < 0.05, "discrete").when(u < 0.5, "mixed").otherwise("continuous"),
            "monotonicity": F.when(F.col("frac_up") >= 0.95, "increasing").when(F.col("frac_down") >= 0.95, "decreasing").otherwise("non_monotonic"),
            "sparsity_class": F.when(F.col("sparsity") > 0.5, "sparse").otherwise("dense"),
            "boundedness": F.when(F.col("range") < 10 * F.col("std"), "bounded").otherwise("unbounded"),
            "energy_class": F.when(F.abs("mean") > F.col("std"), "power").otherwise("energy"),
            "has_dc": F.abs("mean") > 0.1 * F.col("std"),
            "has_trend": F.abs("drift") > 0.5,
        }
    )


FAST = ("p_signal_stats", "p_typology", "p_pairwise", "p_lag_correlation", "p_pointwise", "p_derivative_stats")


def all_fast(s: Signals) -> dict[str, DataFrame]:
    """The six fast primitives over the same observations, by name; plans are shared, nothing runs yet."""
    return {name: s.table(name) for name in FAST}
