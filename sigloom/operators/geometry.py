"""Coupling between signals: correlations at once and at lags, who leads, clusters and shared information."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sigloom.functions.columns import corr
from sigloom.operators.catalog import Signals, view
from sigloom.operators.joins import PAIR, pairs, shifted

P = "entity_id signal_a signal_b"
LAGS = [1, 5, 10, 15, 20]


@view(f"{P} ~pearson_correlation n_overlap")
def correlation_matrix(s: Signals):
    return s["v_pair_metrics"].where("n_overlap > 50").withColumnRenamed("y_corr", "pearson_correlation")


@view(f"{P} n_overlap n_moves ~y_corr ~dy_corr ~d2y_corr ~residual_corr ~y_covariance", "v_pair_metrics")
def pair_metrics(s: Signals):
    """All that is measured at one index, in one join and one aggregate."""
    mean = F.avg("y").over(W.partitionBy("entity_id", "I"))
    points = s["v_points"].select("entity_id", "signal_id", "I", "y", "dy", "d2y").withColumn("residual", F.col("y") - mean)
    both = pairs(points, "y", "dy", "d2y", "residual")
    moves = F.col("dy_a").isNotNull() & F.col("dy_b").isNotNull()
    return both.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("n_overlap"), F.count_if(moves).alias("n_moves"), *[corr(f"{c}_a", f"{c}_b").alias(f"{c}_corr") for c in ("y", "residual")],
        *[corr(F.when(moves, F.col(f"{c}_a")), F.when(moves, F.col(f"{c}_b"))).alias(f"{c}_corr") for c in ("dy", "d2y")],
        F.avg(F.col("y_a") * F.col("y_b")).alias("ab"), F.avg("y_a").alias("a"), F.avg("y_b").alias("b"), F.covar_pop("y_a", "y_b").alias("y_covariance"),
    )


@view(f"{P} lag ~correlation")
def lagged_correlation(s: Signals):
    return shifted(s["v_base"], LAGS, "y").groupBy(*PAIR, "lag").agg(corr("y_a", "y_b").alias("correlation"))


@view(f"{P} optimal_lag ~optimal_correlation ~optimal_abs_correlation coupling_strength")
def optimal_lag(s: Signals):
    best = F.max_by(F.struct("lag", "correlation"), F.struct(F.round(F.abs("correlation"), 9), -F.col("lag")))
    m = s["v_lagged_correlation"].groupBy(*PAIR).agg(best.alias("best")).select(*PAIR, F.col("best.lag").alias("optimal_lag"), F.col("best.correlation").alias("optimal_correlation"))
    c = F.col("optimal_correlation")
    kind = F.when(c > 0.7, "strong_positive").when(c > 0.3, "moderate_positive").when(c < -0.7, "strong_negative").when(c < -0.3, "moderate_negative").otherwise("weak")
    return m.withColumns({"optimal_abs_correlation": F.abs(c), "coupling_strength": kind})


@view(f"{P} ~corr_forward ~corr_backward ~lead_lag_asymmetry lead_lag_direction leader_signal")
def lead_lag(s: Signals):
    """corr_forward pairs a with b ten steps earlier, so a high value means that b leads; leader_signal says so."""
    both = shifted(s["v_base"], [10, -10], "y").groupBy(*PAIR).agg(*[corr(F.when(F.col("lag") == k, F.col("y_a")), F.when(F.col("lag") == k, F.col("y_b"))).alias(n) for k, n in ((10, "corr_forward"), (-10, "corr_backward"))])
    forward, back = F.col("corr_forward"), F.col("corr_backward")
    kind = F.when(forward > back + 0.1, "A_leads_B").when(back > forward + 0.1, "B_leads_A").otherwise("contemporaneous")
    leader = F.when(forward > back + 0.1, F.col("signal_b")).when(back > forward + 0.1, F.col("signal_a"))
    return both.where("corr_forward is not null and corr_backward is not null").withColumns({"lead_lag_asymmetry": forward - back, "lead_lag_direction": kind, "leader_signal": leader})


@view("entity_id source target ~weight ~abs_weight lag coupling_strength edge_type")
def coupling_network(s: Signals):
    m = s["v_optimal_lag"].where("optimal_abs_correlation > 0.3")
    edge = F.when(F.col("optimal_correlation") > 0, "positive").otherwise("negative")
    return m.select("entity_id", F.col("signal_a").alias("source"), F.col("signal_b").alias("target"), F.col("optimal_correlation").alias("weight"), F.col("optimal_abs_correlation").alias("abs_weight"), F.col("optimal_lag").alias("lag"), "coupling_strength", edge.alias("edge_type"))


@view("entity_id signal_id degree ~weighted_degree ~avg_coupling_strength")
def node_degree(s: Signals):
    ends = s["v_coupling_network"].select("entity_id", F.explode(F.array("source", "target")).alias("signal_id"), "abs_weight")
    return ends.groupBy("entity_id", "signal_id").agg(F.count(F.lit(1)).alias("degree"), F.sum("abs_weight").alias("weighted_degree"), F.avg("abs_weight").alias("avg_coupling_strength"))


@view("entity_id signal_id out_degree in_degree net_influence influence_type")
def directional_degree(s: Signals):
    leads = s["v_lead_lag"].where("lead_lag_direction = 'A_leads_B'")
    ends = leads.select("entity_id", F.explode(F.array(F.struct(F.col("signal_a").alias("signal_id"), F.lit(1).alias("out")), F.struct(F.col("signal_b").alias("signal_id"), F.lit(0).alias("out")))).alias("e"))
    m = ends.groupBy("entity_id", F.col("e.signal_id").alias("signal_id")).agg(F.count_if(F.col("e.out") == 1).alias("out_degree"), F.count_if(F.col("e.out") == 0).alias("in_degree"))
    o, i = F.col("out_degree"), F.col("in_degree")
    return m.withColumns({"net_influence": o - i, "influence_type": F.when(o > i * 2, "driver").when(i > o * 2, "follower").otherwise("bidirectional")})


@view("entity_id signal_id cluster_id cluster_size")
def correlation_clusters(s: Signals):
    """The least partner over strong edges, taken one step."""
    edges = s["v_optimal_lag"].where("optimal_abs_correlation > 0.6")
    member = edges.select("entity_id", F.explode(F.array("signal_a", "signal_b")).alias("signal_id"), "signal_a").groupBy("entity_id", "signal_id").agg(F.min("signal_a").alias("cluster_id"))
    return member.withColumn("cluster_size", F.count(F.lit(1)).over(W.partitionBy("entity_id", "cluster_id")))


@view(f"{P} ~velocity_correlation ~acceleration_correlation")
def derivative_correlation(s: Signals):
    return s["v_pair_metrics"].where("n_moves > 50").withColumnsRenamed({"dy_corr": "velocity_correlation", "d2y_corr": "acceleration_correlation"})


@view(f"{P} ~covariance")
def covariance_matrix(s: Signals):
    """About each signal's mean over all its points, not over the common ones alone."""
    mean = lambda n: s["v_stats_global"].select("entity_id", F.col("signal_id").alias(f"signal_{n}"), F.col("y_mean").alias(f"mean_{n}"))
    m = s["v_pair_metrics"].join(mean("a"), ["entity_id", "signal_a"]).join(mean("b"), ["entity_id", "signal_b"])
    return m.withColumn("covariance", F.col("y_covariance") + (F.col("a") - F.col("mean_a")) * (F.col("b") - F.col("mean_b")))


@view(f"{P} ~partial_correlation_proxy")
def partial_correlation_proxy(s: Signals):
    return s["v_pair_metrics"].withColumnRenamed("residual_corr", "partial_correlation_proxy")


@view(f"{P} ~mutual_information_proxy")
def mutual_info_proxy(s: Signals):
    """Ten equal-frequency bins; the marginal counts are over all partners of a signal."""
    bins = s["v_base"].withColumn("bin", F.ntile(10).over(W.partitionBy("entity_id", "signal_id").orderBy("y", "I")))
    joint = pairs(bins, "bin").groupBy(*PAIR, "bin_a", "bin_b").agg(F.count(F.lit(1)).alias("n"))
    over = lambda *k: F.sum("n").over(W.partitionBy("entity_id", *k)).cast("double")
    m = joint.withColumns({"total": over("signal_a", "signal_b"), "ma": over("signal_a", "bin_a"), "mb": over("signal_b", "bin_b")})
    return m.groupBy(*PAIR).agg(F.sum(F.col("n") / F.col("total") * F.ln(F.col("n") * F.col("total") / (F.col("ma") * F.col("mb")))).alias("mutual_information_proxy"))


@view(f"{P} ~instant_correlation optimal_lag ~optimal_correlation coupling_strength lead_lag_direction ~lead_lag_asymmetry ~velocity_correlation ~acceleration_correlation ~partial_correlation_proxy ~mutual_information_proxy")
def geometry_complete(s: Signals):
    m = s["v_pair_metrics"].select(
        *PAIR, F.when(F.col("n_overlap") > 50, F.col("y_corr")).alias("instant_correlation"), F.when(F.col("n_moves") > 50, F.col("dy_corr")).alias("velocity_correlation"),
        F.when(F.col("n_moves") > 50, F.col("d2y_corr")).alias("acceleration_correlation"), F.col("residual_corr").alias("partial_correlation_proxy"),
    )
    return s["v_optimal_lag"].join(m, PAIR, "left").join(s["v_lead_lag"], PAIR, "left").join(s["v_mutual_info_proxy"], PAIR, "left")
