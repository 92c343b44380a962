"""Who drives whom: lagged prediction, timing of changes, chains, roots and the graph of causes."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sigloom.functions.columns import corr, div, flag
from sigloom.operators.catalog import KEY, Signals, by_index, view
from sigloom.operators.joins import PAIR, pairs, range_join, shifted

ST = "entity_id source target"
EDGE = ["entity_id", "source", "target"]


@view(f"{ST} ~cross_prediction ~target_self_prediction ~granger_score granger_causes")
def granger_proxy(s: Signals):
    """The target now against the source ten points ago, compared with its own past."""
    past = s["v_base"].select(*KEY, "I", "y").withColumn("past", F.lag("y", 10).over(by_index()))
    own = past.groupBy(*KEY).agg(corr("y", "past").alias("target_self_prediction")).withColumnRenamed("signal_id", "target")
    both = pairs(past, "y", "past", ordered=False).where("past_b is not null")
    m = both.groupBy("entity_id", F.col("signal_b").alias("source"), F.col("signal_a").alias("target")).agg(corr("y_a", "past_b").alias("cross_prediction")).join(own.where("target_self_prediction is not null"), ["entity_id", "target"])
    score = F.abs("cross_prediction") - F.abs("target_self_prediction")
    return m.withColumns({"granger_score": score, "granger_causes": flag(score > 0.1)})


@view("entity_id signal_a signal_b ~score_a_to_b ~score_b_to_a a_causes_b b_causes_a causal_direction ~net_causal_flow")
def bidirectional_causality(s: Signals):
    g = s["v_granger_proxy"]
    there = g.select("entity_id", F.col("source").alias("signal_a"), F.col("target").alias("signal_b"), F.col("granger_score").alias("score_a_to_b"), F.col("granger_causes").alias("a_causes_b"))
    back = g.select("entity_id", F.col("target").alias("signal_a"), F.col("source").alias("signal_b"), F.col("granger_score").alias("score_b_to_a"), F.col("granger_causes").alias("b_causes_a"))
    m = there.join(back, PAIR, "left")
    a, b = F.col("a_causes_b"), flag(F.col("b_causes_a"))
    kind = F.when(a & F.col("b_causes_a"), "bidirectional").when(a & ~F.col("b_causes_a"), "A_causes_B").when(b & ~a, "B_causes_A").otherwise("no_causation")
    return m.withColumns({"causal_direction": kind, "net_causal_flow": F.col("score_a_to_b") - F.coalesce("score_b_to_a", F.lit(0.0))})


@view(f"{ST} ~change_correlation ~transfer_entropy_proxy")
def transfer_entropy_proxy(s: Signals):
    """Changes of quintile, the source's five later than the target's, as the name is defined; see transfer_entropy for the measure."""
    w = by_index()
    later = s["v_base"].select(*KEY, "I", "y").withColumn("before", F.lag("y").over(w)).where("before is not null")
    bins = later.withColumn("bin", F.ntile(5).over(W.partitionBy(*KEY).orderBy("y", "I")).cast("double"))
    moves = bins.withColumn("move", F.col("bin") - F.coalesce(F.lag("bin").over(w), F.col("bin")))
    m = shifted(moves, [5], "move").groupBy("entity_id", F.col("signal_a").alias("source"), F.col("signal_b").alias("target")).agg(corr("move_a", "move_b").alias("change_correlation"))
    return m.withColumn("transfer_entropy_proxy", F.abs("change_correlation"))


@view("entity_id signal_id out_degree in_degree net_influence ~total_causal_flow causal_role")
def causal_roles(s: Signals):
    m = s["v_bidirectional_causality"]
    drives = F.col("causal_direction").isin("A_causes_B", "bidirectional")
    ends = m.where(drives).select("entity_id", F.explode(F.array(F.struct(F.col("signal_a").alias("signal_id"), F.lit(True).alias("out")), F.struct(F.col("signal_b").alias("signal_id"), F.lit(False).alias("out")))).alias("e"))
    n = ends.groupBy("entity_id", F.col("e.signal_id").alias("signal_id")).agg(F.count_if(F.col("e.out")).alias("out_degree"), F.count_if(~F.col("e.out")).alias("in_degree"))
    flow = m.groupBy("entity_id", F.col("signal_a").alias("signal_id")).agg(F.sum("net_causal_flow").alias("flow"))
    o, i = F.col("out_degree"), F.col("in_degree")
    role = F.when((o > 0) & (i == 0), "SOURCE").when((i > 0) & (o == 0), "SINK").when((o > 0) & (i > 0), "CONDUIT").otherwise("ISOLATED")
    return n.join(flow, KEY, "left").withColumns({"net_influence": o - i, "total_causal_flow": F.coalesce("flow", F.lit(0.0)), "causal_role": role})


@view("entity_id root middle leaf chain_path")
def causal_chains(s: Signals):
    d = s["v_bidirectional_causality"].where("causal_direction = 'A_causes_B'")
    first = d.select("entity_id", F.col("signal_a").alias("root"), F.col("signal_b").alias("middle"))
    second = d.select("entity_id", F.col("signal_a").alias("middle"), F.col("signal_b").alias("leaf"))
    return first.join(second, ["entity_id", "middle"]).where("root <> leaf").withColumn("chain_path", F.concat_ws(" → ", "root", "middle", "leaf"))


@view(f"{ST} ~avg_response_lag ~min_response_lag n_linked_events")
def causal_timing(s: Signals):
    spread = F.stddev("dy").over(W.partitionBy(*KEY))
    big = s["v_points"].where("dy is not null").withColumn("size", div(F.abs("dy"), spread)).where("size > 2")
    source, target = big.select("entity_id", "I", F.col("signal_id").alias("source")), big.select("entity_id", "I", F.col("signal_id").alias("target"))
    linked = range_join(source, target, ["entity_id"], "lag", 0.0, 50.0).where("source <> target")
    return linked.groupBy(*EDGE).agg(F.avg("lag").alias("avg_response_lag"), F.min("lag").alias("min_response_lag"), F.count(F.lit(1)).alias("n_linked_events")).where("n_linked_events > 5")


def _changes(s: Signals, name: str, *more: str):
    return s["v_regime_changes"].where("is_regime_change").select("entity_id", "I", F.col("signal_id").alias(name), *more)


@view(f"{ST} ~avg_response_lag ~intervention_correlation n_interventions")
def intervention_effects(s: Signals):
    """The target's change over ten points is taken on its own series, before it is joined with the shocks."""
    change = s["v_base"].select(*KEY, "I", "y").withColumn("change", F.col("y") - F.lag("y", 10).over(by_index())).where("change is not null").withColumnRenamed("signal_id", "target")
    m = range_join(_changes(s, "source", "change_score"), change, ["entity_id"], "lag", 0.0, 30.0).where("source <> target")
    return m.groupBy(*EDGE).agg(F.avg("lag").alias("avg_response_lag"), corr("change_score", "change").alias("intervention_correlation"), F.count(F.lit(1)).alias("n_interventions")).where("n_interventions > 3")


@view("entity_id target candidate_source ~target_change_at ~source_changed_at ~lead_time has_granger_support")
def root_cause_candidates(s: Signals):
    m = range_join(_changes(s, "candidate_source"), _changes(s, "target"), ["entity_id"], "lead_time", 0.0, 50.0).where("candidate_source <> target")
    known = s["v_granger_proxy"].where("granger_causes").select("entity_id", F.col("source").alias("candidate_source"), "target", F.lit(True).alias("known"))
    return m.join(known, ["entity_id", "candidate_source", "target"], "left").withColumns({"target_change_at": F.col("_r"), "source_changed_at": F.col("_l"), "has_granger_support": flag(F.col("known"))})


@view(f"{ST} causal_direction ~granger_score ~coupling_strength coupling_lag ~transfer_entropy_proxy ~combined_causal_strength")
def causal_strength(s: Signals):
    m = s["v_bidirectional_causality"].where(F.col("causal_direction").isin("A_causes_B", "bidirectional"))
    m = m.select("entity_id", F.col("signal_a").alias("source"), F.col("signal_b").alias("target"), "causal_direction", F.col("score_a_to_b").alias("granger_score"))
    coupled = s["v_optimal_lag"].select("entity_id", F.col("signal_a").alias("source"), F.col("signal_b").alias("target"), F.col("optimal_correlation").alias("coupling_strength"), F.col("optimal_lag").alias("coupling_lag"))
    m = m.join(coupled, EDGE, "left").join(s["v_transfer_entropy_proxy"].select(*EDGE, "transfer_entropy_proxy"), EDGE, "left")
    none = F.lit(0.0)
    total = F.coalesce(F.abs("granger_score"), none) + F.coalesce(F.abs("coupling_strength"), none) + F.coalesce("transfer_entropy_proxy", none)
    return m.withColumn("combined_causal_strength", total / 3)


@view(f"{ST} ~weight ~granger_score ~coupling_strength lag edge_type")
def causal_graph(s: Signals):
    """Causal edges, and couplings of pairs that no causal edge joins in either direction: an anti-join on the ordered pair."""
    strong = s["v_causal_strength"]
    causal = strong.where("combined_causal_strength > 0.2").select(*EDGE, F.col("combined_causal_strength").alias("weight"), "granger_score", "coupling_strength", F.col("coupling_lag").alias("lag"), F.lit("causal").alias("edge_type"))
    low, high = F.least("source", "target").alias("low"), F.greatest("source", "target").alias("high")
    coupled = s["v_optimal_lag"].where("optimal_abs_correlation > 0.5").select(
        "entity_id", F.col("signal_a").alias("source"), F.col("signal_b").alias("target"), F.col("optimal_abs_correlation").alias("weight"), F.lit(None).cast("double").alias("granger_score"),
        F.col("optimal_correlation").alias("coupling_strength"), F.col("optimal_lag").alias("lag"), F.lit("coupling").alias("edge_type"),
    )
    taken = strong.select("entity_id", low, high).distinct()
    free = coupled.select("*", low, high).join(taken, ["entity_id", "low", "high"], "left_anti").select(causal.columns)
    return causal.unionByName(free)


@view("entity_id signal_id causal_role out_degree in_degree net_influence ~total_causal_flow drives driven_by")
def causality_complete(s: Signals):
    names = lambda own, other, out: s["v_causal_strength"].groupBy("entity_id", F.col(own).alias("signal_id")).agg(F.array_join(F.sort_array(F.collect_list(other)), ", ").alias(out))
    return s["v_causal_roles"].join(names("source", "target", "drives"), KEY, "left").join(names("target", "source", "driven_by"), KEY, "left")


@view("entity_id n_sources n_sinks n_conduits n_isolated n_edges n_nodes ~causal_density max_chain_depth top_sources")
def system_causal_structure(s: Signals):
    roles = s["v_causal_roles"].groupBy("entity_id").agg(*[F.count_if(F.col("causal_role") == r).alias(f"n_{n}") for r, n in (("SOURCE", "sources"), ("SINK", "sinks"), ("CONDUIT", "conduits"), ("ISOLATED", "isolated"))])
    rank = F.row_number().over(W.partitionBy("entity_id").orderBy(F.desc(F.round("total_causal_flow", 9)), "signal_id"))
    top = s["v_causal_roles"].where("causal_role = 'SOURCE'").withColumn("rank", rank).where("rank <= 3").groupBy("entity_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "signal_id"))), lambda x: x["signal_id"]), ", ").alias("top_sources")
    )
    nodes = s["v_base"].groupBy("entity_id").agg(F.count_distinct("signal_id").alias("n_nodes"))
    edges = s["v_causal_graph"].groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_edges"))
    chains = s["v_causal_chains"].groupBy("entity_id").agg(F.lit(3).cast("long").alias("max_chain_depth"))
    m = nodes
    for other in (roles, edges, chains, top):
        m = m.join(other, "entity_id", "left")
    m = m.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_sources", "n_sinks", "n_conduits", "n_isolated", "n_edges")})
    return m.withColumn("causal_density", div("n_edges", F.col("n_nodes") * (F.col("n_nodes") - 1)))
