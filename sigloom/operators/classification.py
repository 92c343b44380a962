"""What kind of signal each is: by its unit, its values, its smoothness, its period and its zeros."""

from pyspark.sql import functions as F

from sigloom.functions.columns import div, flag, share
from sigloom.operators.catalog import KEY, Signals, by_index, view
from sigloom.sources.intake import ANALOG_UNITS, DIGITAL_UNITS, EVENT_UNITS, STEPWISE_UNITS

S = "entity_id signal_id"
#: What the index's dimension says about derivatives and relations.
MEANING = {"time": ("velocity/acceleration", "causal"), "space": ("gradient/laplacian", "coupling"), "frequency": ("spectral_slope", "harmonic"), "scale": ("scale_derivative", "hierarchical")}


@view(f"{S} unit unit_class interpolation_valid_from_unit")
def class_from_units(s: Signals):
    u = F.col("unit")
    kind = F.when(u.isin(ANALOG_UNITS), "analog").when(u.isin(DIGITAL_UNITS), "digital").when(u.isin(EVENT_UNITS), "event").otherwise("unknown")
    return s["v_base"].select(*KEY, "unit").distinct().withColumns({"unit_class": kind, "interpolation_valid_from_unit": ~flag(u.isin(STEPWISE_UNITS))})


@view(f"{S} ~unique_ratio is_all_integer n_distinct_values ~value_range ~values_per_range")
def class_continuity(s: Signals):
    cells = s["v_base"].withColumns({"fine": F.floor(F.col("y") * 10000 + 0.5), "coarse": F.floor(F.col("y") * 100 + 0.5)})
    n = cells.groupBy(*KEY).agg(
        F.count_distinct("fine").alias("n_fine"), F.count_distinct("coarse").alias("n_distinct_values"), F.count(F.lit(1)).alias("n"), F.bool_and(F.col("y") == F.floor("y")).alias("is_all_integer"),
        (F.max("y") - F.min("y")).alias("value_range"),
    )
    return n.withColumns({"unique_ratio": div("n_fine", "n"), "values_per_range": div("n_distinct_values", "value_range")})


@view(f"{S} ~mean_abs_dy ~std_dy ~mean_kappa ~std_kappa ~roughness ~kappa_consistency")
def class_smoothness(s: Signals):
    m = s["v_curvature"].groupBy(*KEY).agg(F.avg(F.abs("dy")).alias("mean_abs_dy"), F.stddev("dy").alias("std_dy"), F.avg("kappa").alias("mean_kappa"), F.stddev("kappa").alias("std_kappa"))
    return m.withColumns({"roughness": div("std_dy", "mean_abs_dy"), "kappa_consistency": 1 - div("std_kappa", F.col("mean_kappa") + 0.001)})


@view(f"{S} n_half_periods ~estimated_period ~period_variability is_periodic")
def class_periodicity(s: Signals):
    """Half periods between changes of sign of the second difference; the next change is a lead, not a self-join."""
    w = by_index()
    signs = s["v_curvature"].select(*KEY, "I", F.signum("d2y").alias("sign")).withColumn("before", F.lag("sign").over(w))
    half = signs.where("sign <> before").withColumn("half", F.lead("I").over(w) - F.col("I")).where("half is not null")
    m = half.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_half_periods"), F.avg("half").alias("mean"), F.stddev("half").alias("std"))
    varies = div("std", "mean")
    return m.withColumns({"estimated_period": F.col("mean") * 2, "period_variability": varies, "is_periodic": flag((varies < 0.2) & (F.col("n_half_periods") > 5))})


@view(f"{S} n_total n_zeros n_nonzero ~sparsity is_sparse_event")
def class_sparsity(s: Signals):
    zero = F.col("y").isNull() | (F.col("y") == 0)
    m = s["v_base"].groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_total"), F.count_if(zero).alias("n_zeros"), F.count_if(F.col("y") != 0).alias("n_nonzero"), share(zero).alias("sparsity"))
    return m.withColumn("is_sparse_event", F.col("sparsity") > 0.9)


@view(f"{S} unit signal_class class_source interpolation_valid is_periodic ~estimated_period max_derivative_order ~unique_ratio is_all_integer n_distinct_values ~sparsity ~kappa_consistency ~period_variability")
def signal_class(s: Signals):
    all_of = s["v_class_from_units"]
    for name in ("continuity", "periodicity", "sparsity", "smoothness"):
        all_of = all_of.join(s[f"v_class_{name}"], KEY, "left")
    known = F.col("unit_class") != "unknown"
    few = F.col("is_all_integer") & (F.col("unique_ratio") < 0.05)
    fewer = F.col("is_all_integer") & (F.col("n_distinct_values") < 10)
    periodic = flag(F.col("is_periodic"))
    return all_of.withColumns(
        {
            "signal_class": F.when(known, F.col("unit_class")).when(F.col("is_sparse_event"), "event").when(periodic, "periodic").when(few | fewer, "digital").otherwise("analog"),
            "class_source": F.when(known, "unit").when(F.col("is_sparse_event"), "sparsity").when(periodic, "periodicity").when(few | fewer, "continuity").otherwise("default"),
            "interpolation_valid": ~flag(F.col("unit_class").isin("digital", "event") | F.col("is_sparse_event") | few),
            "max_derivative_order": F.when((F.col("unit_class") == "analog") | periodic, 3).when(F.col("is_all_integer"), 0).otherwise(2),
            "is_periodic": periodic,
        }
    )


@view(f"{S} dimension derivative_meaning relationship_type causality_directional")
def index_properties(s: Signals):
    d = F.col("dimension")
    pick = lambda i, other: F.coalesce(*[F.when(d == k, v[i]) for k, v in MEANING.items()], F.lit(other))
    return s["v_base"].select(*KEY, "dimension").distinct().withColumns({"derivative_meaning": pick(0, "unknown"), "relationship_type": pick(1, "correlation"), "causality_directional": flag(d == "time")})


@view(f"{S} unit signal_class class_source interpolation_valid is_periodic ~estimated_period max_derivative_order dimension derivative_meaning relationship_type causality_directional ~unique_ratio ~sparsity ~kappa_consistency")
def classification_complete(s: Signals):
    return s["v_signal_class"].join(s["v_index_properties"], KEY, "left")
