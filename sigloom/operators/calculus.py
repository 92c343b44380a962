"""Derivatives, curvature and arc length of each signal: one window chain, one shuffle, one sort; all else are projections."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sigloom.operators.catalog import KEY, Signals, by_index, view

AT = "entity_id signal_id I"


@view(f"{AT} ~y unit dimension")
def base(s: Signals):
    return s.observations


@view(f"{AT} ~y ~dy ~d2y ~d3y ~kappa", "v_points")
def points(s: Signals):
    """Every point with its central differences (null at the ends) and, where both exist, its curvature."""
    w = by_index()
    after, before = F.lead("y").over(w), F.lag("y").over(w)
    two = s["v_base"].withColumns({"dy": (after - before) / 2.0, "d2y": after - 2 * F.col("y") + before})
    three = two.withColumn("d3y", (F.lead("d2y").over(w) - F.lag("d2y").over(w)) / 2.0)
    return three.withColumn("kappa", F.abs("d2y") / F.pow(1 + F.col("dy") * F.col("dy") + 1e-10, F.lit(1.5)))


@view(f"{AT} ~y ~dy")
def dy(s: Signals):
    return s["v_points"]


@view(f"{AT} ~y ~dy ~d2y")
def d2y(s: Signals):
    return s["v_points"]


@view(f"{AT} ~y ~dy ~d2y ~d3y")
def d3y(s: Signals):
    return s["v_points"]


@view(f"{AT} ~y ~dy ~d2y ~kappa")
def curvature(s: Signals):
    return s["v_points"].where("kappa is not null")


@view(f"{AT} ~y ~laplacian")
def laplacian(s: Signals):
    return s["v_points"].withColumn("laplacian", F.col("d2y"))


@view(f"{AT} ~y ~dy ~gradient_magnitude")
def gradient(s: Signals):
    return s["v_points"].withColumn("gradient_magnitude", F.abs("dy"))


@view(f"{AT} ~y ~dy ~segment_length ~arc_length_cumulative")
def arc_length(s: Signals):
    step = F.sqrt(1 + F.coalesce(F.col("dy") * F.col("dy"), F.lit(0.0)))
    so_far = by_index().rowsBetween(W.unboundedPreceding, 0)
    return s["v_points"].withColumns({"segment_length": F.sqrt(1 + F.col("dy") * F.col("dy")), "arc_length_cumulative": F.sum(step).over(so_far)})


@view(f"{AT} ~y ~velocity ~speed ~acceleration ~acceleration_magnitude")
def velocity(s: Signals):
    return s["v_points"].withColumns({"velocity": F.col("dy"), "speed": F.abs("dy"), "acceleration": F.col("d2y"), "acceleration_magnitude": F.abs("d2y")})


@view(f"{AT} ~divergence divergence_state")
def divergence(s: Signals):
    state = F.when(F.col("d2y") > 0.1, "expanding").when(F.col("d2y") < -0.1, "contracting").otherwise("stable")
    return s["v_points"].withColumns({"divergence": F.col("d2y"), "divergence_state": state})


@view(f"{AT} ~dy ~d2y ~roughness_index ~smoothness_index")
def smoothness(s: Signals):
    moves = F.abs("dy") > 1e-10
    return s["v_points"].withColumns({"roughness_index": F.when(moves, F.abs("d2y") / F.abs("dy")), "smoothness_index": F.when(moves, F.abs("dy") / (F.abs("d2y") + 1e-10))})


@view(f"{AT} ~y ~dy ~d2y ~d3y ~kappa ~laplacian ~gradient_magnitude ~arc_length_cumulative ~roughness_index ~smoothness_index ~divergence divergence_state")
def calculus_complete(s: Signals):
    """No joins: all of these are columns of one chain over the same windows."""
    arc = s["v_arc_length"]
    moves = F.abs("dy") > 1e-10
    return arc.withColumns(
        {
            "laplacian": F.col("d2y"),
            "gradient_magnitude": F.abs("dy"),
            "roughness_index": F.when(moves, F.abs("d2y") / F.abs("dy")),
            "smoothness_index": F.when(moves, F.abs("dy") / (F.abs("d2y") + 1e-10)),
            "divergence": F.col("d2y"),
            "divergence_state": F.when(F.col("d2y") > 0.1, "expanding").when(F.col("d2y") < -0.1, "contracting").otherwise("stable"),
        }
    ).where("kappa is not null")


@view("n_rows n_entities n_signals ~I_min ~I_max validation_status")
def schema_validation(s: Signals):
    n = [F.count(F.lit(1)).alias("n_rows"), F.count_distinct("entity_id").alias("n_entities"), F.count_distinct("signal_id").alias("n_signals"), F.min("I").alias("I_min"), F.max("I").alias("I_max")]
    status = F.when(F.col("n_rows") == 0, "ERROR: No data").when(F.col("n_signals") == 0, "ERROR: No signals").otherwise("OK")
    return s["v_base"].agg(*n).withColumn("validation_status", status)


@view("entity_id signal_id n_points ~I_min ~I_max ~y_min ~y_max ~y_mean unit dimension")
def signal_inventory(s: Signals):
    ends = [f(c).alias(f"{c}_{k}") for c in ("I", "y") for k, f in (("min", F.min), ("max", F.max))]
    return s["v_base"].groupBy(*KEY, "unit", "dimension").agg(F.count(F.lit(1)).alias("n_points"), *ends, F.avg("y").alias("y_mean"))


@view("entity_id signal_id n_points insufficient_data constant_signal has_nulls")
def data_quality(s: Signals):
    return s["v_signal_inventory"].withColumns(
        {"insufficient_data": F.col("n_points") < 50, "constant_signal": F.coalesce(F.col("y_min") == F.col("y_max"), F.lit(False)), "has_nulls": F.col("y_min").isNull() | F.col("y_max").isNull()}
    )
