"""Modes with affinities: what each mode looks like, weighted by how surely its signals belong to it, and how that changes.

An assignment is a table of rows (entity_id, signal_id, period, mode_id, affinity, mode_entropy) with features beside them: a
mixture's result (kernel `modes`), or the soft assignment below, whose centres are given. All results are long, a row for each
mode, pair of modes or feature, so their columns do not depend on the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sigloom.functions.columns import div
from sigloom.operators.catalog import KEY, Signals, view

FEATURES = ["level", "spread", "slope"]
CENTRES, WIDTH, PERIOD = (35.0, 50.0, 65.0), 12.0, 120.0


def soft_modes(points: DataFrame, centres: tuple[float, ...] = CENTRES, width: float = WIDTH, period: float = PERIOD) -> DataFrame:
    """Each signal's periods, assigned to given centres of the level by exponentially falling weights."""
    m = points.groupBy(*KEY, F.floor(F.col("I") / period).alias("period")).agg(F.avg("y").alias("level"), F.stddev_pop("y").alias("spread"), div(F.covar_pop("I", "y"), F.var_pop("I")).alias("slope"))
    weights = [F.exp(-F.abs(F.col("level") - c) / width) for c in centres]
    total = sum(weights[1:], weights[0])
    shares = F.array(*[w / total for w in weights])
    best = F.array_max("shares")
    return m.withColumn("shares", shares).select(
        *KEY, "period", *FEATURES, (F.array_position("shares", best) - 1).alias("mode_id"), best.alias("affinity"), (-F.aggregate("shares", F.lit(0.0), lambda a, p: a + p * F.ln(p))).alias("mode_entropy")
    )


def _long(modes: DataFrame) -> DataFrame:
    """A row for each feature that is known."""
    parts = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in FEATURES])
    return modes.withColumn("f", F.explode(parts)).select(*[c for c in modes.columns if c not in FEATURES], "f.*").where("value is not null")


def weighted(modes: DataFrame) -> DataFrame:
    """entity_id, mode_id, feature: mean and variance with the affinities as weights; no variance of one value."""
    a, v = F.col("affinity"), F.col("value")
    m = _long(modes).groupBy("entity_id", "mode_id", "feature").agg(F.count(v).alias("n"), div(F.sum(a * v), F.sum(a)).alias("weighted_mean"), div(F.sum(a * v * v), F.sum(a)).alias("square"))
    return m.withColumn("weighted_variance", F.when(F.col("n") > 1, F.greatest(F.col("square") - F.col("weighted_mean") * F.col("weighted_mean"), F.lit(0.0)))).drop("square")


def contrasts(means: DataFrame) -> DataFrame:
    """How far two modes of an entity lie apart in each feature: an equi-join on (entity, feature)."""
    side = lambda n: means.select("entity_id", "feature", F.col("mode_id").alias(f"mode_{n}"), F.col("weighted_mean").alias(n))
    return side("a").join(side("b"), ["entity_id", "feature"]).where("mode_a < mode_b").withColumn("contrast", F.abs(F.col("a") - F.col("b")))


def uncertain(modes: DataFrame) -> DataFrame:
    """Adds `transitioning`: the entropy is above the entity's median, so the signal stands between modes."""
    return modes.withColumn("transitioning", F.col("mode_entropy") > F.median("mode_entropy").over(W.partitionBy("entity_id")))


def trajectories(modes: DataFrame) -> DataFrame:
    """For each signal of two periods or more: slope of its affinity by step, and how often its mode changes."""
    w = W.partitionBy(*KEY).orderBy("period")
    m = modes.withColumns({"step": F.row_number().over(w) - 1, "switch": (F.col("mode_id") != F.lag("mode_id").over(w)).cast("int")})
    return m.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.regr_slope("affinity", "step").alias("trend"), F.coalesce(F.sum("switch"), F.lit(0)).alias("switches")).where("n > 1")


def _assigned(s: Signals) -> DataFrame:
    return soft_modes(s["v_base"].select(*KEY, "I", "y"))


@view("entity_id signal_id period mode_id ~affinity ~mode_entropy ~level ~spread ~slope", "e_soft_modes")
def e_soft_modes(s: Signals):
    return _assigned(s)


@view("entity_id mode_id feature n ~weighted_mean ~weighted_variance", "e_affinity_features")
def e_affinity_features(s: Signals):
    return weighted(s["e_soft_modes"])


@view("entity_id feature mode_a mode_b ~contrast", "e_affinity_contrasts")
def e_affinity_contrasts(s: Signals):
    return contrasts(s["e_affinity_features"])


@view("entity_id ~affinity_mean ~affinity_std ~affinity_min ~affinity_range ~entropy_mean ~entropy_std ~entropy_max n_transitioning ~transitioning_ratio n_modes", "e_affinity_summary")
def e_affinity_summary(s: Signals):
    a, e = F.col("affinity"), F.col("mode_entropy")
    return uncertain(s["e_soft_modes"]).groupBy("entity_id").agg(
        F.avg(a).alias("affinity_mean"), F.stddev(a).alias("affinity_std"), F.min(a).alias("affinity_min"), (F.max(a) - F.min(a)).alias("affinity_range"), F.avg(e).alias("entropy_mean"), F.stddev(e).alias("entropy_std"),
        F.max(e).alias("entropy_max"), F.count_if("transitioning").alias("n_transitioning"), F.avg(F.col("transitioning").cast("double")).alias("transitioning_ratio"), F.count_distinct("mode_id").alias("n_modes"),
    )


@view("entity_id feature ~transitioning_mean ~stable_mean ~contrast", "e_transition_contrasts")
def e_transition_contrasts(s: Signals):
    """Each feature's mean over signals between modes, and over the others."""
    m = _long(uncertain(s["e_soft_modes"])).groupBy("entity_id", "feature").agg(F.avg(F.when(F.col("transitioning"), F.col("value"))).alias("transitioning_mean"), F.avg(F.when(~F.col("transitioning"), F.col("value"))).alias("stable_mean"))
    return m.withColumn("contrast", F.col("transitioning_mean") - F.col("stable_mean"))


@view("entity_id ~trend_mean ~trend_std ~trend_min n_weakening n_strengthening total_switches signals_with_switches max_switches ~switch_ratio", "e_affinity_dynamics")
def e_affinity_dynamics(s: Signals):
    """Trends beyond a hundredth of affinity a period count as weakening or strengthening."""
    t, n = F.col("trend"), F.col("switches")
    return trajectories(s["e_soft_modes"]).groupBy("entity_id").agg(
        F.avg(t).alias("trend_mean"), F.stddev_pop(t).alias("trend_std"), F.min(t).alias("trend_min"), F.count_if(t < -0.01).alias("n_weakening"), F.count_if(t > 0.01).alias("n_strengthening"),
        F.sum(n).alias("total_switches"), F.count_if(n > 0).alias("signals_with_switches"), F.max(n).alias("max_switches"), F.avg((n > 0).cast("double")).alias("switch_ratio"),
    )
