"""Entropies of values, moves, pairs and patterns.

The bins under the reference names are of equal frequency, so those entropies depend on the number of points alone;
histogram_entropy has bins of equal width, and rolling_histogram_entropy the same within a moving window.
"""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sigloom.functions.columns import div, entropy_term
from sigloom.operators.catalog import KEY, Signals, by_index, view
from sigloom.operators.joins import PAIR, pairs

S = "entity_id signal_id"
P = "entity_id signal_a signal_b"


def _entropy(counts, keys: list[str], name: str):
    """-sum p ln p over rows of keys and a count n."""
    p = counts.withColumn("p", div("n", F.sum("n").over(W.partitionBy(*keys))))
    return p.groupBy(*keys).agg((-F.sum(entropy_term("p"))).alias(name))


def _ntile_counts(df, n: int, value: str, keys: list[str]):
    return df.withColumn("bin", F.ntile(n).over(W.partitionBy(*keys).orderBy(value, "I"))).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))


@view(f"{S} bin_id bin_count total_count ~probability")
def binned_distribution(s: Signals):
    m = _ntile_counts(s["v_base"], 20, "y", KEY).withColumns({"bin_id": F.col("bin").cast("long"), "bin_count": F.col("n"), "total_count": F.sum("n").over(W.partitionBy(*KEY))})
    return m.withColumn("probability", div("bin_count", "total_count"))


@view(f"{S} ~shannon_entropy ~normalized_entropy entropy_category")
def shannon_entropy(s: Signals):
    m = s["v_binned_distribution"].groupBy(*KEY).agg((-F.sum(entropy_term("probability"))).alias("shannon_entropy")).withColumn("normalized_entropy", F.col("shannon_entropy") / F.ln(F.lit(20.0)))
    return m.withColumn("entropy_category", F.when(F.col("normalized_entropy") > 0.9, "high_entropy").when(F.col("normalized_entropy") > 0.5, "medium_entropy").otherwise("low_entropy"))


@view(f"{S} ~derivative_entropy")
def derivative_entropy(s: Signals):
    return _entropy(_ntile_counts(s["v_points"].where("dy is not null"), 20, "dy", KEY), KEY, "derivative_entropy")


@view(f"{P} ~joint_entropy")
def joint_entropy(s: Signals):
    """Deciles of each signal over all the rows it has in pairs, and one total for all pairs of an entity."""
    both = pairs(s["v_base"], "y")
    decile = lambda n, o: F.ntile(10).over(W.partitionBy("entity_id", f"signal_{n}").orderBy(f"y_{n}", "I", f"signal_{o}"))
    counts = both.withColumns({"bin_a": decile("a", "b"), "bin_b": decile("b", "a")}).groupBy(*PAIR, "bin_a", "bin_b").agg(F.count(F.lit(1)).alias("n"))
    p = counts.withColumn("p", div("n", F.sum("n").over(W.partitionBy("entity_id"))))
    return p.groupBy(*PAIR).agg((-F.sum(entropy_term("p"))).alias("joint_entropy"))


@view(f"{P} ~joint_entropy ~entropy_a ~entropy_b ~conditional_entropy_b_given_a ~conditional_entropy_a_given_b")
def conditional_entropy(s: Signals):
    own = lambda n: s["v_shannon_entropy"].select("entity_id", F.col("signal_id").alias(f"signal_{n}"), F.col("shannon_entropy").alias(f"entropy_{n}"))
    m = s["v_joint_entropy"].join(own("a"), ["entity_id", "signal_a"]).join(own("b"), ["entity_id", "signal_b"])
    return m.withColumns({"conditional_entropy_b_given_a": F.col("joint_entropy") - F.col("entropy_a"), "conditional_entropy_a_given_b": F.col("joint_entropy") - F.col("entropy_b")})


@view(f"{P} ~mutual_information ~normalized_mutual_info")
def mutual_information(s: Signals):
    m = s["v_conditional_entropy"].withColumn("mutual_information", F.col("entropy_a") + F.col("entropy_b") - F.col("joint_entropy"))
    return m.withColumn("normalized_mutual_info", div("mutual_information", F.least("entropy_a", "entropy_b")))


@view(f"{S} ~permutation_entropy ~normalized_permutation_entropy complexity_category")
def permutation_entropy(s: Signals):
    """Order three; triples with equal values are left out."""
    w = by_index()
    three = s["v_base"].select(*KEY, F.col("y").alias("a"), F.lead("y", 1).over(w).alias("b"), F.lead("y", 2).over(w).alias("c")).where("a <> b and b <> c and a <> c")
    pattern = F.concat((F.col("a") < F.col("b")).cast("string"), (F.col("b") < F.col("c")).cast("string"), (F.col("a") < F.col("c")).cast("string"))
    m = _entropy(three.groupBy(*KEY, pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("n")), KEY, "permutation_entropy")
    m = m.withColumn("normalized_permutation_entropy", F.col("permutation_entropy") / F.ln(F.lit(6.0)))
    return m.withColumn("complexity_category", F.when(F.col("normalized_permutation_entropy") > 0.9, "random").when(F.col("normalized_permutation_entropy") < 0.5, "structured").otherwise("mixed"))


@view(f"{S} ~approx_entropy_proxy")
def approx_entropy_proxy(s: Signals):
    """Words of three bits: whether a point is above the mean of the five around it."""
    w = by_index()
    bit = s["v_base"].withColumn("bit", (F.col("y") > F.avg("y").over(w.rowsBetween(-2, 2))).cast("int"))
    words = bit.withColumn("word", F.col("bit") * 4 + F.lead("bit", 1).over(w) * 2 + F.lead("bit", 2).over(w)).where("word is not null")
    return _entropy(words.groupBy(*KEY, "word").agg(F.count(F.lit(1)).alias("n")), KEY, "approx_entropy_proxy")


@view(f"{S} ~spectral_entropy_proxy")
def spectral_entropy_proxy(s: Signals):
    slow = F.abs(F.col("y") - F.avg("y").over(by_index().rowsBetween(-20, 20)))
    m = s["v_curvature"].withColumn("ratio", div(F.abs("d2y"), slow + 0.001))
    return _entropy(_ntile_counts(m, 10, "ratio", KEY), KEY, "spectral_entropy_proxy")


@view(f"{S} I ~rolling_entropy")
def rolling_entropy(s: Signals):
    """Over the points at one index of a signal, as the name is defined: nought where the index does not repeat."""
    bins = s["v_base"].withColumn("bin", F.ntile(10).over(by_index())).groupBy(*KEY, "I", "bin").agg(F.count(F.lit(1)).alias("n"))
    p = bins.withColumn("p", div("n", F.sum("n").over(W.partitionBy(*KEY, "I"))))
    return p.groupBy(*KEY, "I").agg((-F.sum_distinct(entropy_term("p"))).alias("rolling_entropy"))


@view(f"{S} ~entropy_first_half ~entropy_second_half ~information_gain complexity_trend")
def information_gain(s: Signals):
    half = F.col("I") < F.max("I").over(W.partitionBy(*KEY)) / 2
    counts = _ntile_counts(s["v_base"].withColumn("first_half", half), 20, "y", [*KEY, "first_half"])
    m = _entropy(counts, [*KEY, "first_half"], "h").groupBy(*KEY).agg(F.max(F.when(F.col("first_half"), F.col("h"))).alias("entropy_first_half"), F.max(F.when(~F.col("first_half"), F.col("h"))).alias("entropy_second_half"))
    m = m.where("entropy_first_half is not null and entropy_second_half is not null").withColumn("information_gain", F.col("entropy_first_half") - F.col("entropy_second_half"))
    gain = F.round("information_gain", 9)
    return m.withColumn("complexity_trend", F.when(gain > 0, "increasing_order").when(gain < 0, "increasing_disorder").otherwise("stable_complexity"))


@view(f"{S} ~shannon_entropy ~normalized_entropy entropy_category ~derivative_entropy ~permutation_entropy ~normalized_permutation_entropy complexity_category ~approx_entropy_proxy ~spectral_entropy_proxy ~entropy_first_half ~entropy_second_half ~information_gain complexity_trend")
def entropy_complete(s: Signals):
    one = s["v_shannon_entropy"]
    for name in ("derivative_entropy", "permutation_entropy", "approx_entropy_proxy", "spectral_entropy_proxy", "information_gain"):
        one = one.join(s[f"v_{name}"], KEY, "left")
    return one


@view(f"{S} ~histogram_entropy n_bins")
def histogram_entropy(s: Signals):
    """Twenty bins of equal width between the least and the greatest value."""
    w = W.partitionBy(*KEY)
    low, high = F.min("y").over(w), F.max("y").over(w)
    cell = F.least(F.floor(F.coalesce(div(F.col("y") - low, high - low), F.lit(0.0)) * 20), F.lit(19))
    counts = s["v_base"].withColumn("bin", cell).groupBy(*KEY, "bin").agg(F.count(F.lit(1)).alias("n"))
    return _entropy(counts, KEY, "histogram_entropy").join(counts.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_bins")), KEY)
