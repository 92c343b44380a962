"""Joins that the operators share: pairs of signals at an index, and ranges of the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

PAIR = ["entity_id", "signal_a", "signal_b"]


def side(df: DataFrame, name: str, *values: str) -> DataFrame:
    """The columns of one side of a pair: signal_a and, for y, y_a."""
    return df.select("entity_id", "I", F.col("signal_id").alias(f"signal_{name}"), *[F.col(v).alias(f"{v}_{name}") for v in values])


def pairs(df: DataFrame, *values: str, ordered: bool = True) -> DataFrame:
    """Two signals of one entity at one index: a < b, or all that differ. An equi-join on (entity, index)."""
    a, b = side(df, "a", *values), side(df, "b", *values)
    apart = F.col("signal_a") < F.col("signal_b") if ordered else F.col("signal_a") != F.col("signal_b")
    return a.join(b, ["entity_id", "I"]).where(apart)


def shifted(df: DataFrame, shifts: list[int], *values: str) -> DataFrame:
    """Signals a and b where a stands `lag` later than b: one equi-join for all lags, b's rows once for each lag."""
    b = side(df, "b", *values).withColumn("lag", F.explode(F.array(*[F.lit(k) for k in shifts]))).withColumn("I", F.col("I") + F.col("lag"))
    return side(df, "a", *values).join(b, ["entity_id", "I"]).where("signal_a <> signal_b")


def range_join(left: DataFrame, right: DataFrame, on: list[str], at: str, lower: Column | float, upper: float, left_at: str = "I", right_at: str = "I") -> DataFrame:
    """Rows with equal `on` and lower < right - left < upper; `at` is the name of the difference.

    The index is cut into buckets as wide as the range: the right side goes to its own bucket, the left side to all that it
    can reach, so it is an equi-join on (on, bucket) and not a nested loop.
    """
    width = float(upper) - float(lower)
    first, last = F.floor((F.col("_l") + F.lit(float(lower))) / width), F.floor((F.col("_l") + F.lit(float(upper))) / width)
    a = left.withColumn("_l", F.col(left_at)).withColumn("_bucket", F.explode(F.sequence(first, last))).drop(*([left_at] if left_at == right_at else []))
    b = right.withColumn("_r", F.col(right_at)).withColumn("_bucket", F.floor(F.col("_r") / width))
    both = a.join(b, [*on, "_bucket"]).withColumn(at, F.col("_r") - F.col("_l"))
    return both.where((F.col(at) > lower) & (F.col(at) < upper)).drop("_bucket")


def outer(a: DataFrame, b: DataFrame, on: list[str], zero: list[str]) -> DataFrame:
    """A full outer join in which the counts of a side that has no row are 0."""
    both = a.join(b, on, "full")
    return both.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in zero})


def ahead(left: DataFrame, right: DataFrame, on: list[str], name: str, left_at: str = "I", right_at: str = "I") -> DataFrame:
    """As-of join forwards: the first of the right side's places at or after each row of the left.

    Both sides go through one window, sorted together, so there is neither a nested loop nor a look-up for each row.
    """
    rows = left.withColumn("_at", F.col(left_at)).withColumn("_mark", F.lit(None).cast("double"))
    marks = right.select(*on, F.col(right_at).alias("_at"), F.col(right_at).cast("double").alias("_mark"))
    # of equal places the marks come last, so that they still lie ahead
    w = W.partitionBy(*on).orderBy("_at", F.col("_mark").isNotNull()).rowsBetween(0, W.unboundedFollowing)
    found = rows.unionByName(marks, allowMissingColumns=True).withColumn(name, F.min("_mark").over(w)).where("_mark is null")
    return found.drop("_at", "_mark")
