"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm import common as C


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, component (its smallest node) of each node that has an edge (columns a and b, of type long)."""
    now = C.materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(most):
        after = C.materialise(_small(_large(now)).distinct(), "edges")
        state = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1000003)).first()
        C.discard(now)
        now = after
        if tuple(state) == mark:
            roots = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        mark = tuple(state)
    raise RuntimeError("components did not settle")
