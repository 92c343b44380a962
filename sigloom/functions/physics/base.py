"""Shared by the formula modules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Value = Column | str | float | int
R, FARADAY, SIGMA, GRAVITY = 8.314462618, 96485.33212, 5.670374419e-8, 9.80665


def c(x: Value) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def out(**named: Value) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in named.items()])


def over(a: Value, b: Value) -> Column:
    return F.try_divide(c(a).cast("double"), c(b).cast("double"))


def pick(*cases: tuple[Column, Value], other: Value | str | None = None) -> Column:
    """The first case that holds; strings are labels here, not columns."""
    value = lambda v: v if isinstance(v, Column) else F.lit(v)
    made = F.when(cases[0][0], value(cases[0][1]))
    for when, then in cases[1:]:
        made = made.when(when, value(then))
    return made.otherwise(value(other))
