"""Column helpers that behave alike in Spark (ANSI on) and in the SQL the queries are checked against."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Name = Column | str


def col(x: Name) -> Column:
    return F.col(x) if isinstance(x, str) else x


def div(a: Name, b: Name) -> Column:
    """a / b; null where b is 0."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def corr(a: Name, b: Name) -> Column:
    """Pearson correlation over rows that have both; null where a side does not vary."""
    a, b = col(a), col(b)
    both = a.isNotNull() & b.isNotNull()
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b)))


def share(condition: Column, of: Column | None = None) -> Column:
    """The share of rows for which the condition holds."""
    return div(F.sum(F.when(condition, 1).otherwise(0)), of if of is not None else F.count(F.lit(1)))


def flag(condition: Column) -> Column:
    """true or false; unknown is false."""
    return F.coalesce(condition, F.lit(False))


def entropy_term(p: Name) -> Column:
    return col(p) * F.ln(col(p) + F.lit(1e-10))


def skewness(x: Name) -> Column:
    """Corrected for bias, as sample skewness."""
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / F.greatest(n - 2, F.lit(1.0)))


def kurtosis(x: Name) -> Column:
    """Excess, corrected for bias."""
    n = F.count(x).cast("double")
    return F.when(n > 3, ((n + 1) * F.kurtosis(x) + 6) * (n - 1) / (F.greatest(n - 2, F.lit(1.0)) * F.greatest(n - 3, F.lit(1.0))))
