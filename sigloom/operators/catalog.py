"""Named operators over one table of observations; each is built once, from the others, as a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

KEY = ["entity_id", "signal_id"]
#: Where results are compared: places of numbers below 1, digits of others, and what keeps decimals that end in 5 off a border.
PLACES, DIGITS, SHIFT = 9, 9, 1.7e-11
VIEWS: dict[str, tuple[Callable[[Signals], DataFrame], list[str]]] = {}


def by_index(*more: str) -> W:
    """The series of each signal, in order of its index."""
    return W.partitionBy(*KEY, *more).orderBy("I")


def settled(x: Column) -> Column:
    """A real number as results are compared: PLACES below 1, DIGITS above, so that the order of a summation does not show."""
    x = x.cast("double")
    small = F.round(x + SHIFT, PLACES) + 0.0
    return F.when(F.abs(x) < 1, small).otherwise(F.format_string(f"%.{DIGITS - 1}e", x * (1 + SHIFT)).try_cast("double"))


def settled_sql(x: str) -> str:
    """The same in the SQL that a query is checked against."""
    return f"CASE WHEN abs({x}) < 1 THEN round({x} + {SHIFT}, {PLACES}) + 0.0 ELSE CAST(format('{{:.{DIGITS - 1}e}}', {x} * (1 + {SHIFT})) AS DOUBLE) END"


def view(columns: str, name: str | None = None):
    """Registers an operator under its name with its columns; ~ marks those that are rounded when results are compared."""

    def register(f: Callable[[Signals], DataFrame]) -> Callable[[Signals], DataFrame]:
        VIEWS[name or f"v_{f.__name__}"] = (f, columns.split())
        return f

    return register


class Signals:
    """Observations and everything derived from them. primitives: hurst, lyapunov and the like by signal, where known."""

    def __init__(self, observations: DataFrame, primitives: DataFrame | None = None):
        self.observations, self.primitives = observations, primitives
        self.made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        """All columns that the operator makes."""
        if name not in self.made:
            self.made[name] = VIEWS[name][0](self)
        return self.made[name]

    def table(self, name: str) -> DataFrame:
        """The operator's columns as declared."""
        return self[name].select(*[c.lstrip("~") for c in VIEWS[name][1]])

    def rounded(self, name: str) -> DataFrame:
        """The same with real numbers settled for comparison."""
        return self[name].select(*[settled(F.col(c[1:])).alias(c[1:]) if c[0] == "~" else F.col(c) for c in VIEWS[name][1]])
