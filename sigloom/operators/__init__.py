"""Operators: DataFrame in, DataFrame out. Importing this package registers all of them by name."""

from sigloom.operators import balance, calculus, causality, classification, dynamics, engines, entropy, geometry, manifold, modes, primitives, statistics, typology
from sigloom.operators.catalog import VIEWS, Signals

__all__ = ["VIEWS", "Signals", "balance", "calculus", "causality", "classification", "dynamics", "engines", "entropy", "geometry", "manifold", "modes", "primitives", "statistics", "typology"]
