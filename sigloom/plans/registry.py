"""All queries on signals: name -> (spark, sf_dir) -> DataFrame, and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.operators import VIEWS, Signals
from sigloom.operators.catalog import settled
from sigloom.operators.engines import KERNELS, apply, windowed
from sigloom.plans import formulas, inout, kernel_sql, measures
from sigloom.plans.oracle import CTE, oracle
from sigloom.sources.intake import event_grid, linked_grid, plant_grid

FLAGSHIP = "v_calculus_complete"

#: Some need units that belong together, so they run on the plant's signals; some need signals that drive each other; all others run on the hourly events.
ON_PLANT = {f"v_{n}" for n in "conservation_check mass_balance energy_balance thermodynamic_consistency second_law_check continuity_equation diffusion_check bernoulli_check heat_transfer_check momentum_balance physics_complete".split()}

ON_LINKED = {
    f"v_{n}"
    for n in (
        "optimal_lag lead_lag coupling_network node_degree directional_degree correlation_clusters geometry_complete attractors_all attractors granger_proxy bidirectional_causality causal_roles causal_chains "
        "root_cause_candidates causal_strength causal_graph causality_complete system_causal_structure coupling_summary system_summary export_behavioral_geometry export_causal_mechanics"
    ).split()
}
#: Queries on events tell three groups of users apart.
GROUPS = 3
ON_LINKED.add("e_lead_degrees")
GRIDS = {"events": lambda spark, sf_dir: event_grid(spark, sf_dir, GROUPS), "plant": plant_grid, "linked": linked_grid}


def grid_of(name: str) -> str:
    return "plant" if name in ON_PLANT else "linked" if name in ON_LINKED else "events"


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    grid = GRIDS[grid_of(name)]
    return lambda spark, sf_dir: Signals(grid(spark, sf_dir)).rounded(name)


def _kernel(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        signals = Signals(GRIDS["events"](spark, sf_dir))
        found = windowed(signals, name.removesuffix("_windows")) if name.endswith("_windows") else apply(signals, name)
        if name not in kernel_sql.KERNEL_SQL:
            return found
        return found.select(*[settled(F.col(c)).alias(c) if kind == "double" else F.col(c) for c, kind in kernel_sql.columns(name)])

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _query(name) for name in VIEWS}
QUERIES |= {f"k_{name}": _kernel(name) for name in KERNELS}
QUERIES |= {f"k_{name}": _kernel(name) for name in ("garch_moments_windows", "lyapunov_windows", "wavelet_windows")}
#: All but the JSON texts, whose tables are checked themselves.
ORACLES: dict[str, str] = {name: oracle(name, grid_of(name)) for name in VIEWS if name in CTE}

QUERIES |= formulas.QUERIES | measures.QUERIES | inout.QUERIES
ORACLES |= formulas.ORACLES | measures.ORACLES | kernel_sql.ORACLES | inout.ORACLES
