"""Compressors, turbines and gas turbine cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sigloom.functions.physics.base import Value, c, out, over

T_STD, P_STD = 288.15, 101325.0
RANKINE, PSIA = 5 / 9, 6894.76


def _judged(efficiency: Column, **more: Column) -> Column:
    """With a confidence that shrinks and warnings for values that cannot be right."""
    e = efficiency
    cases = [(e > 1, 0.3, "impossible"), ((e > 0.95) & (e <= 1), 0.8, "very_high"), (e < 0, 0.1, "negative"), ((e >= 0) & (e < 0.5), 0.7, "low")]
    sure = F.lit(1.0)
    for when, factor, _ in cases:
        sure = sure * F.when(when, factor).otherwise(1.0)
    return out(efficiency=e, confidence=sure, warnings=F.filter(F.array(*[F.when(when, name) for when, _, name in cases]), lambda x: x.isNotNull()), **more)


def compressor(T1: Value, T2: Value, P1: Value, P2: Value, gamma: Value = 1.4, cp: Value = 1005) -> Column:
    ratio = c(P2) / c(P1)
    ideal = c(T1) * F.pow(ratio, (c(gamma) - 1) / c(gamma))
    return _judged(over(ideal - c(T1), c(T2) - c(T1)), pressure_ratio=ratio, temperature_ratio=c(T2) / c(T1), T_ideal=ideal, work_actual=c(cp) * (c(T2) - c(T1)), work_ideal=c(cp) * (ideal - c(T1)))


def turbine(T3: Value, T4: Value, P3: Value, P4: Value, gamma: Value = 1.33, cp: Value = 1150) -> Column:
    ratio = c(P3) / c(P4)
    ideal = c(T3) * F.pow(ratio, -(c(gamma) - 1) / c(gamma))
    return _judged(over(c(T3) - c(T4), c(T3) - ideal), expansion_ratio=ratio, temperature_ratio=c(T4) / c(T3), T_ideal=ideal, work_actual=c(cp) * (c(T3) - c(T4)), work_ideal=c(cp) * (c(T3) - ideal))


def polytropic(T1: Value, T2: Value, P1: Value, P2: Value, gamma: Value = 1.4) -> Column:
    """Compression where the pressure rises, else expansion."""
    k = (c(gamma) - 1) / c(gamma)
    p, t = F.ln(c(P2) / c(P1)), F.ln(c(T2) / c(T1))
    return _judged(F.when(p > 0, over(k * p, t)).otherwise(over(t, k * p)), pressure_ratio=c(P2) / c(P1))


def polytropic_to_isentropic(eta: Value, ratio: Value, gamma: Value = 1.4, expansion: bool = False) -> Column:
    k, r, e = (c(gamma) - 1) / c(gamma), c(ratio), c(eta)
    return (1 - F.pow(r, -k * e)) / (1 - F.pow(r, -k)) if expansion else (F.pow(r, k) - 1) / (F.pow(r, k / e) - 1)


def isentropic_to_polytropic(eta: Value, ratio: Value, gamma: Value = 1.4, expansion: bool = False) -> Column:
    """In closed form, the other way round."""
    k, r, e = (c(gamma) - 1) / c(gamma), c(ratio), c(eta)
    return -F.ln(1 - e * (1 - F.pow(r, -k))) / (k * F.ln(r)) if expansion else k * F.ln(r) / F.ln((F.pow(r, k) - 1) / e + 1)


def corrected(T: Value, P: Value, speed: Value, flow: Value, fuel: Value = 0, thrust: Value = 0) -> Column:
    theta, delta = c(T) / T_STD, c(P) / P_STD
    return out(theta=theta, delta=delta, N_corrected=c(speed) / F.sqrt(theta), W_corrected=c(flow) * F.sqrt(theta) / delta, fuel_corrected=c(fuel) / (delta * F.sqrt(theta)), thrust_corrected=c(thrust) / delta)


def uncorrect_speed(N: Value, T: Value) -> Column:
    return c(N) * F.sqrt(c(T) / T_STD)


def uncorrect_flow(flow: Value, T: Value, P: Value) -> Column:
    return c(flow) * (c(P) / P_STD) / F.sqrt(c(T) / T_STD)


def brayton(T1: Value, T2: Value, T3: Value, T4: Value, P1: Value, P2: Value, g_cold: Value = 1.4, g_hot: Value = 1.33, cp_cold: Value = 1005, cp_hot: Value = 1150) -> Column:
    """Five per cent of the pressure is taken to be lost in the combustor and in the exhaust."""
    ratio = c(P2) / c(P1)
    ideal2 = c(T1) * F.pow(ratio, (c(g_cold) - 1) / c(g_cold))
    ideal4 = c(T3) * F.pow(ratio * 0.95 * 0.95, -(c(g_hot) - 1) / c(g_hot))
    inn, work, heat = c(cp_cold) * (c(T2) - c(T1)), c(cp_hot) * (c(T3) - c(T4)), c(cp_hot) * (c(T3) - c(T2))
    return out(pressure_ratio=ratio, compressor_efficiency=over(ideal2 - c(T1), c(T2) - c(T1)), turbine_efficiency=over(c(T3) - c(T4), c(T3) - ideal4), work_compressor=inn, work_turbine=work, work_net=work - inn, heat_in=heat, thermal_efficiency=over(work - inn, heat), back_work_ratio=over(inn, work))


def brayton_ideal(T1: Value, T3: Value, ratio: Value, gamma: Value = 1.4, cp: Value = 1005) -> Column:
    x = F.pow(c(ratio), (c(gamma) - 1) / c(gamma))
    return out(T2=c(T1) * x, T4=c(T3) / x, thermal_efficiency=1 - 1 / x, work_net=c(cp) * (c(T3) * (1 - 1 / x) - c(T1) * (x - 1)))


def capabilities(signals: set[str], constants: set[str], needs: dict[str, tuple[set[str], set[str]]]) -> dict[str, dict]:
    """For each analysis, whether its signals and constants are there, and which are not."""
    return {k: {"available": s <= signals and q <= constants, "missing_signals": sorted(s - signals), "missing_constants": sorted(q - constants)} for k, (s, q) in needs.items()}


# ---------------------------------------------------------------- on tables of signals

#: The columns of the turbofan data that the efficiencies need: temperatures in Rankine, pressures in psia.
TURBOFAN = {"T1": "T2", "T2": "T30", "P1": "P2", "P2": "P30", "T4": "T50"}


def compressor_from_signals(df: DataFrame, T1: str, T2: str, P1: str, P2: str, rankine: bool = False, psia: bool = False, gamma: float = 1.4) -> DataFrame:
    """The compressor's measures beside the rows of a wide table; temperatures and pressures in other units are converted."""
    t, p = RANKINE if rankine else 1.0, PSIA if psia else 1.0
    return df.withColumn("compressor", compressor(F.col(T1) * t, F.col(T2) * t, F.col(P1) * p, F.col(P2) * p, gamma)).select(*df.columns, "compressor.*")


def turbine_from_signals(df: DataFrame, T3: str, T4: str, P3: str, P4: str, rankine: bool = False, psia: bool = False, gamma: float = 1.33) -> DataFrame:
    t, p = RANKINE if rankine else 1.0, PSIA if psia else 1.0
    return df.withColumn("turbine", turbine(F.col(T3) * t, F.col(T4) * t, F.col(P3) * p, F.col(P4) * p, gamma)).select(*df.columns, "turbine.*")


def analyse_turbofan(df: DataFrame, unit: str = "unit_id", cycle: str = "cycle", names: dict[str, str] = TURBOFAN) -> DataFrame:
    """For each engine: its cycles, mean compressor efficiency, that of the first and last tenth of its life, and the trend."""
    made = compressor_from_signals(df, names["T1"], names["T2"], names["P1"], names["P2"], True, True)
    last = F.max(F.col(cycle)).over(W.partitionBy(unit))
    made = made.withColumn("life", F.col(cycle) / last)
    m = made.groupBy(unit).agg(
        F.max(cycle).alias("n_cycles"), F.avg("efficiency").alias("mean_efficiency"), F.avg(F.when(F.col("life") <= 0.1, F.col("efficiency"))).alias("early_efficiency"),
        F.avg(F.when(F.col("life") > 0.9, F.col("efficiency"))).alias("late_efficiency"), F.regr_slope("efficiency", cycle).alias("trend"),
    )
    return m.withColumn("degradation", F.col("early_efficiency") - F.col("late_efficiency"))
