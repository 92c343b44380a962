"""Engineering formulas as queries: each over all of lineitem, whose columns stand for the inputs, with SQL of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.functions.physics import chemical as C
from sigloom.functions.physics import fluids as U
from sigloom.functions.physics import machines as M
from sigloom.functions.physics import thermal as T
from sigloom.functions.physics import turbines as G
from sigloom.operators.catalog import settled, settled_sql

#: Inputs, in Spark and in SQL alike: temperatures, fractions, a potential, a size and a pressure.
INPUTS = "280 + 4 * l_quantity AS T, 0.05 + 8 * l_discount AS x, 10 * l_tax - 0.4 AS e, l_quantity AS q, l_extendedprice AS p, 1 + l_tax AS r"
RT, FRT = "(8.314462618 * T)", "(96485.33212 / (8.314462618 * T))"


def lit(v: float) -> Column:
    return F.lit(v)


#: name -> (what makes the struct, once there is a session; its fields with SQL over the inputs)
FORMULAS: dict[str, tuple[Callable[[], Column], dict[str, str]]] = {
    "butler_volmer": (lambda: C.butler_volmer("e", 2.0, 0.4, 1, "T"), {"i": f"2 * exp(0.4 * e * {FRT}) - 2 * exp(-0.6 * e * {FRT})", "i_anodic": f"2 * exp(0.4 * e * {FRT})"}),
    "tafel": (lambda: C.tafel("e", 2.0, 0.5, 1, "T"), {"b_anodic": f"ln(10) / (0.5 * {FRT})", "region": "CASE WHEN e >= 0 THEN 'anodic' ELSE 'cathodic' END"}),
    "limiting_current": (lambda: C.limiting_current("q", "r"), {"i": "q / (1 + q / r)", "limitation": "CASE WHEN 1 / (1 + q / r) > 0.9 THEN 'mass_transfer' WHEN 1 / (1 + q / r) < 0.1 THEN 'kinetic' ELSE 'mixed' END"}),
    "mixed_potential": (lambda: C.mixed_potential("e", 0.5, 1e-3, 1e-4, 0.1, 0.12), {"E_corr": "(log10(0.1) + 0.5 / 0.12 + e / 0.1) / (1 / 0.1 + 1 / 0.12)"}),
    "exchange_current_density": (lambda: C.exchange_current_density(1.0, 298.15, "T", 20000), {"i0": "exp(-20000 / 8.314462618 * (1 / T - 1 / 298.15))"}),
    "arrhenius": (lambda: C.arrhenius(1e5, 30000, "T"), {"k": f"1e5 * exp(-30000 / {RT})", "Ea_RT": f"30000 / {RT}"}),
    "arrhenius_two_temperatures": (lambda: C.arrhenius_two_temperatures(1.0, 270, "q", "T"), {"Ea_kJ_mol": "-8.314462618 * ln(q) / (1 / T - 1 / 270.0) / 1000"}),
    "power_law_rate": (lambda: C.power_law_rate(2.0, F.array("x", "r"), F.array(lit(1.0), lit(2.0))), {"rate": "2 * x * r * r", "overall_order": "3.0::DOUBLE"}),
    "michaelis_menten": (lambda: C.michaelis_menten(5.0, "x", "q"), {"rate": "5 * q / (x + q)", "saturation_fraction": "q / (x + q)"}),
    "langmuir_hinshelwood": (lambda: C.langmuir_hinshelwood(1.0, "x", "r", "q", 2.0), {"rate": "x * q * r * 2 / power(1 + x * q + 2 * r, 2)", "vacant_fraction": "1 / (1 + x * q + 2 * r)"}),
    "conversion": (lambda: C.conversion("q", "x"), {"conversion": "(q - x) / q", "moles_reacted": "q - x"}),
    "yield_and_selectivity": (lambda: C.yield_and_selectivity("x", 60.0, "q", "r"), {"selectivity": "x / (x + r)", "conversion": "(60 - q) / 60"}),
    "batch_reactor_time": (lambda: C.batch_reactor_time("q", 0.1, "x", 2), {"time": "x / (0.1 * q * (1 - x))"}),
    "cstr_volume": (lambda: C.cstr_volume("q", "x", 0.1, "r"), {"volume": "q * x / (0.1 * r * (1 - x))", "space_time": "x / (0.1 * (1 - x))"}),
    "pfr_volume": (lambda: C.pfr_volume("q", "x", 0.1, "r"), {"volume": "q * -ln(1 - x) / (0.1 * r)"}),
    "equilibrium_constant": (lambda: C.equilibrium_constant("e", "T"), {"ln_K": f"-e / {RT}", "spontaneous_forward": "e < 0"}),
    "absorption": (lambda: C.absorption("x", 0.01, 0, 1.5, "r"), {"absorption_factor": "1.5 / r", "NTU": "CASE WHEN abs(1.5 / r - 1) < 0.01 THEN (x - 0.01) / 0.01 ELSE ln(x / 0.01 * (1 - r / 1.5) + r / 1.5) / (1 - r / 1.5) END"}),
    "supersaturation": (lambda: C.supersaturation("q", 20.0), {"S": "q / 20", "metastable": "q / 20 > 1 AND q / 20 <= 1.5", "labile": "q / 20 > 1.5"}),
    "crystal_growth": (lambda: C.crystal_growth("x", 10.0, 2.0, 0.5, 1.5), {"B": "10 * x * x", "G": "0.5 * power(x, 1.5)"}),
    "solubility": (lambda: C.solubility("T", 1.0, 0.1, 0.001), {"C_sat": "1 + 0.1 * T + 0.001 * T * T", "dC_dT": "0.1 + 0.002 * T"}),
    "convection": (lambda: T.convection("q", 1.0, 1e-4, 0.7, 0.026, "T", 273.15), {"Re": "q / 1e-4", "Nu": "CASE WHEN q / 1e-4 < 5e5 THEN 0.664 * sqrt(q / 1e-4) * power(0.7, 1 / 3.0) ELSE 0.037 * power(q / 1e-4, 0.8) * power(0.7, 1 / 3.0) END"}),
    "convection_pipe": (lambda: T.convection("q", 1.0, 1e-4, 0.7, 0.026, "T", 273.15, "pipe"), {"Nu": "0.023 * power(q / 1e-4, 0.8) * power(0.7, 0.4)"}),
    "radiation": (lambda: T.radiation("T", 273.15, "x", 0.9), {"heat_flux": "5.670374419e-8 * (power(T, 4) - power(273.15, 4)) / ((1 - x) / x + 1 + (1 - 0.9) / 0.9)"}),
    "heat_exchanger": (lambda: T.heat_exchanger("T", 275.0, 250.0, 260.0, 1000.0, 2000.0, 500.0), {"NTU": "0.5::DOUBLE", "LMTD": "CASE WHEN abs((T - 260) - 25) < 0.01 THEN (T - 260 + 25) / 2 ELSE (T - 285) / ln((T - 260) / 25) END"}),
    "exergy": (lambda: T.exergy("T", 280.0, "p", 900.0, "q", 1.0, "x", 0.0), {"ex_physical": "(q - 1) - 280 * x", "ex_mechanical": "8.314462618 * 280 * ln(p / 900)"}),
    "fugacity": (lambda: T.fugacity("T", "p", "r", 0.3, 0.05), {"fugacity_coeff": "exp(r - 1 - ln(r - 0.05) - 0.3 / (2 * sqrt(2) * 0.05) * ln((r + (1 + sqrt(2)) * 0.05) / (r + (1 - sqrt(2)) * 0.05)))"}),
    "margules": (lambda: T.margules("x", 0.5, 0.8), {"ln_gamma1": "(1 - x) * (1 - x) * (0.5 + 0.6 * x)", "ln_gamma2": "x * x * (0.8 - 0.6 * (1 - x))"}),
    "van_laar": (lambda: T.van_laar("x", 0.5, 0.8), {"ln_gamma1": "0.5 / power(1 + 0.5 * x / (0.8 * (1 - x)), 2)", "ln_gamma2": "0.8 / power(1 + 0.8 * (1 - x) / (0.5 * x), 2)"}),
    "wilson_binary": (lambda: T.wilson_binary("x", 0.5, 0.8), {"ln_gamma1": "-ln(x + 0.5 * (1 - x)) + (1 - x) * (0.5 / (x + 0.5 * (1 - x)) - 0.8 / (0.8 * x + 1 - x))"}),
    "nrtl_binary": (lambda: T.nrtl_binary("x", 0.5, 0.8), {"ln_gamma1": "(1 - x) * (1 - x) * (0.8 * power(exp(-0.24) / (x + (1 - x) * exp(-0.24)), 2) + 0.5 * exp(-0.15) / power(1 - x + x * exp(-0.15), 2))"}),
    "flow_regime": (lambda: F.struct(T.regime(F.col("p") / 10).alias("regime")), {"regime": "CASE WHEN p / 10 < 2300 THEN 'laminar' WHEN p / 10 < 4000 THEN 'transitional' ELSE 'turbulent' END"}),
    "defect_frequencies": (lambda: M.defect_frequencies("q", 8.0, 40.0, 15.0, 1500.0), {"BPFO": "q * 12.5 * (1 - 0.2 * cos(radians(15)))", "BPFI": "q * 12.5 * (1 + 0.2 * cos(radians(15)))", "FTF": "12.5 * (1 - 0.2 * cos(radians(15)))"}),
    "mesh_frequencies": (lambda: M.mesh_frequencies(20.0, "q", 1500.0), {"GMF": "500.0::DOUBLE", "gear_ratio": "q / 20"}),
    "sn_curve": (lambda: M.basquin("q", 900.0, -0.2), {"damage_per_cycle": "2 / power(q / 900, -5)"}),
    "paris_law": (lambda: F.struct(M.paris("q", 1e-3, 3.0).alias("da_dN")), {"da_dN": "1e-3 * power(q, 3)"}),
    "unbalance_response": (lambda: M.unbalance(2.0, 8000.0, 30.0, 1e-3, "q"), {"amplitude": "2e-3 * q * q / sqrt(power(8000 - 2 * q * q, 2) + power(30 * q, 2))", "critical_speed": "sqrt(4000)"}),
    "rotor_stability": (lambda: M.rotor_stability(2.0, 8000.0, "q", 900.0), {"stability_margin": "q * sqrt(4000) - 900", "stable": "q * sqrt(4000) - 900 > 0"}),
    "motor_frequencies": (lambda: M.motor_frequencies(50.0, 4.0, "x"), {"rpm_rotor": "1500 * (1 - x)", "broken_bar_lower": "50 * (1 - 2 * x)"}),
    "impedance_randles": (lambda: M.randles("q", 10.0, 100.0, 1e-3), {"Z_real": "10 + 100 / (1 + power(0.1 * q, 2))", "Z_imag": "-10 * q / (1 + power(0.1 * q, 2))"}),
    "impedance_cpe": (lambda: M.constant_phase("q", 10.0, 100.0, 1e-3, 1.0), {"Z_real": "10 + 100 / (1 + power(0.1 * q, 2))"}),
    "kolmogorov_scales": (lambda: U.scales("x", 1e-4, "r"), {"kolmogorov_time": "sqrt(1e-4 / x)", "taylor_microscale": "sqrt(15e-4 * r / x)"}),
    "reynolds_number": (lambda: U.reynolds("q", 0.1, 1e-3), {"Re": "q * 100", "regime": "CASE WHEN q * 100 < 2300 THEN 'laminar' WHEN q * 100 < 4000 THEN 'transitional' ELSE 'turbulent' END"}),
    "two_phase_flow": (lambda: U.two_phase("x", "r", 1.2, 1000.0, 0.07, 0.05), {"beta": "x / (x + r)", "void_fraction": "x / (1.2 * (x + r) + 1.53 * power(0.07 * 9.81 * 998.8 / 1e6, 0.25))"}),
    "poiseuille": (lambda: F.struct(U.poiseuille("x", 1.0, "q").alias("u")), {"u": "q * 4 * x * (1 - x)"}),
    "compressor_efficiency": (lambda: G.compressor(288.15, F.col("T") + 200, 1e5, "p"), {"efficiency": "288.15 * (power(p / 1e5, 0.4 / 1.4) - 1) / (T + 200 - 288.15)", "pressure_ratio": "p / 1e5"}),
    "turbine_efficiency": (lambda: G.turbine(1400.0, F.col("T") + 600, 1e6, 1e5), {"efficiency": "(1400 - T - 600) / (1400 * (1 - power(10, -0.33 / 1.33)))"}),
    "polytropic_efficiency": (lambda: G.polytropic(288.15, F.col("T") + 200, 1e5, 1e6), {"efficiency": "0.4 / 1.4 * ln(10) / ln((T + 200) / 288.15)"}),
    "polytropic_to_isentropic": (lambda: F.struct(G.polytropic_to_isentropic(0.9, "q").alias("eta_s")), {"eta_s": "CASE WHEN q > 1 THEN (power(q, 0.4 / 1.4) - 1) / (power(q, 0.4 / 1.4 / 0.9) - 1) END"}),
    "corrected_parameters": (lambda: G.corrected("T", 101325.0, "p", "q"), {"N_corrected": "p / sqrt(T / 288.15)", "W_corrected": "q * sqrt(T / 288.15)"}),
    "brayton_cycle": (lambda: G.brayton(288.0, F.col("T") + 300, 1400.0, 800.0, 1e5, 1e6), {"work_net": "1150 * 600 - 1005 * (T + 300 - 288)", "thermal_efficiency": "(1150 * 600 - 1005 * (T + 12)) / (1150 * (1100 - T))"}),
    "brayton_ideal": (lambda: G.brayton_ideal(288.0, 1400.0, F.col("q") + 1), {"thermal_efficiency": "1 - power(q + 1, -0.4 / 1.4)"}),
    "polarization_curve": (lambda: C.polarization_curve("e", 2.0, 0.4, 1, "T", 50.0), {"i": f"(2 * exp(0.4 * e * {FRT}) - 2 * exp(-0.6 * e * {FRT})) / (1 + abs(2 * exp(0.4 * e * {FRT}) - 2 * exp(-0.6 * e * {FRT})) / 50)"}),
    "crack_life": (lambda: M.crack_life("x", 2.0, "q", 1e-3, 3.0), {"N": "(power(2, -0.5) - power(x, -0.5)) / (1e-3 * power(q * sqrt(pi()), 3) * -0.5)", "da_dN_start": "1e-3 * power(q * sqrt(pi() * x), 3)"}),
    "critical_speeds": (lambda: M.critical_speed("r", "p", 900.0, 2500.0), {"natural_frequency": "sqrt(p / r)", "critical_rpm": "sqrt(p / r) * 30 / pi()", "in_range": "sqrt(p / r) * 30 / pi() BETWEEN 900 AND 2500"}),
    "uncorrect_speed": (lambda: F.struct(G.uncorrect_speed("p", "T").alias("N")), {"N": "p * sqrt(T / 288.15)"}),
    "uncorrect_flow": (lambda: F.struct(G.uncorrect_flow("q", "T", "p").alias("W")), {"W": "q * p / 101325 / sqrt(T / 288.15)"}),
    "isentropic_to_polytropic": (lambda: F.struct(G.isentropic_to_polytropic(0.85, F.col("q") + 1).alias("eta_p")), {"eta_p": "0.4 / 1.4 * ln(q + 1) / ln((power(q + 1, 0.4 / 1.4) - 1) / 0.85 + 1)"}),
}


def _query(name: str):
    struct, fields = FORMULAS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_orderkey", "l_linenumber", *INPUTS.split(", "))
        made = F.when(F.col("q") > 1, struct()) if name == "polytropic_to_isentropic" else struct()
        found = rows.select("l_orderkey", "l_linenumber", made.alias("f"))
        kinds = dict(found.select("f.*").dtypes)
        return found.select("l_orderkey", "l_linenumber", *[(settled(F.col(f"f.{k}")) if kinds[k] == "double" else F.col(f"f.{k}")).alias(k) for k in fields])

    return run


def _sql(name: str) -> str:
    labels = ("region", "limitation", "regime", "metastable", "labile", "stable", "spontaneous_forward", "in_range")
    fields = FORMULAS[name][1]
    raw = ", ".join(f"{v} AS {k}" if k in labels else f"CAST({v} AS DOUBLE) AS {k}" for k, v in fields.items())
    columns = ", ".join(k if k in labels else f"{settled_sql(k)} AS {k}" for k in fields)
    return f"SELECT l_orderkey, l_linenumber, {columns} FROM (SELECT l_orderkey, l_linenumber, {raw} FROM (SELECT l_orderkey, l_linenumber, {INPUTS} FROM lineitem))"


QUERIES = {f"f_{name}": _query(name) for name in FORMULAS}
ORACLES = {f"f_{name}": _sql(name) for name in FORMULAS}
