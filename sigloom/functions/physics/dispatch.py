"""One way in for each field of engineering: compute(field, method, ...) calls a formula or a routine by its name."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from sigloom.functions.physics import chemical, columns, control, fluids, machines, thermal, turbines

FIELDS: dict[str, dict[str, Callable]] = {
    "electrochemistry": {n: getattr(chemical, n) for n in ("butler_volmer", "tafel", "limiting_current", "mixed_potential", "exchange_current_density", "polarization_curve")},
    "kinetics": {n: getattr(chemical, n) for n in ("arrhenius", "arrhenius_two_temperatures", "power_law_rate", "michaelis_menten", "langmuir_hinshelwood", "conversion", "yield_and_selectivity", "equilibrium_constant")},
    "reactors": {n: getattr(chemical, n) for n in ("batch_reactor_time", "cstr_volume", "pfr_volume", "residence_time", "batch_reactor", "cstr", "pfr", "nonisothermal_batch")},
    "separations": {n: getattr(chemical, n) for n in ("absorption", "distillation_stages")} | {"shortcut_column": thermal.shortcut_column, "tray": columns.tray, "column": columns.simulate, "bubble_point": thermal.bubble_point, "dew_point": thermal.dew_point},
    "crystallization": {n: getattr(chemical, n) for n in ("solubility", "supersaturation", "crystal_growth", "moments")} | {"batch_cooling": columns.cooling_crystalliser},
    "kalman": {"filter": control.filter_sequence, "smoother": control.smooth, "noise": control.noise},
    "stability": {"routh": control.routh, "nyquist": control.nyquist, "lyapunov": control.lyapunov_equation, "place": control.place, "margins": control.margins},
    "transfer_function": {"frequency": control.frequency_response, "step": control.step_response, "impulse": control.impulse_response, "poles": control.poles_zeros, "arx": control.arx},
    "impedance": {"randles": machines.randles, "cpe": machines.constant_phase, "fit": machines.fit_randles, "nyquist": machines.nyquist_features, "bode": machines.bode_features},
    "motor": {n: getattr(machines, n) for n in ("motor_frequencies", "broken_rotor_bar", "eccentricity", "bearing_fault_current")},
    "power_quality": {n: getattr(machines, n) for n in ("harmonics", "power_factor", "voltage_events", "flicker")},
    "bearing": {n: getattr(machines, n) for n in ("defect_frequencies", "envelope_spectrum", "condition_indicators", "spectral_kurtosis")},
    "fatigue": {n: getattr(machines, n) for n in ("basquin", "strain_life", "rainflow", "miner", "paris", "crack_life")},
    "gear": {"mesh_frequencies": machines.mesh_frequencies, "sidebands": machines.sidebands, "synchronous_average": machines.synchronous_average, "indicators": machines.gear_indicators},
    "rotor": {"critical_speed": machines.critical_speed, "unbalance": machines.unbalance, "orbit": machines.orbit, "stability": machines.rotor_stability},
    "modal": {"modes": machines.modal, "participation": machines.participation, "response": machines.receptance},
    "activity": {n: getattr(thermal, n) for n in ("ideal", "margules", "van_laar", "wilson", "wilson_binary", "nrtl", "nrtl_binary", "uniquac")},
    "equilibrium": {"flash": thermal.flash, "vle": thermal.vle, "equation_of_state": thermal.cubic, "fugacity": thermal.fugacity},
    "heat": {n: getattr(thermal, n) for n in ("convection", "radiation", "heat_exchanger", "exergy", "heat_equation", "stefan")},
    "flow": {n: getattr(fluids, n) for n in ("scales", "reynolds", "two_phase", "poiseuille", "analysis", "turbulence", "spectrum")},
    "turbomachinery": {n: getattr(turbines, n) for n in ("compressor", "turbine", "polytropic", "corrected", "brayton", "brayton_ideal", "compressor_from_signals", "turbine_from_signals", "analyse_turbofan")},
}


def compute(field: str, method: str, *args: Any, **how: Any) -> Any:
    """What the method returns: columns for formulas, a dict for routines, a DataFrame for measures of tables."""
    if field not in FIELDS:
        raise ValueError(f"no such field: {field!r}; there are {sorted(FIELDS)}")
    if method not in FIELDS[field]:
        raise ValueError(f"no such method of {field}: {method!r}; there are {sorted(FIELDS[field])}")
    return FIELDS[field][method](*args, **how)
