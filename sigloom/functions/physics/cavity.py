"""The lid-driven cavity: published centreline velocities, as a lookup and as a check of computed profiles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from sigloom.functions.physics.fluids import profile_error

# U. Ghia, K. N. Ghia and C. T. Shin (1982), table I, u along the vertical centreline at these y.
U_AT = [1.0000, 0.9766, 0.9688, 0.9609, 0.9531, 0.8516, 0.7344, 0.6172, 0.5000, 0.4531, 0.2813, 0.1719, 0.1016, 0.0703, 0.0625, 0.0547, 0.0000]
U = {
    100: [1.00000, 0.84123, 0.78871, 0.73722, 0.68717, 0.23151, 0.00332, -0.13641, -0.20581, -0.21090, -0.15662, -0.10150, -0.06434, -0.04775, -0.04192, -0.03717, 0.00000],
    400: [1.00000, 0.75837, 0.68439, 0.61756, 0.55892, 0.29093, 0.16256, 0.02135, -0.11477, -0.17119, -0.32726, -0.24299, -0.14612, -0.10338, -0.09266, -0.08186, 0.00000],
    1000: [1.00000, 0.65928, 0.57492, 0.51117, 0.46604, 0.33304, 0.18719, 0.05702, -0.06080, -0.10648, -0.27805, -0.38289, -0.29730, -0.22220, -0.20196, -0.18109, 0.00000],
    3200: [1.00000, 0.53236, 0.48296, 0.46547, 0.46101, 0.34682, 0.19791, 0.07156, -0.04272, -0.08664, -0.24427, -0.34323, -0.41933, -0.37827, -0.35344, -0.32407, 0.00000],
    5000: [1.00000, 0.48223, 0.46120, 0.45992, 0.46036, 0.33556, 0.20087, 0.08183, -0.03039, -0.07404, -0.22855, -0.33050, -0.40435, -0.43643, -0.42901, -0.41165, 0.00000],
    7500: [1.00000, 0.47244, 0.47048, 0.47323, 0.47167, 0.34228, 0.20591, 0.08342, -0.03800, -0.07503, -0.23176, -0.32393, -0.38324, -0.43025, -0.43590, -0.43154, 0.00000],
    10000: [1.00000, 0.47221, 0.47783, 0.48070, 0.47804, 0.34635, 0.20673, 0.08344, 0.03111, -0.07540, -0.23186, -0.32709, -0.38000, -0.41657, -0.42537, -0.42735, 0.00000],
}
# Table II of the same paper, v along the horizontal centreline at these x.
V_AT = [1.0000, 0.9688, 0.9609, 0.9531, 0.9453, 0.9063, 0.8594, 0.8047, 0.5000, 0.2344, 0.2266, 0.1563, 0.0938, 0.0781, 0.0703, 0.0625, 0.0000]
V = {
    100: [0.00000, -0.05906, -0.07391, -0.08864, -0.10313, -0.16914, -0.22445, -0.24533, 0.05454, 0.17527, 0.17507, 0.16077, 0.12317, 0.10890, 0.10091, 0.09233, 0.00000],
    400: [0.00000, -0.12146, -0.15663, -0.19254, -0.22847, -0.23827, -0.44993, -0.38598, 0.05186, 0.30174, 0.30203, 0.28124, 0.22965, 0.20920, 0.19713, 0.18360, 0.00000],
    1000: [0.00000, -0.21388, -0.27669, -0.33714, -0.39188, -0.51550, -0.42665, -0.31966, 0.02526, 0.32235, 0.33075, 0.37095, 0.32627, 0.30353, 0.29012, 0.27485, 0.00000],
    3200: [0.00000, -0.39017, -0.47425, -0.52357, -0.54053, -0.44307, -0.37401, -0.31184, 0.00999, 0.28188, 0.29030, 0.37119, 0.42768, 0.41906, 0.40917, 0.39560, 0.00000],
    5000: [0.00000, -0.42735, -0.51060, -0.55216, -0.55674, -0.41496, -0.36737, -0.30719, 0.00945, 0.27280, 0.28066, 0.35368, 0.42951, 0.43648, 0.43329, 0.42447, 0.00000],
}


def profile(Re: int, component: str = "u") -> tuple[np.ndarray, np.ndarray]:
    table, at = (U, U_AT) if component == "u" else (V, V_AT)
    if Re not in table:
        raise ValueError(f"no profile for Re={Re}; there are {sorted(table)}")
    return np.array(at), np.array(table[Re])


def lookup(spark: SparkSession) -> DataFrame:
    """All profiles as rows, to be joined with computed ones."""
    rows = [(n, re, x, v) for n, table, at in (("u", U, U_AT), ("v", V, V_AT)) for re, values in table.items() for x, v in zip(at, values)]
    return spark.createDataFrame(rows, "component string, Re int, position double, velocity double")


def check(y, u, Re: int, tolerance: float = 0.05) -> dict:
    """A computed u profile against the table, at the table's places."""
    at, want = profile(Re)
    order = np.argsort(y)
    return {"Re": Re, **profile_error(np.asarray(y)[order], np.asarray(u)[order], at, want, tolerance)}
