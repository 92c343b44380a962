"""DuckDB SQL that the queries on signals are checked against, written apart from them as common table expressions."""

from __future__ import annotations

import re

from sigloom.operators import VIEWS
from sigloom.operators.catalog import settled_sql
from sigloom.sources.intake import ANALOG_UNITS, DIGITAL_UNITS, EVENT_UNITS, EVENT_UNITS_BY_SIGNAL, LINKED, PLANT, STEPWISE_UNITS

K = "entity_id, signal_id"
W = "(PARTITION BY entity_id, signal_id ORDER BY I)"


def quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def corr(a: str, b: str) -> str:
    both = f"({a}) IS NOT NULL AND ({b}) IS NOT NULL"
    return f"(covar_pop({a}, {b}) / nullif(stddev_pop(CASE WHEN {both} THEN {a} END) * stddev_pop(CASE WHEN {both} THEN {b} END), 0))"


def div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0))"


def ent(p: str) -> str:
    return f"-sum({p} * ln({p} + 1e-10))"


def skew(x: str) -> str:
    return f"CASE WHEN count({x}) > 2 THEN skewness({x}) END"


def kurt(x: str) -> str:
    return f"CASE WHEN count({x}) > 3 THEN kurtosis({x}) END"


EVENTS = f"""SELECT 'g' || (user_id % 3) AS entity_id, event_type AS signal_id, CAST(epoch_us(ts) // 3600000000 - 473352 AS DOUBLE) AS I,
  CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS y,
  CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_UNITS_BY_SIGNAL.items())} END AS unit, 'time' AS dimension FROM events GROUP BY 1, 2, 3"""
PLANT_SQL = " UNION ALL ".join(
    f"SELECT l_returnflag AS entity_id, '{s}' AS signal_id, CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS I, "
    f"CAST(sum({e}) AS DOUBLE) / count(*) AS y, '{u}' AS unit, '{d}' AS dimension FROM lineitem GROUP BY 1, 3"
    for s, (e, u, d) in PLANT.items()
)
WEEKS = "SELECT l_returnflag AS entity_id, date_diff('day', DATE '1992-01-06', CAST(l_shipdate AS DATE)) // 7 AS week, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS q, CAST(count(*) % 4 AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2"
LINKED_SQL = " UNION ALL ".join(f"SELECT entity_id, '{s}' AS signal_id, CAST(week + {k} AS DOUBLE) AS I, {e} AS y, '{u}' AS unit, 'time' AS dimension FROM ({WEEKS})" for s, (e, k, u) in LINKED.items())
GRIDS = {"events": EVENTS, "plant": PLANT_SQL, "linked": LINKED_SQL}


def _mean(table: str, value: str, mean: str, z: str) -> str:
    """The table with an entity's mean of a value and the value's distance from it in deviations."""
    return f"SELECT t.*, m.{mean}, {div(f't.{value} - m.{mean}', 'm.sd')} AS {z} FROM {table} t JOIN (SELECT entity_id, avg({value}) AS {mean}, stddev({value}) AS sd FROM {table} GROUP BY 1) m USING (entity_id)"


STABILITY = "CASE WHEN dy > 0 AND d2y < 0 THEN 'converging_up' WHEN dy < 0 AND d2y > 0 THEN 'converging_down' WHEN dy > 0 AND d2y > 0 THEN 'diverging_up' WHEN dy < 0 AND d2y < 0 THEN 'diverging_down' ELSE 'neutral' END"
DIVERGENCE = "CASE WHEN d2y > 0.1 THEN 'expanding' WHEN d2y < -0.1 THEN 'contracting' ELSE 'stable' END"
AB = "entity_id, signal_a, signal_b"

CTE: dict[str, str] = {
    "v_base": "SELECT * FROM obs",
    "one": f"SELECT *, (lead(y) OVER {W} - lag(y) OVER {W}) / 2.0 AS dy, lead(y) OVER {W} - 2 * y + lag(y) OVER {W} AS d2y FROM obs",
    "v_points": f"SELECT *, (lead(d2y) OVER {W} - lag(d2y) OVER {W}) / 2.0 AS d3y, abs(d2y) / power(1 + dy * dy + 1e-10, 1.5) AS kappa FROM one",
    "v_dy": "SELECT * FROM v_points", "v_d2y": "SELECT * FROM v_points", "v_d3y": "SELECT * FROM v_points", "v_curvature": "SELECT * FROM v_points WHERE kappa IS NOT NULL",
    "v_laplacian": "SELECT *, d2y AS laplacian FROM v_points", "v_gradient": "SELECT *, abs(dy) AS gradient_magnitude FROM v_points",
    "v_arc_length": f"SELECT *, sqrt(1 + dy * dy) AS segment_length, sum(sqrt(1 + coalesce(dy * dy, 0))) OVER (PARTITION BY {K} ORDER BY I ROWS UNBOUNDED PRECEDING) AS arc_length_cumulative FROM v_points",
    "v_velocity": "SELECT *, dy AS velocity, abs(dy) AS speed, d2y AS acceleration, abs(d2y) AS acceleration_magnitude FROM v_points",
    "v_divergence": f"SELECT *, d2y AS divergence, {DIVERGENCE} AS divergence_state FROM v_points",
    "v_smoothness": "SELECT *, CASE WHEN abs(dy) > 1e-10 THEN abs(d2y) / abs(dy) END AS roughness_index, CASE WHEN abs(dy) > 1e-10 THEN abs(dy) / (abs(d2y) + 1e-10) END AS smoothness_index FROM v_points",
    "v_calculus_complete": f"SELECT c.*, l.laplacian, g.gradient_magnitude, a.arc_length_cumulative, r.roughness_index, r.smoothness_index, d.divergence, d.divergence_state FROM v_curvature c LEFT JOIN v_laplacian l USING ({K}, I) LEFT JOIN v_gradient g USING ({K}, I) LEFT JOIN v_arc_length a USING ({K}, I) LEFT JOIN v_smoothness r USING ({K}, I) LEFT JOIN v_divergence d USING ({K}, I)",
    "v_schema_validation": "SELECT count(*) AS n_rows, count(DISTINCT entity_id) AS n_entities, count(DISTINCT signal_id) AS n_signals, min(I) AS I_min, max(I) AS I_max, CASE WHEN count(*) = 0 THEN 'ERROR: No data' WHEN count(DISTINCT signal_id) = 0 THEN 'ERROR: No signals' ELSE 'OK' END AS validation_status FROM obs",
    "v_signal_inventory": f"SELECT {K}, unit, dimension, count(*) AS n_points, min(I) AS I_min, max(I) AS I_max, min(y) AS y_min, max(y) AS y_max, avg(y) AS y_mean FROM obs GROUP BY ALL",
    "v_data_quality": "SELECT *, n_points < 50 AS insufficient_data, coalesce(y_min = y_max, false) AS constant_signal, y_min IS NULL OR y_max IS NULL AS has_nulls FROM v_signal_inventory",
    # statistics
    "v_stats_global": f"SELECT {K}, count(*) AS n_points, min(y) AS y_min, max(y) AS y_max, max(y) - min(y) AS y_range, avg(y) AS y_mean, stddev(y) AS y_std, variance(y) AS y_var, quantile_cont(y, 0.25) AS y_q1, quantile_cont(y, 0.5) AS y_median, quantile_cont(y, 0.75) AS y_q3, quantile_cont(y, 0.75) - quantile_cont(y, 0.25) AS y_iqr FROM obs GROUP BY ALL",
    "v_derivative_stats": f"SELECT {K}, " + ", ".join(f"avg(abs({c})) AS {c}_mean_abs, stddev({c}) AS {c}_std, quantile_cont(abs({c}), 0.5) AS {c}_median_abs, quantile_cont(abs({c}), 0.95) AS {c}_p95_abs" for c in ("dy", "d2y")) + " FROM v_curvature GROUP BY ALL",
    "v_zscore": f"SELECT *, CASE WHEN abs(z_score) > 3 THEN 'extreme' WHEN abs(z_score) > 2 THEN 'outlier' ELSE 'normal' END AS z_category FROM (SELECT b.*, {div('b.y - y_mean', 'y_std')} AS z_score FROM obs b JOIN v_stats_global USING ({K}))",
    "v_derivative_anomaly": f"SELECT *, abs(dy) > 3 * dy_median_abs AS dy_anomaly, abs(d2y) > 3 * d2y_median_abs AS d2y_anomaly, {div('abs(dy)', 'dy_median_abs')} + {div('abs(d2y)', 'd2y_median_abs')} AS anomaly_score FROM v_curvature JOIN v_derivative_stats USING ({K})",
    "v_local_extrema": f"SELECT *, CASE WHEN dy > 0 AND dy_prev < 0 THEN 'valley' WHEN dy < 0 AND dy_prev > 0 THEN 'peak' END AS extrema_type FROM (SELECT *, lag(dy) OVER {W} AS dy_prev FROM v_points WHERE dy IS NOT NULL)",
    "v_trend": f"SELECT *, CASE WHEN dy > 0.001 THEN 'up' WHEN dy < -0.001 THEN 'down' ELSE 'flat' END AS trend_direction, {div('abs(d2y)', 'abs(dy)')} AS trend_acceleration FROM v_points",
    "v_volatility_proxy": f"SELECT *, abs(d2y) AS instantaneous_volatility, kappa AS curvature_volatility, {div('abs(d2y)', 'd2y_median_abs')} AS relative_volatility FROM v_curvature JOIN v_derivative_stats USING ({K})",
    "v_autocorrelation": f"SELECT {K}, {', '.join(f'{corr('y', f'l{k}')} AS acf_lag{k}' for k in (1, 5, 10))} FROM (SELECT *, {', '.join(f'lag(y, {k}) OVER {W} AS l{k}' for k in (1, 5, 10))} FROM obs) WHERE l10 IS NOT NULL GROUP BY ALL",
    "v_statistics_complete": f"SELECT * FROM v_stats_global LEFT JOIN v_derivative_stats USING ({K}) LEFT JOIN v_autocorrelation USING ({K})",
    "v_rolling_stats": f"SELECT *, avg(y) OVER r AS rolling_mean, stddev(y) OVER r AS rolling_std, min(y) OVER r AS rolling_min, max(y) OVER r AS rolling_max FROM obs WINDOW r AS (PARTITION BY {K} ORDER BY I ROWS BETWEEN 50 PRECEDING AND CURRENT ROW)",
    "v_skewness_kurtosis": f"SELECT {K}, {skew('y')} AS y_skewness, {kurt('y')} AS y_kurtosis FROM obs GROUP BY ALL",
    "v_runs_test": f"SELECT *, {div('n_runs - mu', f'sqrt({div('(mu - 1) * (mu - 2)', 'n_above + n_below - 1')})')} AS runs_z FROM (SELECT *, 2.0 * n_above * n_below / (n_above + n_below) + 1 AS mu FROM (SELECT {K}, count(*) FILTER (above IS DISTINCT FROM before) AS n_runs, count(*) FILTER (above) AS n_above, count(*) FILTER (NOT above) AS n_below FROM (SELECT *, lag(above) OVER {W} AS before FROM (SELECT o.*, y > y_median AS above FROM obs o JOIN v_stats_global USING ({K}) WHERE y <> y_median)) GROUP BY ALL))",
    # classification
    "v_class_from_units": f"SELECT DISTINCT {K}, unit, CASE WHEN unit IN ({quoted(ANALOG_UNITS)}) THEN 'analog' WHEN unit IN ({quoted(DIGITAL_UNITS)}) THEN 'digital' WHEN unit IN ({quoted(EVENT_UNITS)}) THEN 'event' ELSE 'unknown' END AS unit_class, NOT coalesce(unit IN ({quoted(STEPWISE_UNITS)}), false) AS interpolation_valid_from_unit FROM obs",
    "v_class_continuity": f"SELECT *, {div('n_fine', 'n')} AS unique_ratio, {div('n_distinct_values', 'value_range')} AS values_per_range FROM (SELECT {K}, count(*) AS n, count(DISTINCT floor(y * 10000 + 0.5)) AS n_fine, count(DISTINCT floor(y * 100 + 0.5)) AS n_distinct_values, bool_and(y = floor(y)) AS is_all_integer, max(y) - min(y) AS value_range FROM obs GROUP BY ALL)",
    "v_class_smoothness": f"SELECT {K}, avg(abs(dy)) AS mean_abs_dy, stddev(dy) AS std_dy, avg(kappa) AS mean_kappa, stddev(kappa) AS std_kappa, {div('stddev(dy)', 'avg(abs(dy))')} AS roughness, 1 - {div('stddev(kappa)', 'avg(kappa) + 0.001')} AS kappa_consistency FROM v_curvature GROUP BY ALL",
    "flips": f"SELECT {K}, I, row_number() OVER {W} AS n FROM (SELECT *, lag(d2y) OVER {W} AS d2y_prev FROM v_points WHERE d2y IS NOT NULL) WHERE sign(d2y) <> sign(d2y_prev)",
    "v_class_periodicity": f"SELECT *, coalesce(period_variability < 0.2 AND n_half_periods > 5, false) AS is_periodic FROM (SELECT a.entity_id, a.signal_id, count(*) AS n_half_periods, avg(b.I - a.I) * 2 AS estimated_period, {div('stddev(b.I - a.I)', 'avg(b.I - a.I)')} AS period_variability FROM flips a JOIN flips b ON a.entity_id = b.entity_id AND a.signal_id = b.signal_id AND b.n = a.n + 1 GROUP BY ALL)",
    "v_class_sparsity": f"SELECT *, sparsity > 0.9 AS is_sparse_event FROM (SELECT {K}, count(*) AS n_total, count(*) FILTER (y = 0 OR y IS NULL) AS n_zeros, count(*) FILTER (y <> 0) AS n_nonzero, {div('count(*) FILTER (y = 0 OR y IS NULL)', 'count(*)')} AS sparsity FROM obs GROUP BY ALL)",
    "mixed": f"SELECT * EXCLUDE (is_periodic), coalesce(is_periodic, false) AS is_periodic, unique_ratio < 0.05 AND is_all_integer AS few FROM v_class_from_units LEFT JOIN v_class_continuity USING ({K}) LEFT JOIN v_class_periodicity USING ({K}) LEFT JOIN v_class_sparsity USING ({K}) LEFT JOIN v_class_smoothness USING ({K})",
    "v_signal_class": "SELECT *, CASE WHEN unit_class <> 'unknown' THEN unit_class WHEN is_sparse_event THEN 'event' WHEN is_periodic THEN 'periodic' WHEN few OR n_distinct_values < 10 AND is_all_integer THEN 'digital' ELSE 'analog' END AS signal_class, CASE WHEN unit_class <> 'unknown' THEN 'unit' WHEN is_sparse_event THEN 'sparsity' WHEN is_periodic THEN 'periodicity' WHEN few OR n_distinct_values < 10 AND is_all_integer THEN 'continuity' ELSE 'default' END AS class_source, NOT coalesce(unit_class IN ('digital', 'event') OR is_sparse_event OR few, false) AS interpolation_valid, CAST(CASE WHEN unit_class = 'analog' OR is_periodic THEN 3 WHEN is_all_integer THEN 0 ELSE 2 END AS INTEGER) AS max_derivative_order FROM mixed",
    "v_index_properties": f"SELECT DISTINCT {K}, dimension, CASE dimension WHEN 'time' THEN 'velocity/acceleration' WHEN 'space' THEN 'gradient/laplacian' WHEN 'frequency' THEN 'spectral_slope' WHEN 'scale' THEN 'scale_derivative' ELSE 'unknown' END AS derivative_meaning, CASE dimension WHEN 'time' THEN 'causal' WHEN 'space' THEN 'coupling' WHEN 'frequency' THEN 'harmonic' WHEN 'scale' THEN 'hierarchical' ELSE 'correlation' END AS relationship_type, coalesce(dimension = 'time', false) AS causality_directional FROM obs",
    "v_classification_complete": f"SELECT * FROM v_signal_class LEFT JOIN v_index_properties USING ({K})",
    # typology
    "v_trend_detection": f"SELECT *, abs(frac_positive_dy - 0.5) * 2 AS monotonicity FROM (SELECT {K}, {div('count(*) FILTER (dy > 0)', 'count(*)')} AS frac_positive_dy, {div('count(*) FILTER (dy < 0)', 'count(*)')} AS frac_negative_dy, avg(sign(dy)) AS trend_direction, {div('avg(dy)', 'stddev(dy)')} AS trend_strength FROM v_points WHERE dy IS NOT NULL GROUP BY ALL)",
    "v_mean_reversion": f"SELECT *, {div('n_mean_crossings', 'n_points')} AS crossing_rate, {div('n_mean_crossings', 'n_points')} > 0.1 AS is_mean_reverting FROM (SELECT {K}, count(*) AS n_points, count(*) FILTER (side <> before) AS n_mean_crossings FROM (SELECT *, lag(side) OVER {W} AS before FROM (SELECT o.*, sign(y - y_mean) AS side FROM obs o JOIN v_stats_global USING ({K}))) GROUP BY ALL)",
    "quarters": f"SELECT {K}, q, avg(y) AS m, stddev(y) AS d FROM (SELECT *, ntile(4) OVER {W} AS q FROM obs) GROUP BY ALL",
    "v_stationarity": f"SELECT *, coalesce(mean_drift < 1 AND volatility_drift < 0.5, false) AS is_stationary FROM (SELECT {K}, any_value(m) FILTER (q = 1) AS mean_q1, any_value(m) FILTER (q = 4) AS mean_q4, any_value(d) FILTER (q = 1) AS std_q1, any_value(d) FILTER (q = 4) AS std_q4, {div('abs(any_value(m) FILTER (q = 4) - any_value(m) FILTER (q = 1))', 'stddev(m)')} AS mean_drift, {div('abs(any_value(d) FILTER (q = 4) - any_value(d) FILTER (q = 1))', 'avg(d)')} AS volatility_drift FROM quarters GROUP BY ALL)",
    "v_volatility_clustering": f"SELECT *, coalesce(volatility_autocorr > 0.3, false) AS has_volatility_clustering FROM (SELECT a.entity_id, a.signal_id, {corr('abs(a.dy)', 'abs(b.dy)')} AS volatility_autocorr FROM v_dy a JOIN v_dy b ON a.entity_id = b.entity_id AND a.signal_id = b.signal_id AND a.I = b.I + 1 WHERE a.dy IS NOT NULL AND b.dy IS NOT NULL GROUP BY ALL)",
    "rolled": f"SELECT *, stddev(y) OVER (PARTITION BY {K} ORDER BY I ROWS BETWEEN 25 PRECEDING AND CURRENT ROW) AS rolling_std FROM obs",
    "v_burst_detection": f"SELECT *, CASE WHEN volatility_zscore > 2 THEN 'burst' WHEN volatility_zscore < -1 THEN 'calm' ELSE 'normal' END AS volatility_state FROM (SELECT r.*, {div('rolling_std - m', 'd')} AS volatility_zscore FROM rolled r JOIN (SELECT {K}, avg(rolling_std) AS m, stddev(rolling_std) AS d FROM rolled GROUP BY ALL) USING ({K}))",
    "v_autocorr_lag1": f"SELECT a.entity_id, a.signal_id, {corr('a.y', 'b.y')} AS autocorr_lag1 FROM obs a JOIN obs b ON a.entity_id = b.entity_id AND a.signal_id = b.signal_id AND a.I = b.I + 1 GROUP BY ALL",
    "v_persistence": "SELECT *, CASE WHEN autocorr_lag1 > 0.5 THEN 'trending' WHEN autocorr_lag1 < -0.2 THEN 'mean_reverting' ELSE 'random' END AS persistence_class, 'autocorr_proxy' AS persistence_source FROM v_autocorr_lag1",
    "v_regime_state": f"SELECT *, CASE WHEN hi THEN 'elevated' WHEN lo THEN 'depressed' ELSE 'normal' END AS mean_state, CASE WHEN wild THEN 'high_volatility' WHEN rolling_std < y_std * 0.5 THEN 'low_volatility' ELSE 'normal_volatility' END AS volatility_state, CASE WHEN hi AND wild THEN 'crisis' WHEN hi THEN 'elevated_stable' WHEN wild THEN 'volatile' WHEN lo THEN 'depressed' ELSE 'stable' END AS regime_state FROM (SELECT *, rolling_mean > y_mean + y_std AS hi, rolling_mean < y_mean - y_std AS lo, rolling_std > y_std * 1.5 AS wild FROM v_rolling_stats JOIN v_stats_global USING ({K}))",
    "v_chaos_proxy": f"SELECT *, coalesce(sensitivity_ratio > 2 AND curvature_variability > 1.5, false) AS chaos_suspected FROM (SELECT {K}, avg({div('abs(d2y)', 'abs(dy)')}) AS sensitivity_ratio, {div('stddev(kappa)', 'avg(kappa)')} AS curvature_variability FROM v_curvature GROUP BY ALL)",
    "v_signal_typology": f"SELECT * EXCLUDE (n_points), crossing_rate AS mean_crossing_rate, CAST(NULL AS DOUBLE) AS hurst, CAST(NULL AS DOUBLE) AS lyapunov, CASE WHEN is_periodic THEN 'periodic' WHEN signal_class = 'digital' THEN 'discrete' WHEN signal_class = 'event' THEN 'event' WHEN chaos_suspected THEN 'chaotic' WHEN persistence_class = 'trending' AND monotonicity > 0.6 THEN 'trending_strong' WHEN persistence_class = 'trending' THEN 'trending_weak' WHEN persistence_class = 'mean_reverting' AND is_mean_reverting THEN 'mean_reverting' WHEN persistence_class = 'random' THEN 'random_walk' WHEN is_stationary THEN 'stationary' ELSE 'unclassified' END AS behavioral_type FROM v_signal_class LEFT JOIN v_trend_detection USING ({K}) LEFT JOIN v_mean_reversion USING ({K}) LEFT JOIN v_stationarity USING ({K}) LEFT JOIN v_volatility_clustering USING ({K}) LEFT JOIN v_persistence USING ({K}) LEFT JOIN v_chaos_proxy USING ({K})",
    "v_work_order": f"SELECT t.*, coalesce(signal_class = 'analog' AND NOT is_periodic, false) AS needs_hurst, coalesce(signal_class = 'analog' AND NOT is_periodic, false) AS needs_sample_entropy, coalesce(chaos_suspected, false) AS needs_lyapunov, signal_class = 'periodic' OR is_periodic AS needs_fft, coalesce(has_volatility_clustering, false) AS needs_garch, coalesce(signal_class IN ('analog', 'periodic') AND NOT is_stationary, false) AS needs_wavelet, coalesce(chaos_suspected AND n_points > 500, false) AS needs_rqa FROM v_signal_typology t LEFT JOIN v_stats_global USING ({K})",
    "v_typology_complete": "SELECT * FROM v_work_order",
    # geometry
    "ab": "SELECT a.entity_id, a.signal_id AS signal_a, b.signal_id AS signal_b, a.I, a.y AS ya, b.y AS yb, a.dy AS va, b.dy AS vb, a.d2y AS aa, b.d2y AS ba FROM v_points a JOIN v_points b ON a.entity_id = b.entity_id AND a.I = b.I AND a.signal_id < b.signal_id",
    "v_correlation_matrix": f"SELECT {AB}, {corr('ya', 'yb')} AS pearson_correlation, count(*) AS n_overlap FROM ab GROUP BY ALL HAVING count(*) > 50",
    "residual": "SELECT entity_id, signal_id, I, y - avg(y) OVER (PARTITION BY entity_id, I) AS r FROM obs",
    "v_partial_correlation_proxy": f"SELECT a.entity_id, a.signal_id AS signal_a, b.signal_id AS signal_b, {corr('a.r', 'b.r')} AS partial_correlation_proxy FROM residual a JOIN residual b ON a.entity_id = b.entity_id AND a.I = b.I AND a.signal_id < b.signal_id GROUP BY ALL",
    "moves": f"SELECT {AB}, {corr('va', 'vb')} AS velocity_correlation, {corr('aa', 'ba')} AS acceleration_correlation, count(*) AS n FROM ab WHERE va IS NOT NULL AND vb IS NOT NULL GROUP BY ALL",
    "v_derivative_correlation": "SELECT * FROM moves WHERE n > 50",
    "v_pair_metrics": f"SELECT p.*, coalesce(n, 0) AS n_moves, velocity_correlation AS dy_corr, acceleration_correlation AS d2y_corr, partial_correlation_proxy AS residual_corr FROM (SELECT {AB}, count(*) AS n_overlap, {corr('ya', 'yb')} AS y_corr, covar_pop(ya, yb) AS y_covariance FROM ab GROUP BY ALL) p LEFT JOIN moves USING ({AB}) LEFT JOIN v_partial_correlation_proxy USING ({AB})",
    "v_lagged_correlation": f"SELECT a.entity_id, a.signal_id AS signal_a, b.signal_id AS signal_b, CAST(k AS INTEGER) AS lag, {corr('a.y', 'b.y')} AS correlation FROM obs a, obs b, (VALUES (1), (5), (10), (15), (20)) t(k) WHERE a.entity_id = b.entity_id AND a.signal_id <> b.signal_id AND a.I = b.I + k GROUP BY ALL",
    "v_optimal_lag": f"SELECT {AB}, lag AS optimal_lag, correlation AS optimal_correlation, abs(correlation) AS optimal_abs_correlation, CASE WHEN correlation > 0.7 THEN 'strong_positive' WHEN correlation > 0.3 THEN 'moderate_positive' WHEN correlation < -0.7 THEN 'strong_negative' WHEN correlation < -0.3 THEN 'moderate_negative' ELSE 'weak' END AS coupling_strength FROM v_lagged_correlation QUALIFY row_number() OVER (PARTITION BY {AB} ORDER BY round(abs(correlation), 9) DESC NULLS LAST, lag) = 1",
    "v_lead_lag": f"SELECT {AB}, f AS corr_forward, r AS corr_backward, f - r AS lead_lag_asymmetry, CASE WHEN f > r + 0.1 THEN 'A_leads_B' WHEN r > f + 0.1 THEN 'B_leads_A' ELSE 'contemporaneous' END AS lead_lag_direction, CASE WHEN f > r + 0.1 THEN signal_b WHEN r > f + 0.1 THEN signal_a END AS leader_signal FROM (SELECT a.entity_id, a.signal_id AS signal_a, b.signal_id AS signal_b, {corr('a.y', 'b.y')} AS f FROM obs a JOIN obs b ON a.entity_id = b.entity_id AND a.signal_id <> b.signal_id AND a.I = b.I + 10 GROUP BY ALL) JOIN (SELECT a.entity_id, a.signal_id AS signal_a, b.signal_id AS signal_b, {corr('a.y', 'b.y')} AS r FROM obs a JOIN obs b ON a.entity_id = b.entity_id AND a.signal_id <> b.signal_id AND a.I = b.I - 10 GROUP BY ALL) USING ({AB})",
    "v_coupling_network": "SELECT entity_id, signal_a AS source, signal_b AS target, optimal_correlation AS weight, optimal_abs_correlation AS abs_weight, optimal_lag AS lag, coupling_strength, CASE WHEN optimal_correlation > 0 THEN 'positive' ELSE 'negative' END AS edge_type FROM v_optimal_lag WHERE optimal_abs_correlation > 0.3",
    "v_node_degree": "SELECT entity_id, signal_id, count(*) AS degree, sum(w) AS weighted_degree, avg(w) AS avg_coupling_strength FROM (SELECT entity_id, unnest([source, target]) AS signal_id, abs_weight AS w FROM v_coupling_network) GROUP BY ALL",
    "v_directional_degree": "SELECT *, out_degree - in_degree AS net_influence, CASE WHEN out_degree > in_degree * 2 THEN 'driver' WHEN in_degree > out_degree * 2 THEN 'follower' ELSE 'bidirectional' END AS influence_type FROM (SELECT entity_id, signal_id, coalesce(o, 0) AS out_degree, coalesce(i, 0) AS in_degree FROM (SELECT entity_id, signal_a AS signal_id, count(*) AS o FROM v_lead_lag WHERE lead_lag_direction = 'A_leads_B' GROUP BY ALL) FULL JOIN (SELECT entity_id, signal_b AS signal_id, count(*) AS i FROM v_lead_lag WHERE lead_lag_direction = 'A_leads_B' GROUP BY ALL) USING (entity_id, signal_id))",
    "v_correlation_clusters": "SELECT *, count(*) OVER (PARTITION BY entity_id, cluster_id) AS cluster_size FROM (SELECT entity_id, signal_id, min(root) AS cluster_id FROM (SELECT entity_id, unnest([signal_a, signal_b]) AS signal_id, signal_a AS root FROM v_optimal_lag WHERE optimal_abs_correlation > 0.6) GROUP BY ALL)",
    "v_covariance_matrix": f"SELECT {AB}, avg((ya - p.y_mean) * (yb - q.y_mean)) AS covariance FROM ab JOIN v_stats_global p ON p.entity_id = ab.entity_id AND p.signal_id = signal_a JOIN v_stats_global q ON q.entity_id = ab.entity_id AND q.signal_id = signal_b GROUP BY ALL".replace(f"SELECT {AB}", "SELECT ab.entity_id, signal_a, signal_b"),
    "deciles": f"SELECT {K}, I, ntile(10) OVER (PARTITION BY {K} ORDER BY y, I) AS bin FROM obs",
    "joint": "SELECT a.entity_id, a.signal_id AS signal_a, b.signal_id AS signal_b, a.bin AS x, b.bin AS z, CAST(count(*) AS DOUBLE) AS n FROM deciles a JOIN deciles b ON a.entity_id = b.entity_id AND a.I = b.I AND a.signal_id < b.signal_id GROUP BY ALL",
    "v_mutual_info_proxy": f"SELECT {AB}, sum(n / t * ln(n * t / (p * q))) AS mutual_information_proxy FROM (SELECT *, sum(n) OVER (PARTITION BY {AB}) AS t, sum(n) OVER (PARTITION BY entity_id, signal_a, x) AS p, sum(n) OVER (PARTITION BY entity_id, signal_b, z) AS q FROM joint) GROUP BY ALL",
    "v_geometry_complete": f"SELECT *, pearson_correlation AS instant_correlation FROM v_optimal_lag LEFT JOIN v_correlation_matrix USING ({AB}) LEFT JOIN v_lead_lag USING ({AB}) LEFT JOIN v_derivative_correlation USING ({AB}) LEFT JOIN v_partial_correlation_proxy USING ({AB}) LEFT JOIN v_mutual_info_proxy USING ({AB})",
    # dynamics
    "v_regime_changes": f"SELECT *, abs(dy - dy_prev) AS dy_jump, abs(d2y - d2y_prev) AS d2y_jump, {div('abs(dy - dy_prev)', 'dy_median_abs')} + {div('abs(d2y - d2y_prev)', 'd2y_median_abs')} AS change_score, coalesce(abs(dy - dy_prev) > 3 * dy_median_abs OR abs(d2y - d2y_prev) > 3 * d2y_median_abs, false) AS is_regime_change FROM (SELECT *, lag(dy) OVER {W} AS dy_prev, lag(d2y) OVER {W} AS d2y_prev FROM v_curvature) JOIN v_derivative_stats USING ({K})",
    "v_regime_boundaries": f"SELECT {K}, I AS regime_boundary, change_score, row_number() OVER {W} AS regime_number FROM v_regime_changes WHERE is_regime_change",
    "v_regime_assignment": "SELECT p.*, coalesce((SELECT max(regime_number) FROM v_regime_boundaries r WHERE r.entity_id = p.entity_id AND r.signal_id = p.signal_id AND r.regime_boundary <= p.I), 0) AS regime_id FROM v_points p",
    "v_regime_stats": f"SELECT {K}, regime_id, count(*) AS regime_length, min(I) AS regime_start, max(I) AS regime_end, avg(y) AS regime_mean, stddev(y) AS regime_std, min(y) AS regime_min, max(y) AS regime_max, avg(dy) AS regime_avg_velocity, avg(kappa) AS regime_avg_curvature FROM v_regime_assignment GROUP BY ALL",
    "v_regime_transitions": f"SELECT *, regime_id AS from_regime, nid AS to_regime, regime_end AS transition_point, nm - regime_mean AS mean_jump, {div('ns', 'regime_std')} AS volatility_ratio, CASE WHEN ns > regime_std * 1.5 THEN 'volatility_increase' WHEN ns < regime_std * 0.67 THEN 'volatility_decrease' WHEN nm > regime_mean + regime_std THEN 'upward_shift' WHEN nm < regime_mean - regime_std THEN 'downward_shift' ELSE 'lateral' END AS transition_type FROM (SELECT *, lead(regime_id) OVER w AS nid, lead(regime_mean) OVER w AS nm, lead(regime_std) OVER w AS ns FROM v_regime_stats WINDOW w AS (PARTITION BY {K} ORDER BY regime_start))",
    "v_transition_matrix": f"SELECT *, {div('n_transitions', 't')} AS probability FROM (SELECT *, sum(n_transitions) OVER (PARTITION BY {K}, from_regime) AS t FROM (SELECT {K}, regime_state AS from_regime, nxt AS to_regime, count(*) AS n_transitions FROM (SELECT *, lead(regime_state) OVER {W} AS nxt FROM v_regime_state) WHERE nxt IS NOT NULL GROUP BY ALL))",
    "v_stability": f"SELECT *, abs(dy) AS local_expansion_rate, {STABILITY} AS stability_state, dy > 0 AND d2y < 0 OR dy < 0 AND d2y > 0 AS is_locally_stable FROM v_curvature",
    "v_basins": "SELECT e.entity_id, e.signal_id, e.I AS basin_center, e.y AS basin_depth, b.I, b.y, abs(b.I - e.I) AS distance_to_center FROM v_local_extrema e JOIN obs b ON e.entity_id = b.entity_id AND e.signal_id = b.signal_id WHERE extrema_type = 'valley' AND abs(b.I - e.I) < 50",
    "v_attractors_all": f"SELECT *, {div('visit_count', f'sum(visit_count) OVER (PARTITION BY {K})')} AS visit_frequency, row_number() OVER (PARTITION BY {K} ORDER BY visit_count DESC, attractor_value) AS rank_by_visits FROM (SELECT {K}, floor(y * 10 + 0.5) / 10 AS attractor_value, avg(y) AS bin_center, count(*) AS visit_count FROM obs GROUP BY ALL)",
    "v_attractors": "SELECT *, CASE WHEN rank_by_visits = 1 THEN 'primary' WHEN rank_by_visits <= 3 THEN 'secondary' ELSE 'minor' END AS attractor_type FROM v_attractors_all WHERE visit_frequency > 0.05",
    "v_phase_velocity": "SELECT *, sqrt(1 + dy * dy) AS phase_velocity, sqrt(dy * dy + d2y * d2y) AS tangent_magnitude FROM v_curvature",
    "v_bifurcation_base": f"SELECT *, I AS bifurcation_point, abs(kappa - kappa_prev) AS kappa_jump, CASE WHEN kappa > kappa_prev * 2 THEN 'complexity_increase' WHEN kappa < kappa_prev * 0.5 THEN 'complexity_decrease' END AS bifurcation_type FROM (SELECT *, lag(kappa) OVER {W} AS kappa_prev FROM v_curvature)",
    "v_kappa_thresholds": f"SELECT {K}, quantile_cont(abs(kappa), 0.95) AS kappa_p95 FROM v_curvature GROUP BY ALL",
    "v_bifurcation_candidates": f"SELECT * FROM v_bifurcation_base JOIN v_kappa_thresholds USING ({K}) WHERE kappa_jump > kappa_p95",
    "v_dynamics_complete": f"SELECT a.entity_id, a.signal_id, a.I, a.regime_id, r.regime_mean, r.regime_std, r.regime_length, s.stability_state, s.is_locally_stable, p.phase_velocity FROM v_regime_assignment a LEFT JOIN v_regime_stats r USING ({K}, regime_id) LEFT JOIN v_stability s USING ({K}, I) LEFT JOIN v_phase_velocity p USING ({K}, I)",
    "v_system_regime": "SELECT c.entity_id, I AS system_regime_boundary, count(DISTINCT signal_id) AS n_signals_changing, CASE WHEN count(DISTINCT signal_id) > any_value(n) * 0.5 THEN 'major_system_change' WHEN count(DISTINCT signal_id) > 2 THEN 'moderate_system_change' ELSE 'isolated_change' END AS change_magnitude FROM v_regime_changes c JOIN (SELECT entity_id, count(DISTINCT signal_id) AS n FROM obs GROUP BY 1) USING (entity_id) WHERE is_regime_change GROUP BY c.entity_id, I HAVING count(DISTINCT signal_id) > 1",
    # causality
    "past": f"SELECT *, lag(y, 10) OVER {W} AS p FROM obs",
    "v_granger_proxy": f"SELECT *, abs(cross_prediction) - abs(target_self_prediction) AS granger_score, coalesce(abs(cross_prediction) - abs(target_self_prediction) > 0.1, false) AS granger_causes FROM (SELECT a.entity_id, a.signal_id AS target, b.signal_id AS source, {corr('a.y', 'b.p')} AS cross_prediction FROM obs a JOIN past b ON a.entity_id = b.entity_id AND a.I = b.I AND a.signal_id <> b.signal_id WHERE b.p IS NOT NULL GROUP BY ALL) JOIN (SELECT entity_id, signal_id AS target, {corr('y', 'p')} AS target_self_prediction FROM past GROUP BY ALL) USING (entity_id, target) WHERE target_self_prediction IS NOT NULL",
    "v_bidirectional_causality": "SELECT x.entity_id, x.source AS signal_a, x.target AS signal_b, x.granger_score AS score_a_to_b, z.granger_score AS score_b_to_a, x.granger_causes AS a_causes_b, z.granger_causes AS b_causes_a, CASE WHEN x.granger_causes AND z.granger_causes THEN 'bidirectional' WHEN x.granger_causes AND NOT z.granger_causes THEN 'A_causes_B' WHEN z.granger_causes AND NOT x.granger_causes THEN 'B_causes_A' ELSE 'no_causation' END AS causal_direction, x.granger_score - coalesce(z.granger_score, 0) AS net_causal_flow FROM v_granger_proxy x LEFT JOIN v_granger_proxy z ON x.entity_id = z.entity_id AND x.source = z.target AND x.target = z.source",
    "quintiles": f"SELECT {K}, I, ntile(5) OVER (PARTITION BY {K} ORDER BY y, I) AS bin FROM (SELECT *, lag(y) OVER {W} AS before FROM obs) WHERE before IS NOT NULL",
    "bin_moves": f"SELECT {K}, I, CAST(bin - coalesce(lag(bin) OVER {W}, bin) AS DOUBLE) AS m FROM quintiles",
    "v_transfer_entropy_proxy": f"SELECT *, abs(change_correlation) AS transfer_entropy_proxy FROM (SELECT a.entity_id, a.signal_id AS source, b.signal_id AS target, {corr('a.m', 'b.m')} AS change_correlation FROM bin_moves a JOIN bin_moves b ON a.entity_id = b.entity_id AND a.I = b.I + 5 AND a.signal_id <> b.signal_id GROUP BY ALL)",
    "v_causal_roles": "SELECT *, out_degree - in_degree AS net_influence, CASE WHEN out_degree > 0 AND in_degree = 0 THEN 'SOURCE' WHEN in_degree > 0 AND out_degree = 0 THEN 'SINK' WHEN out_degree > 0 AND in_degree > 0 THEN 'CONDUIT' ELSE 'ISOLATED' END AS causal_role FROM (SELECT entity_id, signal_id, coalesce(o, 0) AS out_degree, coalesce(i, 0) AS in_degree, coalesce(f, 0) AS total_causal_flow FROM (SELECT entity_id, signal_a AS signal_id, count(*) AS o FROM v_bidirectional_causality WHERE a_causes_b AND b_causes_a IS NOT NULL GROUP BY ALL) FULL JOIN (SELECT entity_id, signal_b AS signal_id, count(*) AS i FROM v_bidirectional_causality WHERE a_causes_b AND b_causes_a IS NOT NULL GROUP BY ALL) USING (entity_id, signal_id) LEFT JOIN (SELECT entity_id, signal_a AS signal_id, sum(net_causal_flow) AS f FROM v_bidirectional_causality GROUP BY ALL) USING (entity_id, signal_id))",
    "v_causal_chains": "SELECT a.entity_id, a.signal_a AS root, a.signal_b AS middle, b.signal_b AS leaf, a.signal_a || ' → ' || a.signal_b || ' → ' || b.signal_b AS chain_path FROM v_bidirectional_causality a JOIN v_bidirectional_causality b ON a.entity_id = b.entity_id AND a.signal_b = b.signal_a WHERE a.causal_direction = 'A_causes_B' AND b.causal_direction = 'A_causes_B' AND a.signal_a <> b.signal_b",
    "big": f"SELECT * FROM (SELECT {K}, I, {div('abs(dy)', f'stddev(dy) OVER (PARTITION BY {K})')} AS size FROM v_points WHERE dy IS NOT NULL) WHERE size > 2",
    "v_causal_timing": "SELECT s.entity_id, s.signal_id AS source, t.signal_id AS target, avg(t.I - s.I) AS avg_response_lag, min(t.I - s.I) AS min_response_lag, count(*) AS n_linked_events FROM big s JOIN big t ON s.entity_id = t.entity_id AND s.signal_id <> t.signal_id AND t.I > s.I AND t.I < s.I + 50 GROUP BY ALL HAVING count(*) > 5",
    "changed": "SELECT * FROM v_regime_changes WHERE is_regime_change",
    "ten": f"SELECT *, y - lag(y, 10) OVER {W} AS c FROM obs",
    "v_intervention_effects": f"SELECT s.entity_id, s.signal_id AS source, b.signal_id AS target, avg(b.I - s.I) AS avg_response_lag, {corr('s.change_score', 'b.c')} AS intervention_correlation, count(*) AS n_interventions FROM changed s JOIN ten b ON s.entity_id = b.entity_id AND s.signal_id <> b.signal_id AND b.I > s.I AND b.I < s.I + 30 WHERE b.c IS NOT NULL GROUP BY ALL HAVING count(*) > 3",
    "v_root_cause_candidates": "SELECT t.entity_id, t.signal_id AS target, s.signal_id AS candidate_source, t.I AS target_change_at, s.I AS source_changed_at, t.I - s.I AS lead_time, EXISTS (SELECT 1 FROM v_granger_proxy g WHERE g.entity_id = t.entity_id AND g.source = s.signal_id AND g.target = t.signal_id AND g.granger_causes) AS has_granger_support FROM changed t JOIN changed s ON s.entity_id = t.entity_id AND s.signal_id <> t.signal_id AND s.I < t.I AND s.I > t.I - 50",
    "v_causal_strength": "SELECT b.entity_id, b.signal_a AS source, b.signal_b AS target, causal_direction, score_a_to_b AS granger_score, optimal_correlation AS coupling_strength, optimal_lag AS coupling_lag, transfer_entropy_proxy, (coalesce(abs(score_a_to_b), 0) + coalesce(optimal_abs_correlation, 0) + coalesce(transfer_entropy_proxy, 0)) / 3 AS combined_causal_strength FROM v_bidirectional_causality b LEFT JOIN v_optimal_lag USING (entity_id, signal_a, signal_b) LEFT JOIN v_transfer_entropy_proxy t ON t.entity_id = b.entity_id AND t.source = signal_a AND t.target = signal_b WHERE causal_direction IN ('A_causes_B', 'bidirectional')",
    "v_causal_graph": "SELECT entity_id, source, target, combined_causal_strength AS weight, granger_score, coupling_strength, coupling_lag AS lag, 'causal' AS edge_type FROM v_causal_strength WHERE combined_causal_strength > 0.2 UNION ALL SELECT entity_id, signal_a, signal_b, optimal_abs_correlation, NULL, optimal_correlation, optimal_lag, 'coupling' FROM v_optimal_lag l WHERE optimal_abs_correlation > 0.5 AND NOT EXISTS (SELECT 1 FROM v_causal_strength c WHERE c.entity_id = l.entity_id AND (c.source = signal_a AND c.target = signal_b OR c.source = signal_b AND c.target = signal_a))",
    "v_causality_complete": "SELECT r.*, (SELECT string_agg(target, ', ' ORDER BY target) FROM v_causal_strength c WHERE c.entity_id = r.entity_id AND c.source = r.signal_id) AS drives, (SELECT string_agg(source, ', ' ORDER BY source) FROM v_causal_strength c WHERE c.entity_id = r.entity_id AND c.target = r.signal_id) AS driven_by FROM v_causal_roles r",
    "v_system_causal_structure": f"SELECT n.entity_id, n_nodes, coalesce(n_sources, 0) AS n_sources, coalesce(n_sinks, 0) AS n_sinks, coalesce(n_conduits, 0) AS n_conduits, coalesce(n_isolated, 0) AS n_isolated, coalesce(n_edges, 0) AS n_edges, {div('coalesce(n_edges, 0)', 'n_nodes * (n_nodes - 1)')} AS causal_density, max_chain_depth, top_sources FROM (SELECT entity_id, count(DISTINCT signal_id) AS n_nodes FROM obs GROUP BY 1) n LEFT JOIN (SELECT entity_id, count(*) FILTER (causal_role = 'SOURCE') AS n_sources, count(*) FILTER (causal_role = 'SINK') AS n_sinks, count(*) FILTER (causal_role = 'CONDUIT') AS n_conduits, count(*) FILTER (causal_role = 'ISOLATED') AS n_isolated FROM v_causal_roles GROUP BY 1) USING (entity_id) LEFT JOIN (SELECT entity_id, count(*) AS n_edges FROM v_causal_graph GROUP BY 1) USING (entity_id) LEFT JOIN (SELECT entity_id, max(length(chain_path) - length(replace(chain_path, '→', '')) + 1) AS max_chain_depth FROM v_causal_chains GROUP BY 1) USING (entity_id) LEFT JOIN (SELECT entity_id, string_agg(signal_id, ', ' ORDER BY k) AS top_sources FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY round(total_causal_flow, 9) DESC, signal_id) AS k FROM v_causal_roles WHERE causal_role = 'SOURCE') WHERE k <= 3 GROUP BY 1) USING (entity_id)",
    # entropy
    "v_binned_distribution": f"SELECT *, {div('bin_count', 'total_count')} AS probability FROM (SELECT {K}, bin_id, count(*) AS bin_count, sum(count(*)) OVER (PARTITION BY {K})::BIGINT AS total_count FROM (SELECT *, ntile(20) OVER (PARTITION BY {K} ORDER BY y, I) AS bin_id FROM obs) GROUP BY {K}, bin_id)",
    "v_shannon_entropy": f"SELECT *, shannon_entropy / ln(20) AS normalized_entropy, CASE WHEN shannon_entropy / ln(20) > 0.9 THEN 'high_entropy' WHEN shannon_entropy / ln(20) > 0.5 THEN 'medium_entropy' ELSE 'low_entropy' END AS entropy_category FROM (SELECT {K}, {ent('probability')} AS shannon_entropy FROM v_binned_distribution GROUP BY ALL)",
    "v_derivative_entropy": f"SELECT {K}, {ent('p')} AS derivative_entropy FROM (SELECT {K}, bin, {div('count(*)', f'sum(count(*)) OVER (PARTITION BY {K})')} AS p FROM (SELECT *, ntile(20) OVER (PARTITION BY {K} ORDER BY dy, I) AS bin FROM v_points WHERE dy IS NOT NULL) GROUP BY {K}, bin) GROUP BY ALL",
    "v_joint_entropy": f"SELECT {AB}, {ent('p')} AS joint_entropy FROM (SELECT {AB}, x, z, {div('count(*)', 'sum(count(*)) OVER (PARTITION BY entity_id)')} AS p FROM (SELECT {AB}, ntile(10) OVER (PARTITION BY entity_id, signal_a ORDER BY ya, I, signal_b) AS x, ntile(10) OVER (PARTITION BY entity_id, signal_b ORDER BY yb, I, signal_a) AS z FROM ab) GROUP BY {AB}, x, z) GROUP BY ALL",
    "v_conditional_entropy": "SELECT j.*, a.shannon_entropy AS entropy_a, b.shannon_entropy AS entropy_b, joint_entropy - a.shannon_entropy AS conditional_entropy_b_given_a, joint_entropy - b.shannon_entropy AS conditional_entropy_a_given_b FROM v_joint_entropy j JOIN v_shannon_entropy a ON a.entity_id = j.entity_id AND a.signal_id = signal_a JOIN v_shannon_entropy b ON b.entity_id = j.entity_id AND b.signal_id = signal_b",
    "v_mutual_information": f"SELECT *, entropy_a + entropy_b - joint_entropy AS mutual_information, {div('entropy_a + entropy_b - joint_entropy', 'least(entropy_a, entropy_b)')} AS normalized_mutual_info FROM v_conditional_entropy",
    "v_permutation_entropy": f"SELECT *, permutation_entropy / ln(6) AS normalized_permutation_entropy, CASE WHEN permutation_entropy / ln(6) > 0.9 THEN 'random' WHEN permutation_entropy / ln(6) < 0.5 THEN 'structured' ELSE 'mixed' END AS complexity_category FROM (SELECT {K}, {ent('p')} AS permutation_entropy FROM (SELECT {K}, pattern, {div('count(*)', f'sum(count(*)) OVER (PARTITION BY {K})')} AS p FROM (SELECT {K}, CASE WHEN a < b AND b < c THEN '012' WHEN a < c AND c < b THEN '021' WHEN b < a AND a < c THEN '102' WHEN b < c AND c < a THEN '120' WHEN c < a AND a < b THEN '201' WHEN c < b AND b < a THEN '210' END AS pattern FROM (SELECT {K}, y AS a, lead(y, 1) OVER {W} AS b, lead(y, 2) OVER {W} AS c FROM obs)) WHERE pattern IS NOT NULL GROUP BY {K}, pattern) GROUP BY ALL)",
    "bits": f"SELECT *, CASE WHEN y > avg(y) OVER (PARTITION BY {K} ORDER BY I ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) THEN '1' ELSE '0' END AS bit FROM obs",
    "v_approx_entropy_proxy": f"SELECT {K}, {ent('p')} AS approx_entropy_proxy FROM (SELECT {K}, word, {div('count(*)', f'sum(count(*)) OVER (PARTITION BY {K})')} AS p FROM (SELECT {K}, bit || lead(bit, 1) OVER {W} || lead(bit, 2) OVER {W} AS word FROM bits) WHERE word IS NOT NULL GROUP BY {K}, word) GROUP BY ALL",
    "ratios": f"SELECT {K}, I, {div('abs(d2y)', f'abs(y - avg(y) OVER (PARTITION BY {K} ORDER BY I ROWS BETWEEN 20 PRECEDING AND 20 FOLLOWING)) + 0.001')} AS ratio FROM v_curvature",
    "v_spectral_entropy_proxy": f"SELECT {K}, {ent('p')} AS spectral_entropy_proxy FROM (SELECT {K}, bin, {div('count(*)', f'sum(count(*)) OVER (PARTITION BY {K})')} AS p FROM (SELECT *, ntile(10) OVER (PARTITION BY {K} ORDER BY ratio, I) AS bin FROM ratios) GROUP BY {K}, bin) GROUP BY ALL",
    "v_rolling_entropy": f"SELECT {K}, I, -sum(DISTINCT p * ln(p + 1e-10)) AS rolling_entropy FROM (SELECT {K}, I, bin, {div('count(*)', f'sum(count(*)) OVER (PARTITION BY {K}, I)')} AS p FROM (SELECT *, ntile(10) OVER {W} AS bin FROM obs) GROUP BY {K}, I, bin) GROUP BY ALL",
    "halves": f"SELECT {K}, h, {ent('p')} AS e FROM (SELECT {K}, h, bin, {div('count(*)', f'sum(count(*)) OVER (PARTITION BY {K}, h)')} AS p FROM (SELECT *, ntile(20) OVER (PARTITION BY {K}, h ORDER BY y, I) AS bin FROM (SELECT *, I < max(I) OVER (PARTITION BY {K}) / 2 AS h FROM obs)) GROUP BY {K}, h, bin) GROUP BY ALL",
    "v_information_gain": f"SELECT {K}, a.e AS entropy_first_half, b.e AS entropy_second_half, a.e - b.e AS information_gain, CASE WHEN round(a.e - b.e, 9) > 0 THEN 'increasing_order' WHEN round(a.e - b.e, 9) < 0 THEN 'increasing_disorder' ELSE 'stable_complexity' END AS complexity_trend FROM (SELECT * FROM halves WHERE h) a JOIN (SELECT * FROM halves WHERE NOT h) b USING ({K})",
    "v_entropy_complete": f"SELECT * FROM v_shannon_entropy LEFT JOIN v_derivative_entropy USING ({K}) LEFT JOIN v_permutation_entropy USING ({K}) LEFT JOIN v_approx_entropy_proxy USING ({K}) LEFT JOIN v_spectral_entropy_proxy USING ({K}) LEFT JOIN v_information_gain USING ({K})",
    "v_histogram_entropy": f"SELECT {K}, {ent('p')} AS histogram_entropy, count(*) AS n_bins FROM (SELECT {K}, bin, {div('count(*)', f'sum(count(*)) OVER (PARTITION BY {K})')} AS p FROM (SELECT o.*, least(floor(coalesce({div('y - y_min', 'y_range')}, 0) * 20), 19) AS bin FROM obs o JOIN v_stats_global USING ({K})) GROUP BY {K}, bin) GROUP BY ALL",
    # balances
    "totals": f"SELECT entity_id, I, sum(y) AS total_value FROM obs WHERE unit IN ({quoted(ANALOG_UNITS)}) GROUP BY ALL",
    "v_conservation_check": f"SELECT *, total_value - expected_total AS deviation, CASE WHEN abs(deviation_zscore) > 3 THEN 'conservation_violation' ELSE 'conserved' END AS conservation_status FROM ({_mean('totals', 'total_value', 'expected_total', 'deviation_zscore')})",
    "v_mass_balance": "SELECT *, total_inlet - total_outlet AS net_accumulation, CASE WHEN abs(total_inlet - total_outlet) < 0.01 * greatest(total_inlet, 0.001) THEN 'balanced' ELSE 'imbalanced' END AS balance_status FROM (SELECT entity_id, I, sum(CASE WHEN kind = 'inlet' THEN y ELSE 0 END) AS total_inlet, sum(CASE WHEN kind = 'outlet' THEN y ELSE 0 END) AS total_outlet FROM (SELECT *, CASE WHEN signal_id LIKE '%outlet%' THEN 'outlet' WHEN signal_id LIKE '%in%' THEN 'inlet' WHEN signal_id LIKE '%out%' THEN 'outlet' END AS kind FROM obs WHERE unit IN ('m³/s', 'L/min', 'gpm', 'kg/s', 'lb/hr')) WHERE kind IS NOT NULL GROUP BY ALL)",
    "v_energy_balance": f"SELECT *, CASE WHEN {div('power_variation', 'm')} < 0.1 THEN 'stable_energy' ELSE 'varying_energy' END AS energy_status FROM (SELECT p.entity_id, p.I, sum(p.y * f.y) AS total_power, stddev(p.y * f.y) AS power_variation, avg(p.y * f.y) AS m FROM obs p JOIN obs f ON p.entity_id = f.entity_id AND p.I = f.I WHERE p.unit IN ('kPa', 'PSI', 'bar', 'Pa') AND f.unit IN ('m³/s', 'L/min', 'gpm') GROUP BY ALL)",
    "pvt": f"SELECT * FROM (SELECT p.entity_id, p.I, p.y AS pressure, t.y AS temperature, {div('p.y * coalesce(v.y, 1)', 't.y')} AS pv_over_t FROM obs p JOIN obs t ON p.entity_id = t.entity_id AND p.I = t.I LEFT JOIN (SELECT * FROM obs WHERE unit IN ('m³', 'L', 'ft³')) v ON p.entity_id = v.entity_id AND p.I = v.I WHERE p.unit IN ('kPa', 'PSI', 'bar', 'Pa') AND t.unit IN ('K', '°C', '°F')) WHERE pv_over_t IS NOT NULL",
    "v_thermodynamic_consistency": f"SELECT *, CASE WHEN abs(deviation_zscore) > 2 THEN 'thermodynamic_anomaly' ELSE 'consistent' END AS thermo_status FROM ({_mean('pvt', 'pv_over_t', 'expected_constant', 'deviation_zscore')})",
    "sys": f"SELECT entity_id, I, avg(normalized_entropy) AS system_entropy FROM obs JOIN v_shannon_entropy USING ({K}) GROUP BY ALL",
    "v_second_law_check": "SELECT *, CASE WHEN entropy_change < -0.1 THEN 'possible_second_law_violation' ELSE 'consistent' END AS second_law_status, count(*) FILTER (entropy_change < -0.1) OVER (PARTITION BY entity_id) AS n_violations FROM (SELECT *, system_entropy - lag(system_entropy) OVER (PARTITION BY entity_id ORDER BY I) AS entropy_change FROM sys)",
    "flux": "SELECT d.entity_id, d.signal_id, d.I, d.y AS density, v.y AS velocity, d.y * v.y AS f FROM obs d JOIN obs v ON d.entity_id = v.entity_id AND d.I = v.I WHERE d.unit IN ('kg/m³', 'g/cm³') AND v.unit IN ('m/s', 'ft/s')",
    "v_continuity_equation": f"SELECT *, drho_dt + div_mass_flux AS continuity_residual, CASE WHEN abs(drho_dt + div_mass_flux) < 0.01 * greatest(abs(drho_dt), abs(div_mass_flux), 0.001) THEN 'satisfied' ELSE 'violated' END AS continuity_status FROM (SELECT *, (lead(density) OVER {W} - lag(density) OVER {W}) / 2.0 AS drho_dt, (lead(f) OVER {W} - lag(f) OVER {W}) / 2.0 AS div_mass_flux FROM flux) WHERE drho_dt IS NOT NULL AND div_mass_flux IS NOT NULL",
    "v_diffusion_check": f"SELECT *, CASE WHEN gradient_concentration_corr > 0.5 THEN 'diffusion_dominated' WHEN gradient_concentration_corr < -0.5 THEN 'anti_diffusion' ELSE 'mixed_transport' END AS transport_regime FROM (SELECT {K}, {corr('abs(dy)', 'y')} AS gradient_concentration_corr FROM v_points WHERE dimension = 'space' AND dy IS NOT NULL GROUP BY ALL)",
    "pv": "SELECT p.entity_id, p.I, p.y AS pressure, v.y AS velocity, p.y + 0.5 * v.y * v.y AS bernoulli_sum FROM obs p JOIN obs v ON p.entity_id = v.entity_id AND p.I = v.I WHERE p.unit IN ('kPa', 'Pa', 'PSI') AND v.unit IN ('m/s', 'ft/s')",
    "v_bernoulli_check": f"SELECT *, CASE WHEN abs(deviation_zscore) > 2 THEN 'bernoulli_violation' ELSE 'consistent' END AS bernoulli_status FROM ({_mean('pv', 'bernoulli_sum', 'expected_constant', 'deviation_zscore')})",
    "v_heat_transfer_check": f"SELECT *, CASE WHEN {div('temp_gradient_variation', 'avg_temp_gradient')} < 0.2 THEN 'steady_conduction' WHEN {div('temp_gradient_variation', 'avg_temp_gradient')} < 0.5 THEN 'quasi_steady' ELSE 'transient' END AS heat_transfer_regime FROM (SELECT {K}, avg(abs(dy)) AS avg_temp_gradient, stddev(dy) AS temp_gradient_variation FROM v_points WHERE unit IN ('K', '°C', '°F') AND dimension = 'space' AND dy IS NOT NULL GROUP BY ALL)",
    "fa": f"SELECT * FROM (SELECT f.entity_id, f.I, f.y AS force, a.d2y AS acceleration, {div('f.y', 'CASE WHEN abs(a.d2y) > 1e-9 THEN a.d2y END')} AS implied_mass FROM obs f JOIN v_points a ON f.entity_id = a.entity_id AND f.I = a.I WHERE f.unit IN ('N', 'kN', 'lbf')) WHERE implied_mass IS NOT NULL",
    "v_momentum_balance": f"SELECT *, CASE WHEN abs(mass_consistency) > 2 THEN 'momentum_anomaly' ELSE 'consistent' END AS momentum_status FROM ({_mean('fa', 'implied_mass', 'avg_mass', 'mass_consistency')})",
    "v_physics_complete": " UNION ALL ".join(
        f"SELECT '{k}' AS check_type, count(*) FILTER ({bad}) AS n_violations, count(*) AS n_checks FROM {t}"
        for k, t, bad in (("conservation", "v_conservation_check", "conservation_status = 'conservation_violation'"), ("mass_balance", "v_mass_balance", "balance_status = 'imbalanced'"), ("thermodynamic", "v_thermodynamic_consistency", "thermo_status = 'thermodynamic_anomaly'"), ("second_law", "v_second_law_check", "second_law_status <> 'consistent'"), ("bernoulli", "v_bernoulli_check", "bernoulli_status = 'bernoulli_violation'"))
    ),
    # assembly
    "v_phase_space": f"SELECT b.*, c.y AS phase_x, coalesce(c.dy * 10, 0) AS phase_y, coalesce(c.kappa * 100, 0) AS phase_z, 'local' AS coord_source FROM obs b LEFT JOIN (SELECT {K}, I, y, dy, kappa FROM v_curvature) c USING ({K}, I)",
    "steps": f"SELECT {K}, I, phase_x, phase_y, phase_z, sqrt(coalesce(power(phase_x - lag(phase_x) OVER {W}, 2), 0) + coalesce(power(phase_y - lag(phase_y) OVER {W}, 2), 0) + coalesce(power(phase_z - lag(phase_z) OVER {W}, 2), 0)) AS phase_velocity FROM v_phase_space",
    "v_trajectory_base": f"SELECT s.*, t.signal_class, t.behavioral_type, a.regime_id, r.regime_mean, r.regime_std FROM steps s LEFT JOIN v_signal_typology t USING ({K}) LEFT JOIN v_regime_assignment a USING ({K}, I) LEFT JOIN v_regime_stats r ON r.entity_id = s.entity_id AND r.signal_id = s.signal_id AND r.regime_id = a.regime_id",
    "v_trajectory": f"SELECT *, sum(phase_velocity) OVER (PARTITION BY {K} ORDER BY I ROWS UNBOUNDED PRECEDING) AS arc_length FROM v_trajectory_base",
    "v_signal_summary": f"SELECT c.*, t.behavioral_type, t.persistence_class, t.chaos_suspected, g.n_points, y_mean, y_std, y_min, y_max, causal_role, out_degree AS n_drives, in_degree AS n_driven_by, shannon_entropy, normalized_entropy, permutation_entropy, n_regimes FROM v_signal_class c LEFT JOIN v_signal_typology t USING ({K}) LEFT JOIN v_stats_global g USING ({K}) LEFT JOIN v_causal_roles USING ({K}) LEFT JOIN v_entropy_complete USING ({K}) LEFT JOIN (SELECT {K}, count(DISTINCT regime_id) AS n_regimes FROM v_regime_assignment GROUP BY ALL) USING ({K})",
    "v_regime_summary": f"SELECT s.*, t.transition_type, t.mean_jump, t.volatility_ratio FROM v_regime_stats s LEFT JOIN v_regime_transitions t USING ({K}, regime_id)",
    "v_coupling_summary": "SELECT g.*, g.signal_a AS source, g.signal_b AS target, combined_causal_strength, granger_score, CASE WHEN combined_causal_strength > 0.5 THEN 'strong_causal' WHEN optimal_correlation > 0.7 THEN 'strong_coupling' WHEN combined_causal_strength > 0.2 THEN 'moderate_causal' WHEN optimal_correlation > 0.3 THEN 'moderate_coupling' ELSE 'weak' END AS relationship_strength FROM v_geometry_complete g LEFT JOIN (SELECT entity_id, source, target, combined_causal_strength, granger_score FROM v_causal_strength) c ON c.entity_id = g.entity_id AND c.source = g.signal_a AND c.target = g.signal_b",
    "v_system_summary": "SELECT (SELECT count(DISTINCT signal_id) FROM obs) AS n_signals, (SELECT count(*) FROM obs) AS n_total_points, (SELECT min(I) FROM obs) AS I_min, (SELECT max(I) FROM obs) AS I_max, " + ", ".join(f"(SELECT count(*) FROM v_signal_class WHERE signal_class = '{c}') AS n_{c}" for c in ("analog", "digital", "periodic", "event")) + ", (SELECT count(*) FROM v_signal_typology WHERE behavioral_type LIKE 'trending%') AS n_trending, (SELECT count(*) FROM v_signal_typology WHERE behavioral_type = 'mean_reverting') AS n_mean_reverting, (SELECT count(*) FROM v_signal_typology WHERE behavioral_type = 'chaotic') AS n_chaotic, " + ", ".join(f"(SELECT count(*) FROM v_causal_roles WHERE causal_role = '{r.upper()}') AS n_{r}s" for r in ("source", "sink", "conduit")) + f", (SELECT count(DISTINCT regime_id) FROM v_regime_assignment) AS total_regimes, (SELECT avg(shannon_entropy) FROM v_shannon_entropy) AS avg_system_entropy, (SELECT {div('sum(n_violations)', 'sum(n_checks)')} FROM v_physics_complete) AS physics_violation_rate",
    "v_alerts": "SELECT entity_id, 'regime_change' AS alert_type, signal_id, I AS alert_at, 'Regime change detected' AS description, change_score AS severity FROM v_regime_changes WHERE is_regime_change UNION ALL SELECT entity_id, 'chaos_suspected', signal_id, NULL, 'Chaotic behavior suspected', sensitivity_ratio FROM v_chaos_proxy WHERE chaos_suspected UNION ALL SELECT entity_id, 'bifurcation', signal_id, bifurcation_point, 'Possible bifurcation: ' || bifurcation_type, kappa_jump FROM v_bifurcation_candidates WHERE bifurcation_type IS NOT NULL UNION ALL SELECT entity_id, 'physics_violation', NULL, I, 'Conservation violation detected', abs(deviation_zscore) FROM v_conservation_check WHERE conservation_status = 'conservation_violation' UNION ALL SELECT entity_id, 'extreme_outlier', signal_id, I, 'Extreme value detected (z > 3)', abs(z_score) FROM v_zscore WHERE z_category = 'extreme'",
    "v_export_signal_class": "SELECT * FROM v_classification_complete",
    "v_export_signal_typology": f"SELECT b.I, b.y, t.* FROM v_signal_typology t JOIN obs b USING ({K})",
    "v_export_behavioral_geometry": "SELECT *, mutual_information_proxy AS mutual_information FROM v_coupling_summary",
    "v_export_dynamical_systems": "SELECT * FROM v_dynamics_complete",
    "v_export_causal_mechanics": "SELECT *, out_degree AS n_drives, in_degree AS n_driven_by FROM v_causality_complete",
    "v_export_alerts_json": "SELECT * FROM v_alerts ORDER BY round(severity, 6) DESC NULLS LAST, entity_id NULLS LAST, alert_type, signal_id NULLS LAST, alert_at NULLS LAST LIMIT 100",
    # primitives
    "p_signal_stats": f"SELECT {K}, count(y) AS n_points, avg(y) AS mean, stddev_pop(y) AS std, min(y) AS min, max(y) AS max, median(y) AS median, quantile_cont(y, 0.25) AS q25, quantile_cont(y, 0.75) AS q75, {skew('y')} AS skewness, {kurt('y')} AS kurtosis, {div('count(DISTINCT y)', 'count(y)')} AS unique_ratio, var_pop(y) AS variance FROM obs GROUP BY ALL",
    "p_typology": "SELECT *, CASE WHEN variance < 1e-10 THEN 'constant' WHEN unique_ratio < 0.01 THEN 'digital' WHEN unique_ratio < 0.05 THEN 'discrete' ELSE 'analog' END AS signal_type FROM p_signal_stats",
    "p_pairwise": f"SELECT {AB}, {corr('ya', 'yb')} AS correlation, covar_pop(ya, yb) AS covariance, count(*) AS n_points FROM ab GROUP BY ALL HAVING count(*) >= 10",
    "p_correlation_matrix": "SELECT * FROM p_pairwise",
    "prev": f"SELECT * FROM (SELECT {K}, I, y, lag(y) OVER {W} AS p FROM obs) WHERE p IS NOT NULL",
    "p_lag_correlation": f"SELECT a.entity_id, a.signal_id AS signal_a, b.signal_id AS signal_b, {corr('a.p', 'b.y')} AS corr_a_leads, {corr('a.y', 'b.p')} AS corr_b_leads, count(*) AS n_points FROM prev a JOIN prev b ON a.entity_id = b.entity_id AND a.I = b.I AND a.signal_id < b.signal_id GROUP BY ALL HAVING count(*) >= 10",
    "back": f"SELECT *, coalesce(y - lag(y) OVER {W}, 0) AS dy, coalesce((lead(y) OVER {W} - lag(y) OVER {W}) / 2.0, 0) AS central FROM obs",
    "p_pointwise": f"SELECT *, abs(d2y) / power(1 + dy * dy, 1.5) AS curvature, coalesce(sign(dy) <> sign(dy_before), false) AS sign_change FROM (SELECT *, coalesce(dy - lag(dy) OVER {W}, 0) AS d2y, lag(dy) OVER {W} AS dy_before FROM back)",
    "p_derivative_stats": f"SELECT {K}, " + ", ".join(f"avg({c}) AS {c}_mean, stddev_pop({c}) AS {c}_std, max(abs({c})) AS {c}_max" for c in ("dy", "d2y")) + ", count(*) FILTER (sign_change) AS n_sign_changes FROM p_pointwise GROUP BY ALL",
    "p_derivatives": f"SELECT *, dy - lag(dy) OVER {W} AS d2y FROM (SELECT *, y - lag(y) OVER {W} AS dy FROM obs)",
    "rich": f"SELECT o.*, I - lag(I) OVER {W} AS step, y - lag(y) OVER {W} AS move, median(y) OVER (PARTITION BY {K}) AS centre, sign(y) <> sign(lag(y) OVER {W}) AS flip, max(y) OVER (PARTITION BY {K}) - min(y) OVER (PARTITION BY {K}) AS width FROM obs o",
    "p_typology_complete": f"SELECT *, CASE WHEN cv_step < 0.01 THEN 'regular' WHEN cv_step < 0.5 THEN 'irregular' ELSE 'sparse' END AS index_continuity, CASE WHEN unique_ratio < 0.05 THEN 'discrete' WHEN unique_ratio < 0.5 THEN 'mixed' ELSE 'continuous' END AS amplitude_continuity, CASE WHEN frac_up >= 0.95 THEN 'increasing' WHEN frac_down >= 0.95 THEN 'decreasing' ELSE 'non_monotonic' END AS monotonicity, CASE WHEN sparsity > 0.5 THEN 'sparse' ELSE 'dense' END AS sparsity_class, CASE WHEN width < 10 * std THEN 'bounded' ELSE 'unbounded' END AS boundedness, CASE WHEN abs(mean) > std THEN 'power' ELSE 'energy' END AS energy_class, abs(mean) > 0.1 * std AS has_dc, abs(drift) > 0.5 AS has_trend FROM (SELECT {K}, count(y) AS n_points, avg(y) AS mean, stddev_pop(y) AS std, {skew('y')} AS skewness, {kurt('y')} AS kurtosis, {div('count(DISTINCT y)', 'count(y)')} AS unique_ratio, {div('stddev_pop(step)', 'avg(step)')} AS cv_step, {div('count(*) FILTER (move > 0)', 'count(move)')} AS frac_up, {div('count(*) FILTER (move < 0)', 'count(move)')} AS frac_down, count(*) FILTER (flip) AS n_zero_crossings, max(width) AS width, avg(y * y) AS energy, {corr('I', 'y')} AS drift, {div('count(*) FILTER (abs(y - centre) <= 0.001 * width)', 'count(y)')} AS sparsity FROM rich GROUP BY ALL)",
    # measures without a kernel
    "cells": f"SELECT o.*, least(floor(coalesce({div('y - y_min', 'y_range')}, 0) * 20), 19) AS c20, least(floor(coalesce({div('y - y_min', 'y_range')}, 0) * 10), 9) AS c10 FROM obs o JOIN v_stats_global USING ({K})",
    "met": "SELECT a.entity_id, a.signal_id AS signal_a, b.signal_id AS signal_b, a.c20 AS x, b.c20 AS z FROM cells a JOIN cells b ON a.entity_id = b.entity_id AND a.I = b.I AND a.signal_id < b.signal_id",
    "e_mutual_info": f"SELECT *, {div('mutual_info', 'least(ha, hb)')} AS normalized_mi FROM (SELECT *, greatest(0, ha + hb - hab) AS mutual_info FROM (SELECT {AB}, entropy(x) AS ha, entropy(z) AS hb, entropy(x || '/' || z) AS hab FROM met GROUP BY ALL))",
    "stepped": f"SELECT * FROM (SELECT {K}, I, c10 AS c, lag(c10) OVER {W} AS p FROM cells) WHERE p IS NOT NULL",
    "e_transfer_entropy": "SELECT *, transfer_entropy / log2(10) AS normalized_te FROM (SELECT a.entity_id, a.signal_id AS source, b.signal_id AS target, greatest(0, entropy(b.c || '/' || b.p) + entropy(b.p || '/' || a.p) - entropy(b.p) - entropy(b.c || '/' || b.p || '/' || a.p)) AS transfer_entropy FROM stepped a JOIN stepped b ON a.entity_id = b.entity_id AND a.I = b.I AND a.signal_id <> b.signal_id GROUP BY ALL)",
    "e_running_laplace": f"SELECT {K}, I, s, coalesce({div(f'sum(y * exp(-s * tau) * dt) OVER (PARTITION BY {K}, s ORDER BY I ROWS UNBOUNDED PRECEDING)', 'tau')}, 0) AS field FROM (SELECT *, I - min(I) OVER (PARTITION BY {K}) AS tau, coalesce(I - lag(I) OVER {W}, 0) AS dt FROM obs), (VALUES (0.001::DOUBLE), (0.003), (0.01), (0.03), (0.1), (0.3), (1.0), (3.0)) t(s)",
    "by_s": f"SELECT {K}, s, avg(abs(field)) AS m, sum(field * field) AS e FROM e_running_laplace GROUP BY ALL",
    "e_laplace_summary": f"SELECT * FROM (SELECT {K}, sum(e) AS field_energy, arg_max(s, round(m, 9)) AS dominant_s FROM by_s GROUP BY ALL) JOIN (SELECT {K}, coalesce(sum(d2y), 0) AS field_divergence FROM v_points GROUP BY ALL) USING ({K})",
    "e_extras": f"SELECT {K}, sqrt(sum(r * r)) AS realized_volatility, {div('covar_pop(I, away)', 'var_pop(I)')} AS hd_slope, avg((dy * dy + (y - mu) * (y - mu)) / 2) AS mean_hamiltonian FROM (SELECT *, y - lag(y) OVER {W} AS r, abs(y - first_value(y) OVER {W}) AS away, avg(y) OVER (PARTITION BY {K}) AS mu FROM v_points) GROUP BY ALL",
    "placed": f"SELECT {K}, y, row_number() OVER {W} AS pos, lead(y) OVER {W} AS nxt FROM obs",
    "e_layer_pairs": f"SELECT a.entity_id, a.signal_id AS signal_a, b.signal_id AS signal_b, count(*) AS n_points, {corr('a.y', 'b.y')} AS correlation, 0.5 * abs({corr('a.y', 'b.nxt')}) AS te_proxy_ab, 0.5 * abs({corr('b.y', 'a.nxt')}) AS te_proxy_ba FROM placed a JOIN placed b ON a.entity_id = b.entity_id AND a.pos = b.pos AND a.signal_id < b.signal_id GROUP BY ALL",
    # joins that look ahead, and full outer joins
    "leads": "SELECT * FROM v_lead_lag WHERE lead_lag_direction = 'A_leads_B'",
    "e_lead_degrees": "SELECT entity_id, signal_id, coalesce(o, 0) AS out_degree, coalesce(i, 0) AS in_degree FROM (SELECT entity_id, signal_a AS signal_id, count(*) AS o FROM leads GROUP BY ALL) a FULL JOIN (SELECT entity_id, signal_b AS signal_id, count(*) AS i FROM leads GROUP BY ALL) b USING (entity_id, signal_id)",
    "e_next_boundary": f"SELECT {K}, I, next_boundary, next_boundary - I AS distance FROM (SELECT o.entity_id, o.signal_id, o.I, (SELECT min(regime_boundary) FROM v_regime_boundaries r WHERE r.entity_id = o.entity_id AND r.signal_id = o.signal_id AND r.regime_boundary >= o.I) AS next_boundary FROM obs o)",
    # segments, and modes with affinities
    "gaps": f"SELECT *, I - lag(I) OVER (PARTITION BY {K}, regime_state ORDER BY I) AS gap, median(step) OVER (PARTITION BY {K}) AS usual FROM (SELECT *, I - lag(I) OVER {W} AS step FROM v_regime_state)",
    "parts": f"SELECT {K}, regime_state, segment, count(*) AS n, sum(I) AS total, max(I) - min(I) AS duration FROM (SELECT *, count(*) FILTER (gap > 1.5 * usual) OVER (PARTITION BY {K}, regime_state ORDER BY I) AS segment FROM gaps) GROUP BY ALL",
    "e_regime_segments": f"SELECT *, 100 * n_points::DOUBLE / sum(n_points) OVER (PARTITION BY {K}) AS pct_time FROM (SELECT {K}, regime_state, sum(n)::BIGINT AS n_points, count(*) AS n_segments, avg(duration) AS duration_mean, sum(total) / sum(n) AS mean_index FROM parts GROUP BY ALL)",
    "leveled": f"SELECT {K}, floor(I / 120)::BIGINT AS period, avg(y) AS level, stddev_pop(y) AS spread, {div('covar_pop(I, y)', 'var_pop(I)')} AS slope FROM obs GROUP BY ALL",
    "shares": f"SELECT {K}, period, level, spread, slope, c, m, exp(-abs(level - c) / 12) / sum(exp(-abs(level - c) / 12)) OVER (PARTITION BY {K}, period) AS p FROM leveled, (VALUES (0, 35.0::DOUBLE), (1, 50.0), (2, 65.0)) t(m, c)",
    "e_soft_modes": f"SELECT {K}, period, any_value(level) AS level, any_value(spread) AS spread, any_value(slope) AS slope, arg_max(m, p)::BIGINT AS mode_id, max(p) AS affinity, -sum(p * ln(p)) AS mode_entropy FROM shares GROUP BY ALL",
    "tall_modes": "SELECT entity_id, mode_id, affinity, mode_entropy > median(mode_entropy) OVER (PARTITION BY entity_id) AS between_modes, unnest(['level', 'spread', 'slope']) AS feature, unnest([level, spread, slope]) AS value FROM e_soft_modes",
    "e_affinity_features": "SELECT entity_id, mode_id, feature, count(value) AS n, any_value(mu) AS weighted_mean, CASE WHEN count(value) > 1 THEN sum(affinity * (value - mu) * (value - mu)) / sum(affinity) END AS weighted_variance FROM (SELECT *, sum(affinity * value) OVER g / sum(affinity) OVER g AS mu FROM tall_modes WHERE value IS NOT NULL WINDOW g AS (PARTITION BY entity_id, mode_id, feature)) GROUP BY ALL",
    "e_affinity_contrasts": "SELECT a.entity_id, a.feature, a.mode_id AS mode_a, b.mode_id AS mode_b, abs(a.weighted_mean - b.weighted_mean) AS contrast FROM e_affinity_features a JOIN e_affinity_features b ON a.entity_id = b.entity_id AND a.feature = b.feature AND a.mode_id < b.mode_id",
    "e_affinity_summary": "SELECT entity_id, avg(affinity) AS affinity_mean, stddev(affinity) AS affinity_std, min(affinity) AS affinity_min, max(affinity) - min(affinity) AS affinity_range, avg(mode_entropy) AS entropy_mean, stddev(mode_entropy) AS entropy_std, max(mode_entropy) AS entropy_max, count(*) FILTER (b) AS n_transitioning, avg(b::INT) AS transitioning_ratio, count(DISTINCT mode_id) AS n_modes FROM (SELECT *, mode_entropy > median(mode_entropy) OVER (PARTITION BY entity_id) AS b FROM e_soft_modes) GROUP BY ALL",
    "e_transition_contrasts": "SELECT *, transitioning_mean - stable_mean AS contrast FROM (SELECT entity_id, feature, avg(value) FILTER (between_modes) AS transitioning_mean, avg(value) FILTER (NOT between_modes) AS stable_mean FROM tall_modes WHERE value IS NOT NULL GROUP BY ALL)",
    "paths": f"SELECT {K}, count(*) AS n, regr_slope(affinity, step) AS trend, coalesce(sum(switch), 0)::BIGINT AS switches FROM (SELECT *, row_number() OVER o AS step, (mode_id <> lag(mode_id) OVER o)::INT AS switch FROM e_soft_modes WINDOW o AS (PARTITION BY {K} ORDER BY period)) GROUP BY ALL HAVING count(*) > 1",
    "e_affinity_dynamics": "SELECT entity_id, avg(trend) AS trend_mean, stddev_pop(trend) AS trend_std, min(trend) AS trend_min, count(*) FILTER (trend < -0.01) AS n_weakening, count(*) FILTER (trend > 0.01) AS n_strengthening, sum(switches)::BIGINT AS total_switches, count(*) FILTER (switches > 0) AS signals_with_switches, max(switches) AS max_switches, avg((switches > 0)::INT) AS switch_ratio FROM paths GROUP BY ALL",
}


def oracle(name: str, grid: str = "events") -> str:
    """The query with all expressions that it rests on, and real numbers rounded as in the DataFrame's."""
    used: dict[str, str] = {}

    def need(n: str) -> None:
        for other in re.findall(r"\b(?:FROM|JOIN|,)\s+\(?(\w+)", CTE[n]):
            if other in CTE and other != n and other not in used:
                need(other)
        used[n] = CTE[n]

    need(name)
    parts = [f"obs AS ({GRIDS[grid]})", *(f"{k} AS ({v})" for k, v in used.items())]
    columns = ", ".join(f"{settled_sql(f'CAST({c[1:]} AS DOUBLE)')} AS {c[1:]}" if c[0] == "~" else c for c in VIEWS[name][1])
    return f"WITH {', '.join(parts)} SELECT {columns} FROM {name}"
