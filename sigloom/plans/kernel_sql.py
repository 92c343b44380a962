"""DuckDB SQL for those kernels on signals and pairs that SQL can express: each is written from the definition, over `obs`."""

from __future__ import annotations

from sigloom.operators.catalog import settled_sql
from sigloom.operators.engines import KERNELS
from sigloom.plans.oracle import EVENTS, K, W

NAN = "NULL::DOUBLE"
PI = "3.141592653589793"

#: What several kernels rest on.
SHARED = {
    "s": f"SELECT entity_id, signal_id, I, y, row_number() OVER {W} - 1 AS t, count(*) OVER (PARTITION BY {K}) AS n, y - avg(y) OVER (PARTITION BY {K}) AS d FROM obs WHERE I IS NOT NULL AND y IS NOT NULL",
    "sizes": f"SELECT {K}, max(n) AS n FROM s GROUP BY ALL",
    # discrete Fourier transform by its sum; the angle is taken modulo a whole turn first
    "dft": f"""SELECT {K}, n, k, sum(d * cos(2 * {PI} * ((k * t) % n) / n)) AS re, -sum(d * sin(2 * {PI} * ((k * t) % n) / n)) AS im
      FROM (SELECT s.*, unnest(range(0, n // 2 + 1)) AS k FROM s) GROUP BY ALL""",
    "power": f"SELECT {K}, n, k, k::DOUBLE / n AS f, re * re + im * im AS p FROM dft WHERE k < n // 2",
    "lags": f"""SELECT a.entity_id, a.signal_id, a.n, k, sum(a.d * b.d) / (any_value(a.n - k) * any_value(v)) AS r
      FROM (SELECT s.*, var_pop(y) OVER (PARTITION BY {K}) AS v, unnest(range(0, least(n, greatest(n // 2, 50) + 1))) AS k FROM s) a JOIN s b ON a.entity_id = b.entity_id AND a.signal_id = b.signal_id AND b.t = a.t + a.k GROUP BY ALL""",
    "triples": f"SELECT * FROM (SELECT *, lead(y) OVER {W} AS y1, lead(y, 2) OVER {W} AS y2 FROM s) WHERE y2 IS NOT NULL",
    "patterns": "SELECT *, (y <= y1)::INT * 4 + (y <= y2)::INT * 2 + (y1 <= y2)::INT AS pattern FROM triples",
    "met": "SELECT a.entity_id, a.signal_id AS signal_a, b.signal_id AS signal_b, a.I, a.y AS ya, b.y AS yb FROM s a JOIN s b ON a.entity_id = b.entity_id AND a.I = b.I AND a.signal_id < b.signal_id",
}
AB = "entity_id, signal_a, signal_b"
RQA = "recurrence_rate determinism laminarity rqa_entropy trapping_time max_diagonal avg_diagonal".split()


def moments(rows: str, by: str) -> str:
    """GARCH parameters by moments of squared differences (e, and the one before as e0), grouped."""
    return f"""SELECT {by}, m * greatest(1 - a - b, 0.001) AS garch_omega, a AS garch_alpha, b AS garch_beta, a + b AS garch_persistence, {NAN} AS garch_loglik, 'moments' AS garch_method
      FROM (SELECT *, least(greatest(l - a, 0), 0.99) AS b FROM (SELECT *, least(greatest(0.15 * l, 0.01), 0.3) AS a FROM (
        SELECT {by}, avg(e) AS m, CASE WHEN stddev_pop(e) > 0 THEN least(greatest(corr(e0, e), 0), 0.999) ELSE 0.5 END AS l FROM ({rows}) GROUP BY ALL)))"""


def recurrent(name: str) -> str:
    return f"""{name} AS (SELECT a.entity_id, a.signal_id, a.t AS i, b.t AS j FROM near a JOIN near b ON a.entity_id = b.entity_id AND a.signal_id = b.signal_id
      WHERE sqrt((a.y - b.y) * (a.y - b.y) + (a.y1 - b.y1) * (a.y1 - b.y1) + (a.y2 - b.y2) * (a.y2 - b.y2)) < 0.1 * a.width)"""


#: kernel -> SQL over the shared expressions
KERNEL_SQL: dict[str, str] = {
    "hurst_rs": f"""WITH w AS (SELECT {K}, n, n >> k AS w FROM sizes, range(0, 30) r(k) WHERE n >= 20 AND k <= floor(log2(n / 10.0)) AND n >> k >= 10),
      g AS (SELECT s.entity_id, s.signal_id, w, t, y, t // w AS seg, y - avg(y) OVER (PARTITION BY s.entity_id, s.signal_id, w, t // w) AS dev FROM s JOIN w USING ({K}) WHERE t < (w.n // w) * w),
      c AS (SELECT *, sum(dev) OVER (PARTITION BY {K}, w, seg ORDER BY t ROWS UNBOUNDED PRECEDING) AS walk FROM g),
      r AS (SELECT {K}, w, seg, max(walk) - min(walk) AS r, stddev(y) AS sd FROM c GROUP BY ALL),
      f AS (SELECT {K}, w, avg(r / sd) AS f FROM r WHERE sd > 0 GROUP BY ALL)
      SELECT {K}, least(greatest(regr_slope(ln(f), ln(w)), 0), 1) AS hurst, regr_r2(ln(f), ln(w)) AS hurst_r2, 'rs' AS hurst_method FROM f GROUP BY ALL""",
    "hurst": f"""WITH RECURSIVE ws(w) AS (SELECT 10 UNION ALL SELECT (w * 1.5)::DOUBLE::INT - CASE WHEN (w * 1.5)::DOUBLE::INT > w * 1.5 THEN 1 ELSE 0 END FROM ws WHERE w < 100000),
      walk AS (SELECT {K}, n, t, sum(d) OVER (PARTITION BY {K} ORDER BY t ROWS UNBOUNDED PRECEDING) AS walk FROM s),
      g AS (SELECT {K}, w, t // w AS seg, var_pop(walk) - pow(covar_pop(walk, t), 2) / var_pop(t) AS left_over FROM walk, ws WHERE w <= n // 4 AND t < (n // w) * w GROUP BY ALL),
      f AS (SELECT {K}, w, sqrt(avg(left_over)) AS f FROM g GROUP BY ALL)
      SELECT {K}, CASE WHEN count(f) < 3 THEN 0.5 ELSE least(greatest(regr_slope(ln(f), ln(w)), 0), 1) END AS hurst, CASE WHEN count(f) < 3 THEN 0 ELSE regr_r2(ln(f), ln(w)) END AS hurst_r2, 'dfa' AS hurst_method
      FROM sizes LEFT JOIN f USING ({K}) GROUP BY ALL""",
    "acf_decay": f"""WITH r AS (SELECT {K}, count(*) FILTER (r > 0.01 AND k <= 50) AS m, -regr_slope(ln(CASE WHEN r > 0.01 THEN r END), CASE WHEN r > 0.01 THEN k END) FILTER (k <= 50) AS rate, max(r) FILTER (k = 1) AS a1, max(r) FILTER (k = 5) AS a5 FROM lags WHERE n >= 60 GROUP BY ALL)
      SELECT {K}, CASE WHEN m > 5 THEN rate END AS acf_decay_rate, CASE WHEN m <= 5 THEN NULL WHEN rate > 0 THEN ln(2) / rate WHEN rate <= 0 THEN 'Infinity'::DOUBLE END AS half_life, a1 AS acf_1, a5 AS acf_5 FROM sizes LEFT JOIN r USING ({K})""",
    "spectral_slope": f"SELECT {K}, -regr_slope(ln(p + 1e-10), ln(f)) AS slope, regr_r2(ln(p + 1e-10), ln(f)) AS slope_r2 FROM power WHERE f > 0.01 AND f < 0.4 GROUP BY ALL",
    "fft": f"""WITH q AS (SELECT *, p / sum(p) OVER (PARTITION BY {K}) AS w FROM power WHERE k > 0), c AS (SELECT *, sum(w) OVER (PARTITION BY {K} ORDER BY k ROWS UNBOUNDED PRECEDING) AS upto, sum(f * w) OVER (PARTITION BY {K}) AS centre FROM q)
      SELECT {K}, any_value(centre) AS spectral_centroid, sqrt(sum((f - centre) * (f - centre) * w)) AS spectral_bandwidth, sum(w) FILTER (f < 0.1) / sum(w) FILTER (f >= 0.1) AS low_high_ratio,
        min(f) FILTER (upto >= 0.85) AS spectral_rolloff, arg_max(f, p) AS dominant_freq, sum(p) AS total_power FROM c GROUP BY ALL""",
    "hilbert_points": f"""WITH h AS (SELECT s.entity_id, s.signal_id, s.t, any_value(s.I) AS I, any_value(d) AS x, 2.0 / any_value(s.n) * sum(re * sin(2 * {PI} * ((k * t) % s.n) / s.n) + im * cos(2 * {PI} * ((k * t) % s.n) / s.n)) AS z
        FROM s JOIN dft USING ({K}) WHERE k > 0 AND 2 * k < s.n GROUP BY ALL),
      a AS (SELECT *, sqrt(x * x + z * z) AS amplitude, atan2(z, x) AS angle FROM h),
      u AS (SELECT *, coalesce(angle - lag(angle) OVER o, 0) AS step, I - lag(I) OVER o AS gap FROM a WINDOW o AS (PARTITION BY {K} ORDER BY t)),
      p AS (SELECT *, first_value(angle) OVER o + sum(step - 2 * {PI} * floor((step + {PI}) / (2 * {PI}))) OVER o AS phase, median(gap) OVER (PARTITION BY {K}) AS dt FROM u WINDOW o AS (PARTITION BY {K} ORDER BY t ROWS UNBOUNDED PRECEDING)),
      g AS (SELECT *, lag(phase) OVER o AS before, lead(phase) OVER o AS after FROM p WINDOW o AS (PARTITION BY {K} ORDER BY t))
      SELECT {K}, I, amplitude, phase, coalesce((after - before) / 2, after - phase, phase - before) / (2 * {PI} * dt + 1e-10) AS frequency FROM g""",
    "sample_entropy": f"""WITH v AS (SELECT *, lead(y) OVER {W} AS y1, lead(y, 2) OVER {W} AS y2, 0.2 * stddev(y) OVER (PARTITION BY {K}) AS r FROM s),
      m AS (SELECT a.entity_id, a.signal_id, count(*) FILTER (a.t < a.n - 2 AND b.t < a.n - 2) AS two, count(*) FILTER (a.t < a.n - 3 AND b.t < a.n - 3 AND abs(a.y2 - b.y2) < a.r) AS three
        FROM v a JOIN v b ON a.entity_id = b.entity_id AND a.signal_id = b.signal_id AND a.t < b.t WHERE abs(a.y - b.y) < a.r AND abs(a.y1 - b.y1) < a.r GROUP BY ALL)
      SELECT {K}, CASE WHEN two = 0 THEN {NAN} WHEN three = 0 THEN 'Infinity'::DOUBLE ELSE -ln(three / two::DOUBLE) END AS sample_entropy FROM m""",
    "permutation_entropy": f"""WITH c AS (SELECT {K}, pattern, count(*) AS c FROM patterns GROUP BY ALL), p AS (SELECT {K}, c / sum(c) OVER (PARTITION BY {K}) AS p FROM c)
      SELECT {K}, abs(sum(p * log2(p))) / log2(6) AS permutation_entropy, count(*)::INT AS n_patterns FROM p GROUP BY ALL""",
    "entropy_rate": f"""WITH a AS (SELECT {K}, n, unnest(range(0, greatest(0, n - 100) + 1, 50)) AS a FROM sizes),
      c AS (SELECT x.entity_id, x.signal_id, a, pattern, count(*) AS c FROM patterns x JOIN a USING ({K}) WHERE t >= a AND t < least(a + 98, x.n - 2) GROUP BY ALL),
      p AS (SELECT {K}, a, c / sum(c) OVER (PARTITION BY {K}, a) AS p FROM c), e AS (SELECT {K}, a, abs(sum(p * log2(p))) / log2(6) AS e FROM p GROUP BY ALL)
      SELECT e.entity_id, e.signal_id, s.I, e AS current_entropy, coalesce(e - lag(e) OVER (PARTITION BY e.entity_id, e.signal_id ORDER BY a), 0) AS entropy_rate FROM e JOIN s ON s.entity_id = e.entity_id AND s.signal_id = e.signal_id AND s.t = least(a + 50, s.n - 1)""",
    "embedding": f"""WITH z AS (SELECT {K}, any_value(n) AS n, min(k) FILTER (r < 0 AND k <= n // 2) AS k FROM lags GROUP BY ALL), e AS (SELECT {K}, coalesce(k, greatest(1, n // 10)) AS delay FROM z)
      SELECT {K}, delay::INT AS embedding_delay, greatest(2, least(floor(log2(delay + 1)) + 2, 10))::INT AS embedding_dim FROM e""",
    "basin": f"""WITH v AS (SELECT *, n - 2 AS m FROM triples), c AS (SELECT {K}, avg(y) AS c0, avg(y1) AS c1, avg(y2) AS c2 FROM v WHERE t < greatest(5, m * 3 // 10) GROUP BY ALL),
      d AS (SELECT v.*, sqrt((y - c0) * (y - c0) + (y1 - c1) * (y1 - c1) + (y2 - c2) * (y2 - c2)) AS gap FROM v JOIN c USING ({K})),
      l AS (SELECT {K}, avg(gap) + 3 * stddev_pop(gap) AS lim, stddev_pop(gap) AS sd FROM d WHERE t < greatest(5, m * 3 // 10) GROUP BY ALL),
      e AS (SELECT {K}, any_value(lim) AS lim, any_value(sd) AS sd, avg(gap) FILTER (t >= m - greatest(5, m // 10)) AS now, avg((gap <= lim)::INT) AS stability, avg(gap) AS mean_distance FROM d JOIN l USING ({K}) GROUP BY ALL)
      SELECT {K}, CASE WHEN now <= lim THEN 'home' ELSE 'escaped' END AS basin, stability, 1 / (1 + exp(-least(greatest((now - lim) / greatest(sd, 1e-10), -50), 50))) AS transition_prob, mean_distance FROM e""",
    "garch_moments": moments(f"SELECT {K}, e, lag(e) OVER (PARTITION BY {K} ORDER BY t) AS e0 FROM (SELECT *, power(y - lag(y) OVER {W}, 2) AS e FROM s) WHERE e IS NOT NULL", K),
    "garch_moments_windows": f"""WITH v AS (SELECT *, unnest(range(greatest(0, (t - 200 + 20) // 20)::BIGINT, least(t // 20, (n - 200) // 20)::BIGINT + 1)) AS "window" FROM s WHERE n >= 200),
      e AS (SELECT *, power(y - lag(y) OVER (PARTITION BY {K}, "window" ORDER BY t), 2) AS e FROM v),
      m AS ({moments(f'SELECT {K}, "window", e, lag(e) OVER (PARTITION BY {K}, "window" ORDER BY t) AS e0 FROM e WHERE e IS NOT NULL', f'{K}, "window"')})
      SELECT m.entity_id, m.signal_id, "window"::INT AS "window", s.I AS centre, garch_omega, garch_alpha, garch_beta, garch_persistence, garch_loglik, garch_method FROM m JOIN s ON s.entity_id = m.entity_id AND s.signal_id = m.signal_id AND s.t = 20 * "window" + 100""",
    "rqa": f"""WITH near AS (SELECT t.*, max(s.y) OVER (PARTITION BY t.entity_id, t.signal_id) - min(s.y) OVER (PARTITION BY t.entity_id, t.signal_id) AS width0, w.width FROM triples t JOIN s USING (entity_id, signal_id, t) JOIN (SELECT {K}, max(y) - min(y) AS width FROM s GROUP BY ALL) w USING ({K})),
      {recurrent("near_pairs")},
      off AS (SELECT {K}, count(*) FILTER (i <> j) AS hits, (max(i) + 1) AS m FROM near_pairs GROUP BY ALL),
      diag AS (SELECT {K}, count(*) AS len FROM (SELECT {K}, j - i AS k, i - row_number() OVER (PARTITION BY {K}, j - i ORDER BY i) AS island FROM near_pairs WHERE j > i) GROUP BY {K}, k, island),
      tall AS (SELECT {K}, count(*) AS len FROM (SELECT {K}, i, j - row_number() OVER (PARTITION BY {K}, i ORDER BY j) AS island FROM near_pairs) GROUP BY {K}, i, island),
      dl AS (SELECT {K}, sum(len) AS total, max(len) AS longest, avg(len) AS mean FROM diag WHERE len >= 2 GROUP BY ALL),
      de AS (SELECT {K}, -sum(p * ln(p)) AS h FROM (SELECT {K}, count(*) / sum(count(*)) OVER (PARTITION BY {K}) AS p FROM diag WHERE len >= 2 GROUP BY {K}, len) GROUP BY ALL),
      tl AS (SELECT {K}, sum(len) AS total, avg(len) AS mean FROM tall WHERE len >= 2 GROUP BY ALL)
      SELECT {K}, {", ".join(f"CASE WHEN n >= 50 THEN {c} END AS {c}" for c in RQA)} FROM sizes LEFT JOIN (SELECT {K}, hits / (m * (m - 1)) AS recurrence_rate, CASE WHEN hits > 0 THEN least(1, coalesce(dl.total, 0) / hits) ELSE 0 END AS determinism, CASE WHEN hits > 0 THEN least(1, coalesce(tl.total, 0) / hits) ELSE 0 END AS laminarity,
        coalesce(h, 0) AS rqa_entropy, coalesce(tl.mean, 0) AS trapping_time, coalesce(dl.longest, 0)::DOUBLE AS max_diagonal, coalesce(dl.mean, 0) AS avg_diagonal
      FROM off LEFT JOIN dl USING ({K}) LEFT JOIN de USING ({K}) LEFT JOIN tl USING ({K})) USING ({K})""",
    "laplace_series": f"""WITH v AS (SELECT *, lag(y) OVER {W} AS b1, lag(y, 2) OVER {W} AS b2, lag(y, 3) OVER {W} AS b3, lead(y) OVER {W} AS a1, lead(y, 2) OVER {W} AS a2, lead(y, 3) OVER {W} AS a3 FROM s WHERE n >= 4),
      g AS (SELECT *, CASE WHEN t = 0 THEN -1.5 * y + 2 * a1 - 0.5 * a2 WHEN t = n - 1 THEN 1.5 * y - 2 * b1 + 0.5 * b2 ELSE (a1 - b1) / 2 END AS gradient,
        CASE WHEN t = 0 THEN 2 * y - 5 * a1 + 4 * a2 - a3 WHEN t = n - 1 THEN 2 * y - 5 * b1 + 4 * b2 - b3 ELSE a1 - 2 * y + b1 END AS laplacian FROM v)
      SELECT {K}, I, gradient, laplacian, CASE WHEN laplacian > 0.1 THEN 'source' WHEN laplacian < -0.1 THEN 'sink' ELSE 'neutral' END AS field FROM g""",
    "regime_detection": f"""WITH w AS (SELECT {K}, n, w, unnest(range(0, n - w + 1, w // 2)) AS a FROM (SELECT {K}, n, greatest(20, n // 20) AS w FROM sizes) WHERE n >= 2 * w),
      m AS (SELECT w.entity_id, w.signal_id, a, avg(y) AS m, min(I) AS start FROM w JOIN s USING ({K}) WHERE t >= a AND t < a + w GROUP BY ALL),
      j AS (SELECT *, coalesce(abs(m - lag(m) OVER (PARTITION BY {K} ORDER BY a)) > 2 * stddev_pop(m) OVER (PARTITION BY {K}), true) AS jump FROM m)
      SELECT {K}, (row_number() OVER (PARTITION BY {K} ORDER BY a) - 1)::INT AS regime, start, m AS mean FROM j WHERE jump""",
    "copula": f"""WITH r AS (SELECT {AB}, ya, yb, count(*) OVER (PARTITION BY {AB}) AS n, row_number() OVER (PARTITION BY {AB} ORDER BY ya, I) - 1 AS ra, row_number() OVER (PARTITION BY {AB} ORDER BY yb, I) - 1 AS rb FROM met),
      u AS (SELECT *, ra / n::DOUBLE + 0.5::DOUBLE / n AS u, rb / n::DOUBLE + 0.5::DOUBLE / n AS v FROM r),
      x AS (SELECT a.entity_id, a.signal_a, a.signal_b, count(*) AS swaps FROM u a JOIN u b ON a.entity_id = b.entity_id AND a.signal_a = b.signal_a AND a.signal_b = b.signal_b AND a.ra < b.ra AND a.rb > b.rb GROUP BY ALL),
      q AS (SELECT {AB}, any_value(n) AS n, {", ".join(f"avg((u <= {q}::DOUBLE AND v <= {q}::DOUBLE)::INT) / {q}::DOUBLE AS l{i}, avg((u > 1 - {q}::DOUBLE AND v > 1 - {q}::DOUBLE)::INT) / {q}::DOUBLE AS h{i}" for i, q in enumerate(("0.05", "0.10", "0.15")))}, corr(u, v) AS spearman FROM u GROUP BY ALL)
      SELECT {AB}, CASE WHEN n >= 20 THEN (l0 + l1 + l2) / 3 END AS tail_lower, CASE WHEN n >= 20 THEN (h0 + h1 + h2) / 3 END AS tail_upper, CASE WHEN n >= 20 THEN 1 - 4 * coalesce(swaps, 0)::DOUBLE / (n * (n - 1)) END AS kendall_tau, CASE WHEN n >= 20 THEN spearman END AS spearman FROM q LEFT JOIN x USING ({AB})""",
    "divergence": f"""WITH l AS (SELECT {AB}, count(*) AS n, least(min(ya), min(yb)) AS lo, greatest(max(ya), max(yb)) AS hi FROM met GROUP BY ALL),
      v AS (SELECT met.entity_id, met.signal_a, met.signal_b, n, lo, hi, unnest([ya, yb]) AS y, unnest([1, 0]) AS a FROM met JOIN l USING ({AB})),
      c AS (SELECT {AB}, n, least(49, floor((y - lo) / (hi - lo) * 50))::INT AS bin, sum(a) AS ca, sum(1 - a) AS cb FROM v GROUP BY ALL),
      g AS (SELECT l.entity_id, l.signal_a, l.signal_b, l.n, b.bin, coalesce(ca, 0) / l.n::DOUBLE + 1e-10 AS p, coalesce(cb, 0) / l.n::DOUBLE + 1e-10 AS q FROM l CROSS JOIN range(0, 50) b(bin) LEFT JOIN c ON c.entity_id = l.entity_id AND c.signal_a = l.signal_a AND c.signal_b = l.signal_b AND c.bin = b.bin),
      h AS (SELECT {AB}, p / sum(p) OVER (PARTITION BY {AB}) AS p, q / sum(q) OVER (PARTITION BY {AB}) AS q FROM g),
      k AS (SELECT {AB}, (sum(p * ln(p / q)) + sum(q * ln(q / p))) / 2 AS kl, (sum(p * ln(2 * p / (p + q))) + sum(q * ln(2 * q / (p + q)))) / 2 AS js FROM h GROUP BY ALL),
      e AS (SELECT {AB}, y, n, sum(a) OVER o AS below_a, sum(1 - a) OVER o AS below_b, lead(y) OVER (PARTITION BY {AB} ORDER BY y) AS next FROM v WINDOW o AS (PARTITION BY {AB} ORDER BY y RANGE UNBOUNDED PRECEDING)),
      w AS (SELECT {AB}, sum(abs(below_a - below_b) / n::DOUBLE * (next - y)) AS w FROM e WHERE next IS NOT NULL GROUP BY ALL)
      SELECT {AB}, CASE WHEN n >= 10 THEN kl END AS kl_symmetric, CASE WHEN n >= 10 THEN js END AS js, CASE WHEN n >= 10 THEN w END AS wasserstein FROM l LEFT JOIN k USING ({AB}) LEFT JOIN w USING ({AB})""",
}
# signals of an entity as standardised rows over all its indexes, what is missing at the mean; distances between them
STANDARD = f"""g AS (SELECT i.entity_id, i.I, n.signal_id, coalesce(s.d, 0) AS d FROM (SELECT DISTINCT entity_id, I FROM s) i JOIN (SELECT DISTINCT {K} FROM s) n USING (entity_id) LEFT JOIN s USING (entity_id, signal_id, I)),
      z AS (SELECT *, d / nullif(stddev_pop(d) OVER (PARTITION BY {K}), 0) AS z FROM g),
      w AS (SELECT a.entity_id, a.signal_id AS p, b.signal_id AS q, sqrt(sum((coalesce(a.z, 0) - coalesce(b.z, 0)) * (coalesce(a.z, 0) - coalesce(b.z, 0)))) AS w FROM z a JOIN z b ON a.entity_id = b.entity_id AND a.I = b.I AND a.signal_id <> b.signal_id GROUP BY ALL)"""
# an edge is in the least spanning tree where no way of shorter edges joins its ends; edges point away from the first signal
KERNEL_SQL["mst"] = f"""WITH RECURSIVE {STANDARD},
      reach(entity_id, p, q, w, node) AS (SELECT entity_id, p, q, w, p FROM w UNION SELECT r.entity_id, r.p, r.q, r.w, e.q FROM reach r JOIN w e ON e.entity_id = r.entity_id AND e.p = r.node AND e.w < r.w),
      tree AS (SELECT w.* FROM w WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.entity_id = w.entity_id AND r.p = w.p AND r.q = w.q AND r.node = w.q)),
      out(entity_id, node, source, w, depth) AS (SELECT entity_id, min(p), NULL::VARCHAR, NULL::DOUBLE, 0 FROM tree GROUP BY entity_id UNION ALL SELECT t.entity_id, t.q, t.p, t.w, depth + 1 FROM out o JOIN tree t ON t.entity_id = o.entity_id AND t.p = o.node AND t.q IS DISTINCT FROM o.source),
      deg AS (SELECT entity_id, p, count(*)::INT AS degree FROM tree GROUP BY ALL),
      ends AS (SELECT entity_id, coalesce(list(p ORDER BY p) FILTER (degree >= 3), []) AS hubs, coalesce(list(p ORDER BY p) FILTER (degree = 1), []) AS leaves FROM deg GROUP BY ALL)
      SELECT o.entity_id, source, node AS target, w AS distance, a.degree AS source_degree, b.degree AS target_degree, hubs, leaves FROM out o JOIN deg a ON a.entity_id = o.entity_id AND a.p = source JOIN deg b ON b.entity_id = o.entity_id AND b.p = node JOIN ends ON ends.entity_id = o.entity_id WHERE source IS NOT NULL"""
# at most five neighbours each; here signals are told apart at each index, so it is their values there that are standardised
KERNEL_SQL["lof"] = f"""WITH m AS (SELECT {K}, avg(y) AS mean FROM s GROUP BY ALL),
      g AS (SELECT i.entity_id, i.I, m.signal_id, coalesce(s.y, m.mean) AS v FROM (SELECT DISTINCT entity_id, I FROM s) i JOIN m USING (entity_id) LEFT JOIN s USING (entity_id, signal_id, I)),
      z AS (SELECT *, (v - avg(v) OVER (PARTITION BY entity_id, I)) / coalesce(nullif(stddev_pop(v) OVER (PARTITION BY entity_id, I), 0), 1) AS z FROM g),
      w AS (SELECT a.entity_id, a.signal_id AS p, b.signal_id AS q, sqrt(sum((a.z - b.z) * (a.z - b.z))) AS w FROM z a JOIN z b ON a.entity_id = b.entity_id AND a.I = b.I AND a.signal_id <> b.signal_id GROUP BY ALL),
      n AS (SELECT *, row_number() OVER (PARTITION BY entity_id, p ORDER BY w) AS nth, least(5, count(*) OVER (PARTITION BY entity_id, p)) AS k FROM w),
      r AS (SELECT entity_id, p, max(w) AS reach FROM n WHERE nth <= k GROUP BY ALL),
      d AS (SELECT n.entity_id, n.p, 1 / greatest(avg(greatest(r.reach, n.w)), 1e-10) AS density FROM n JOIN r ON r.entity_id = n.entity_id AND r.p = n.q WHERE nth <= k GROUP BY ALL),
      f AS (SELECT n.entity_id, n.p AS signal_id, least(avg(b.density) / any_value(a.density), 10) AS lof_score FROM n JOIN d a ON a.entity_id = n.entity_id AND a.p = n.p JOIN d b ON b.entity_id = n.entity_id AND b.p = n.q WHERE nth <= k GROUP BY ALL)
      SELECT entity_id, signal_id, lof_score, lof_score > 1.5 AS is_outlier FROM f"""
KERNEL_SQL["flicker"] = f"""WITH c AS (SELECT {K}, t // 2 AS c, sqrt(avg(y * y)) AS rms FROM s WHERE t < n // 2 * 2 GROUP BY ALL), d AS (SELECT *, abs(rms - avg(rms) OVER (PARTITION BY {K})) / 50 * 100 AS d, (rms - avg(rms) OVER (PARTITION BY {K})) / 50 * 100 AS e FROM c)
      SELECT {K}, quantile_cont(d, 0.99) AS pst, max(d) AS max_fluctuation_percent, stddev_pop(e) AS std_fluctuation_percent FROM d GROUP BY ALL"""
KERNEL_SQL["voltage_events"] = f"""WITH c AS (SELECT {K}, t // 4 AS c, any_value(n // 4) AS m, sqrt(avg(y * y)) / 50 AS r FROM s WHERE t < n // 4 * 4 GROUP BY ALL),
      k AS (SELECT *, CASE WHEN r < 0.1 THEN 'interruption' WHEN r < 0.9 THEN 'sag' WHEN r > 1.1 THEN 'swell' ELSE '' END AS kind FROM c),
      i AS (SELECT *, c - row_number() OVER (PARTITION BY {K}, kind ORDER BY c) AS island FROM k)
      SELECT {K}, kind, min(c) / 50.0::DOUBLE AS start, count(*) / 50.0::DOUBLE AS duration FROM i WHERE kind <> '' GROUP BY {K}, kind, island HAVING max(c) < max(m) - 1"""
# a local level with noises 0.1 and 1, forward and back: one point of each signal a step
KALMAN = f"""f(entity_id, signal_id, t, n, I, x, p, gap) AS (SELECT entity_id, signal_id, t, n, I, y * 1.1 / 2.1, 1.1 * power(1 / 2.1, 2) + power(1.1 / 2.1, 2), y FROM s WHERE t = 0
      UNION ALL SELECT s.entity_id, s.signal_id, s.t, s.n, s.I, x + (p + 0.1) / (p + 1.1) * (y - x), power(1 - (p + 0.1) / (p + 1.1), 2) * (p + 0.1) + power((p + 0.1) / (p + 1.1), 2), y - x FROM f JOIN s ON s.entity_id = f.entity_id AND s.signal_id = f.signal_id AND s.t = f.t + 1)"""
KERNEL_SQL["kalman"] = f"""WITH RECURSIVE {KALMAN},
      b(entity_id, signal_id, t, x, p) AS (SELECT entity_id, signal_id, t, x, p FROM f WHERE t = n - 1
        UNION ALL SELECT f.entity_id, f.signal_id, f.t, f.x + f.p / (f.p + 0.1) * (b.x - f.x), f.p + power(f.p / (f.p + 0.1), 2) * (b.p - f.p - 0.1) FROM b JOIN f ON f.entity_id = b.entity_id AND f.signal_id = b.signal_id AND f.t = b.t - 1)
      SELECT f.entity_id, f.signal_id, I, f.x AS level, f.p AS variance, gap AS innovation, b.x AS smoothed, b.p AS smoothed_variance FROM f JOIN b USING ({K}, t)"""
KERNEL_SQL["kalman_noise"] = f"""WITH RECURSIVE {KALMAN}
      SELECT {K}, CASE WHEN count(*) >= 3 THEN var_samp(step) END AS process_noise, CASE WHEN count(*) >= 3 THEN var_samp(left_over) END AS measurement_noise
      FROM (SELECT f.entity_id, f.signal_id, x - lag(x) OVER (PARTITION BY {K} ORDER BY t) AS step, y - x AS left_over FROM f JOIN s USING ({K}, t)) GROUP BY ALL"""
KERNEL_SQL["hilbert"] = f"""WITH points AS ({KERNEL_SQL["hilbert_points"]})
      SELECT {K}, {", ".join(f"{f}({c}) AS {c}_{k}" for c in ("amplitude", "phase", "frequency") for k, f in (("mean", "avg"), ("std", "stddev_pop")))} FROM points GROUP BY ALL"""


def columns(name: str) -> list[tuple[str, str]]:
    """Names and types of a kernel's columns, of the windowed ones too."""
    k = KERNELS[name.removesuffix("_windows")]
    schema = f"entity_id string, signal_id string, window int, centre double, {k.columns}" if name.endswith("_windows") else k.schema
    return [tuple(c.split()) for c in schema.split(", ")]


def kernel_oracle(name: str) -> str:
    parts = ", ".join([f"obs AS ({EVENTS})", *(f"{k} AS ({v})" for k, v in SHARED.items())])
    told = ", ".join(f"{settled_sql(f'CAST({c} AS DOUBLE)')} AS {c}" if kind == "double" else f'"{c}"' for c, kind in columns(name))
    return f"WITH {parts} SELECT {told} FROM ({KERNEL_SQL[name]})"


ORACLES = {f"k_{name}": kernel_oracle(name) for name in KERNEL_SQL}
ORACLES["e_reference_divergence"] = f"SELECT entity_id, signal_a, signal_b, js, wasserstein FROM ({ORACLES['k_divergence']}) WHERE (entity_id, signal_a) IN (SELECT entity_id, min(signal_id) FROM ({EVENTS}) GROUP BY 1)"
