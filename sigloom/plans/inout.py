"""Sources, sinks, exports and streams as queries: what goes out comes back, and streams equal batches; with SQL of their own."""

from __future__ import annotations

import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.operators import Signals, primitives
from sigloom.operators.catalog import KEY, settled, settled_sql
from sigloom.plans import kernel_sql
from sigloom.plans import pipeline as P
from sigloom.plans.oracle import EVENTS, K, W, oracle
from sigloom.sources import config, intake, shared
from sigloom.streaming import stateful

GROUPS = 3
COLUMNS = [f.name for f in intake.OBSERVATIONS.fields]


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.event_grid(spark, sf_dir, GROUPS)


def _told(df: DataFrame) -> DataFrame:
    return df.select(*[settled(F.col(c)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def _sql(body: str, real: str, before: str = "") -> str:
    return f"WITH {before} SELECT * REPLACE ({', '.join(f'{settled_sql(f'CAST({c} AS DOUBLE)')} AS {c}' for c in real.split())}) FROM ({body})".replace("WITH  SELECT", "SELECT")


OBS = f"obs AS ({EVENTS})"
S = f'{OBS}, s AS ({kernel_sql.SHARED["s"]})'


def scan_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns under other names: written, read, and brought to their own names."""
    at = shared.folder(spark, "scan")
    _grid(spark, sf_dir).withColumnsRenamed({"I": "index", "y": "value", "unit": "value_unit", "dimension": "index_dimension"}).write.parquet(f"{at}/grid.parquet")
    return intake.read(spark, f"{at}/grid.parquet")


def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = shared.folder(spark, "scan")
    _grid(spark, sf_dir).withColumnRenamed("I", "timestamp").write.csv(f"{at}/grid.csv", header=True)
    return intake.read(spark, f"{at}/grid.csv")


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A month of daily means: as large as one request."""
    day = _grid(spark, sf_dir).groupBy(*KEY, F.floor(F.col("I") / 24).cast("double").alias("index"))
    return day.agg((F.sum(F.col("y").cast("decimal(28,9)")).cast("double") / F.count(F.lit(1))).alias("value"))


def request_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same request as the bytes of a Parquet and of a CSV file, told apart by their first bytes."""
    pdf = _daily(spark, sf_dir).toPandas()
    parquet = io.BytesIO()
    pdf.to_parquet(parquet)
    raw = {"parquet": parquet.getvalue(), "csv": pdf.to_csv(index=False).encode()}
    parts = [config.from_bytes(spark, x).select(F.lit(kind).alias("given"), F.lit(intake.sniff(x[:4096])).alias("found"), *KEY, "I", "y") for kind, x in raw.items()]
    return _told(parts[0].unionByName(parts[1]))


def pandas_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pandas result registered as a view and asked with SQL."""
    spark.createDataFrame(_daily(spark, sf_dir).toPandas()).createOrReplaceTempView("sigloom_daily")
    return _told(spark.sql("SELECT entity_id, signal_id, count(*) AS n, max(value) AS top FROM sigloom_daily GROUP BY 1, 2"))


def exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All exports of the linked signals: the manifest's row counts, each checked against the files."""
    at = shared.folder(spark, "export")
    P.export(intake.linked_grid(spark, sf_dir), at, engines=())
    valid = P.validate(spark, at)
    rows = [(name, spark.read.parquet(f"{at}/{name}").count(), ok) for name, ok in valid.items()]
    return spark.createDataFrame(rows, "name string, n long, valid boolean")


def export_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One view written as Parquet and read back."""
    at = shared.folder(spark, "export")
    Signals(_grid(spark, sf_dir)).rounded("v_trajectory").write.parquet(at)
    return spark.read.parquet(at)


def domain_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide table with a column for each signal, melted by a domain's description."""
    wide = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_returnflag").alias("unit_id"), F.col("l_linenumber").alias("cycle")).agg(F.max("l_quantity").cast("double").alias("s1"), F.min("l_extendedprice").cast("double").alias("s2"))
    domain = config.parse('{"index": {"column": "cycle", "dimension": "time"}, "entity": {"column": "unit_id"}, "signals": {"s1": {"unit": "K"}, "s2": {"unit": "psia"}, "s9": {}}}')
    return config.melt(wide, domain).select("entity_id", "signal_id", "I", "y", "unit")


def work_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The work order of all signals of one name as base64 JSON, decoded again: signal, kernel, by how many entities it is asked for."""
    order = Signals(_grid(spark, sf_dir))["v_work_order"]
    names = ["hurst", "lyapunov", "fft", "garch", "wavelet", "rqa", "sample_entropy"]
    asked = order.groupBy("signal_id").agg(*[F.max(F.col(f"needs_{n}")).alias(n) for n in names]).collect()  # a row for each signal
    told = P.decode_order(P.encode_order({r.signal_id: [n for n in names if r[n]] for r in asked}))
    return spark.createDataFrame([(s, n) for s, found in told.items() for n in found], "signal_id string, kernel string")


def all_primitives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each of the fast primitives has."""
    parts = [df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for name, df in primitives.all_fast(Signals(_grid(spark, sf_dir))).items()]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


# ---------------------------------------------------------------- streams

CUTS = (0, 200, 450, 451, 100_000)


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid as files in the order of their indexes, read one at a time."""
    at, grid = shared.folder(spark, "stream"), _grid(spark, sf_dir)
    for a, b in zip(CUTS, CUTS[1:]):
        grid.where((F.col("I") >= a) & (F.col("I") < b)).coalesce(1).write.mode("append").parquet(at)
    return spark.readStream.schema(grid.schema).option("maxFilesPerTrigger", 1).parquet(at)


def _streamed(step, *how):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _told(stateful.run_once(spark, step(_stream(spark, sf_dir), *how), shared.folder(spark, "sink")))

    return run


def last_laplace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running fields after the last batch."""
    rows = stateful.run_once(spark, stateful.running_laplace(_stream(spark, sf_dir)), shared.folder(spark, "sink"))
    return _told(rows.groupBy(*KEY, "s").agg(F.max_by("field", "I").alias("field"), F.max("I").alias("I")))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("g"), F.col("user_id") % GROUPS).alias("entity_id"), F.col("event_type").alias("signal_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("y"))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = stateful.windowed(_events(spark, sf_dir), window="6 hours")
    return _told(m.select(F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), *KEY, "n", "mean", "std", "min", "max"))


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = stateful.sessions(_events(spark, sf_dir), gap="3 hours")
    return _told(m.select(F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), *KEY, "n", "total"))


EVENT_ROWS = "SELECT 'g' || (user_id % 3) AS entity_id, event_type AS signal_id, epoch_us(ts) AS us, CAST(value AS DOUBLE) AS y FROM events"
DAILY = f"SELECT {K}, floor(I / 24) AS d, CAST(sum(CAST(y AS DECIMAL(28,9))) AS DOUBLE) / count(*) AS value FROM obs GROUP BY ALL"
_derived = f"SELECT {K}, I, dy, d2y FROM (SELECT *, (lead(y) OVER {W} - lag(y) OVER {W}) / 2 AS dy, lead(y) OVER {W} - 2 * y + lag(y) OVER {W} AS d2y FROM s) WHERE d2y IS NOT NULL"
_laplace = f"""SELECT {K}, v AS s, sum(y * exp(-v * tau) * dt) / max(tau) AS field, max(I) AS I FROM (SELECT *, I - min(I) OVER (PARTITION BY {K}) AS tau, coalesce(I - lag(I) OVER {W}, 0) AS dt FROM s), (VALUES (0.001::DOUBLE), (0.01), (0.1), (1.0)) t(v) GROUP BY ALL"""
_kalman = f"""WITH RECURSIVE f(entity_id, signal_id, t, I, x, p, gap) AS (
    SELECT entity_id, signal_id, t, I, 1000000.001 / 1000001.001 * y, power(1 / 1000001.001, 2) * 1000000.001 + power(1000000.001 / 1000001.001, 2), y FROM s WHERE t = 0
    UNION ALL SELECT s.entity_id, s.signal_id, s.t, s.I, x + (p + 0.001) / (p + 1.001) * (y - x), power(1 - (p + 0.001) / (p + 1.001), 2) * (p + 0.001) + power((p + 0.001) / (p + 1.001), 2), y - x
    FROM f JOIN s ON s.entity_id = f.entity_id AND s.signal_id = f.signal_id AND s.t = f.t + 1) SELECT {K}, I, x AS level, p AS variance, gap AS innovation FROM f"""
_blocks = f"""SELECT entity_id, signal_id, block, any_value(last_I) AS last_I, abs(sum(p * log2(p))) / log2(6) AS permutation_entropy, count(*)::INT AS n_patterns FROM (
    SELECT {K}, block, pattern, any_value(last_I) AS last_I, count(*) / 58.0::DOUBLE AS p FROM (
      SELECT {K}, t // 60 AS block, max(I) OVER (PARTITION BY {K}, t // 60) AS last_I, (y <= y1)::INT * 4 + (y <= y2)::INT * 2 + (y1 <= y2)::INT AS pattern, t % 60 AS place
      FROM (SELECT *, lead(y) OVER {W} AS y1, lead(y, 2) OVER {W} AS y2 FROM s) WHERE t < (n // 60) * 60) WHERE place < 58 GROUP BY ALL) GROUP BY ALL"""
_needs = ("hurst", "lyapunov", "fft", "garch", "wavelet", "rqa", "sample_entropy")
_order = oracle("v_work_order")

QUERIES = {
    "s_scan_parquet": scan_parquet, "s_scan_csv": scan_csv, "s_request_bytes": request_bytes, "s_pandas_rows": pandas_rows, "s_export_manifest": exported, "s_export_table": export_table,
    "s_domain_columns": domain_columns, "s_work_orders": work_orders, "s_all_primitives": all_primitives, "s_stream_derivatives": _streamed(stateful.derivatives), "s_stream_laplace": last_laplace, "s_stream_kalman": _streamed(stateful.kalman_level),
    "s_stream_blocks": _streamed(stateful.buffered_kernel, "permutation_entropy", 60), "s_event_windows": event_windows, "s_event_sessions": event_sessions,
}
ORACLES = {
    "s_scan_parquet": f"SELECT {', '.join(COLUMNS)} FROM ({EVENTS})",
    "s_scan_csv": f"SELECT {', '.join(COLUMNS)} FROM ({EVENTS})",
    "s_request_bytes": _sql(f"SELECT given, given AS found, {K}, d AS I, value AS y FROM ({DAILY}), (VALUES ('parquet'), ('csv')) t(given)", "I y", OBS),
    "s_pandas_rows": _sql(f"SELECT {K}, count(*) AS n, max(value) AS top FROM ({DAILY}) GROUP BY ALL", "top", OBS),
    "s_export_manifest": " UNION ALL ".join(f"SELECT '{name}' AS name, count(*) AS n, true AS valid FROM ({oracle(view, 'linked')})" for name, view in P.EXPORTS.items()),
    "s_export_table": oracle("v_trajectory"),
    "s_domain_columns": "SELECT l_returnflag AS entity_id, s.signal_id, CAST(l_linenumber AS DOUBLE) AS I, CAST(CASE s.signal_id WHEN 's1' THEN q ELSE p END AS DOUBLE) AS y, CASE s.signal_id WHEN 's1' THEN 'K' ELSE 'psia' END AS unit FROM (SELECT l_returnflag, l_linenumber, max(l_quantity) AS q, min(l_extendedprice) AS p FROM lineitem GROUP BY 1, 2), (VALUES ('s1'), ('s2')) s(signal_id)",
    "s_work_orders": f"SELECT DISTINCT signal_id, kernel FROM (SELECT signal_id, unnest([{', '.join(f"'{n}'" for n in _needs)}]) AS kernel, unnest([{', '.join(f'needs_{n}' for n in _needs)}]) AS needed FROM ({_order})) WHERE needed",
    "s_all_primitives": " UNION ALL ".join(f"SELECT '{name}' AS name, count(*) AS n FROM ({oracle(name)})" for name in primitives.FAST),
    "s_stream_derivatives": _sql(_derived, "I dy d2y", S),
    "s_stream_laplace": _sql(_laplace, "s field I", S),
    "s_stream_kalman": _sql(_kalman, "I level variance innovation", S),
    "s_stream_blocks": _sql(_blocks, "last_I permutation_entropy", S),
    "s_event_windows": _sql(f'SELECT us // 21600000000 * 21600000000 AS start, us // 21600000000 * 21600000000 + 21600000000 AS "end", {K}, count(*) AS n, avg(y) AS mean, stddev(y) AS std, min(y) AS min, max(y) AS max FROM ({EVENT_ROWS}) GROUP BY ALL', "mean std min max"),
    "s_event_sessions": _sql(f"""SELECT min(us) AS start, max(us) + 10800000000 AS "end", {K}, count(*) AS n, sum(y) AS total FROM (SELECT *, sum(opens) OVER (PARTITION BY {K} ORDER BY us ROWS UNBOUNDED PRECEDING) AS session FROM (
      SELECT *, coalesce(us - lag(us) OVER (PARTITION BY {K} ORDER BY us) > 10800000000, true)::INT AS opens FROM ({EVENT_ROWS}))) GROUP BY {K}, session""", "total"),
}
