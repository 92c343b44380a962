"""Intake of observations: long rows of entity, signal, index, value, unit and the dimension of the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OBSERVATIONS = T.StructType(
    [
        T.StructField("entity_id", T.StringType()),
        T.StructField("signal_id", T.StringType()),
        T.StructField("I", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("unit", T.StringType()),
        T.StructField("dimension", T.StringType()),
    ]
)

#: Units by the class of signal that they imply.
ANALOG_UNITS = (
    "PSI kPa bar Pa atm °C K °F C F V mV kV A mA μA m cm mm km ft in m/s km/h mph ft/s m/s² g kg lb oz N kN lbf W kW MW hp J kJ MJ cal BTU Hz kHz MHz GHz "
    "rad deg ° m³/s L/min gpm cfm kg/m³ g/cm³ lb/ft³ Pa·s cP cSt % ppm ppb pH dB dBA lux lm cd Ω kΩ MΩ μF nF pF H mH μH T G mT J/K kJ/K mm/s in/s ips"
).split()
DIGITAL_UNITS = "state mode status bool boolean binary enum category class level grade rank".split()
EVENT_UNITS = "count events occurrences alarms alerts triggers clicks actions transactions".split()
#: Units between whose values nothing may be put in.
STEPWISE_UNITS = "state mode status bool boolean binary enum category class count events occurrences alarms alerts triggers".split()

#: Other names that a column may come under.
ALIASES = {"I": ("I", "i", "index", "timestamp"), "y": ("y", "value"), "entity_id": ("entity_id",), "signal_id": ("signal_id",), "unit": ("unit", "value_unit"), "dimension": ("dimension", "index_dimension")}


def observations(df: DataFrame) -> DataFrame:
    """Canonical columns; the index and the value must be there, under one of their names, else ValueError."""
    have = {c.lower(): c for c in df.columns}
    out = []
    for field in OBSERVATIONS.fields:
        found = next((have[a.lower()] for a in ALIASES[field.name] if a.lower() in have), None)
        if found is None and field.name in ("I", "y"):
            raise ValueError(f"observations need a column {field.name}; found {df.columns}")
        value = F.col(f"`{found}`") if found else F.lit("default" if field.name.endswith("_id") else None)
        out.append(value.cast(field.dataType).alias(field.name))
    return df.select(*out)


def read(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Observations from Parquet or CSV; the kind is told from the name where it is not given."""
    kind = kind or ("csv" if path.endswith((".csv", ".csv.gz")) else "parquet")
    return observations(spark.read.csv(path, header=True) if kind == "csv" else spark.read.parquet(path))


def sniff(head: bytes) -> str:
    """parquet or csv, by the first bytes."""
    if head[:4] == b"PAR1":
        return "parquet"
    line = head.split(b"\n")[0]
    return "csv" if b"," in line and all(32 <= b < 127 or b > 127 or b in (9, 13) for b in line) else "parquet"


# ---------------------------------------------------------------- grids from the driver's tables

EVENT_UNITS_BY_SIGNAL = {"click": "kPa", "error": "K", "purchase": "L/min", "signup": "count"}


def event_grid(spark: SparkSession, sf_dir: str, groups: int = 1) -> DataFrame:
    """Hourly averages of event values by type, for all users or for groups of them; sums are exact decimals, so they do not depend on the order of rows."""
    entity = F.concat(F.lit("g"), F.col("user_id") % groups) if groups > 1 else F.lit("all")
    hour = F.expr("unix_micros(CAST(ts AS TIMESTAMP)) DIV 3600000000 - 473352").cast("double")
    unit = F.create_map(*[F.lit(x) for kv in EVENT_UNITS_BY_SIGNAL.items() for x in kv])
    return (
        spark.read.parquet(f"{sf_dir}/events.parquet")
        .groupBy(entity.alias("entity_id"), F.col("event_type").alias("signal_id"), hour.alias("I"))
        .agg((F.sum(F.col("value").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))).alias("y"))
        .select("entity_id", "signal_id", "I", "y", F.try_element_at(unit, "signal_id").alias("unit"), F.lit("time").alias("dimension"))
    )


#: signal -> (decimal expression over lineitem, unit, dimension)
PLANT = {
    "feed_inlet": ("CAST(l_quantity AS DECIMAL(18,2))", "L/min", "time"),
    "feed_outlet": ("CAST(l_quantity AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))", "L/min", "time"),
    "p1": ("CAST(l_extendedprice AS DECIMAL(18,2))", "kPa", "time"),
    "v1": ("CAST(l_discount AS DECIMAL(18,2)) * 100", "m/s", "time"),
    "t1": ("CAST(l_tax AS DECIMAL(18,2)) * 1000 + 273", "K", "time"),
    "rho1": ("CAST(l_quantity AS DECIMAL(18,2)) + 900", "kg/m³", "time"),
    "vol1": ("CAST(l_linenumber AS DECIMAL(18,2))", "L", "time"),
    "force1": ("CAST(l_quantity AS DECIMAL(18,2)) * 10", "N", "time"),
    "temp_x": ("CAST(l_quantity AS DECIMAL(18,2)) + 300", "K", "space"),
}


def plant_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plant's signals with units, by day, for each return flag: one pass over lineitem, then one row for each signal."""
    day = F.expr("datediff(CAST(l_shipdate AS DATE), DATE'1995-01-01')").cast("double")
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    wide = items.groupBy(F.col("l_returnflag").alias("entity_id"), day.alias("I")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.expr(e)).cast("double").alias(s) for s, (e, _, _) in PLANT.items()]
    )
    signals = F.array(*[F.struct(F.lit(s).alias("signal_id"), (F.col(s) / F.col("n")).alias("y"), F.lit(u).alias("unit"), F.lit(d).alias("dimension")) for s, (_, u, d) in PLANT.items()])
    return wide.select("entity_id", "I", F.explode(signals).alias("x")).select("entity_id", "x.signal_id", "I", "x.y", "x.unit", "x.dimension")


#: signal -> (expression over a week's mean quantity q and number of rows n, weeks by which it comes later, unit)
LINKED = {
    "drive": ("q", 0, "L/min"),
    "follow": ("0.5 * q + 3", 10, "kPa"),
    "third": ("2 * q", 20, "kPa"),
    "oppose": ("50 - q", 3, "K"),
    "state": ("n", 0, "state"),
}


def linked_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly signals for each return flag, of which some are others' copies some weeks later, so that drivers, chains and clusters exist."""
    week = F.expr("datediff(CAST(l_shipdate AS DATE), DATE'1992-01-06') DIV 7")
    weeks = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_returnflag").alias("entity_id"), week.alias("week")).agg(
        (F.sum(F.expr("CAST(l_quantity AS DECIMAL(18,2))")).cast("double") / F.count(F.lit(1))).alias("q"), (F.count(F.lit(1)) % 4).cast("double").alias("n")
    )
    signals = F.array(*[F.struct(F.lit(s).alias("signal_id"), (F.col("week") + k).cast("double").alias("I"), F.expr(e).cast("double").alias("y"), F.lit(u).alias("unit")) for s, (e, k, u) in LINKED.items()])
    return weeks.select("entity_id", F.explode(signals).alias("x")).select("entity_id", "x.*", F.lit("time").alias("dimension"))
