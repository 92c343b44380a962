"""Domain configuration: what the columns of a wide table are, and what their signals mean."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.sources.intake import observations


@dataclass(frozen=True)
class Domain:
    index: str = "I"
    dimension: str = "time"
    entity: str = "entity_id"
    units: dict[str, str | None] = field(default_factory=dict)
    constants: dict = field(default_factory=dict)


def parse(text: str) -> Domain:
    """From JSON, or from YAML where its library is there."""
    try:
        said = json.loads(text)
    except json.JSONDecodeError:
        import yaml

        said = yaml.safe_load(text)
    index = said.get("index") or {}
    signals = said.get("signals") or {}
    if isinstance(signals, list):
        signals = {s["name"]: s for s in signals}
    return Domain(index.get("column", "I"), index.get("dimension", "time"), (said.get("entity") or {}).get("column", "entity_id"), {k: (v or {}).get("unit") for k, v in signals.items()}, said.get("constants") or {})


def load(spark: SparkSession, path: str) -> Domain:
    """Through Spark's readers, so that any store will do."""
    return parse("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def melt(wide: DataFrame, domain: Domain) -> DataFrame:
    """Observations of a wide table with a column for each signal: one pass, no shuffle."""
    have = [s for s in domain.units if s in wide.columns]
    if not have:
        raise ValueError(f"none of the signals {sorted(domain.units)} is a column")
    cell = F.array(*[F.struct(F.lit(s).alias("signal_id"), F.col(f"`{s}`").cast("double").alias("y"), F.lit(domain.units[s]).cast("string").alias("unit")) for s in have])
    entity = F.col(f"`{domain.entity}`").cast("string") if domain.entity in wide.columns else F.lit("default")
    long = wide.select(entity.alias("entity_id"), F.col(f"`{domain.index}`").cast("double").alias("I"), F.explode(cell).alias("c"))
    return observations(long.select("entity_id", "c.signal_id", "I", "c.y", "c.unit", F.lit(domain.dimension).alias("dimension")))


def from_bytes(spark: SparkSession, raw: bytes) -> DataFrame:
    """Observations from the bytes of a Parquet or CSV file that a caller holds; it is as large as one request."""
    import io

    import pyarrow.csv as csv
    import pyarrow.parquet as pq

    from sigloom.sources.intake import sniff

    table = pq.read_table(io.BytesIO(raw)) if sniff(raw[:4096]) == "parquet" else csv.read_csv(io.BytesIO(raw))
    return observations(spark.createDataFrame(table.to_pandas()))
