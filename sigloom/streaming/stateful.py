"""Incremental operators: state lives in the state store, one entry for each signal, and nothing is evicted silently.

Derivatives, running Laplace fields, Kalman filters and buffered kernels keep what they need of a signal between batches.
Each takes a streaming (or batch) DataFrame of observations; batches of one signal are taken in order of their index, and
rows that come later with a smaller index are counted and left out, as the series has gone on without them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sigloom.operators.engines import KERNELS, frame

KEY = ["entity_id", "signal_id"]
KEYS = "entity_id string, signal_id string"


def _stateful(df: DataFrame, step, schema: str, state: str, mode: str = "append") -> DataFrame:
    return df.select(*KEY, "I", "y").groupBy(*KEY).applyInPandasWithState(step, f"{KEYS}, {schema}", state, mode, GroupStateTimeout.NoTimeout)


def _ordered(pdfs: Iterator[pd.DataFrame], after: float) -> pd.DataFrame:
    rows = pd.concat(list(pdfs)).sort_values("I", kind="stable")
    return rows[rows["I"] > after]


def derivatives(df: DataFrame) -> DataFrame:
    """dy and d2y of each point once its successor is known: the last two points of a signal are its state."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get) if state.exists else [math.nan] * 4  # the last two: I, y, I, y
        rows = _ordered(pdfs, held[2] if not math.isnan(held[2]) else -math.inf)
        known = [(i, y) for i, y in (held[:2], held[2:]) if not math.isnan(i)]
        I, y = (np.array([k[j] for k in known] + rows["I" if j == 0 else "y"].tolist()) for j in (0, 1))
        last = [v for k in zip(I[-2:], y[-2:]) for v in k]
        state.update(tuple([math.nan] * (4 - len(last)) + [float(v) for v in last]))
        if len(I) > 2:
            yield frame(dict(zip(KEY, key)), {"I": I[1:-1], "dy": (y[2:] - y[:-2]) / 2, "d2y": y[2:] - 2 * y[1:-1] + y[:-2]}, [*KEY, "I", "dy", "d2y"])

    return _stateful(df, step, "I double, dy double, d2y double", "a double, b double, c double, d double")


def running_laplace(df: DataFrame, s: tuple[float, ...] = (0.001, 0.01, 0.1, 1.0)) -> DataFrame:
    """The field at each s after each batch: sums, the first index and the last are the state."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last, n, *sums = state.get if state.exists else (math.nan, math.nan, 0, *([0.0] * len(s)))
        rows = _ordered(pdfs, last if not math.isnan(last) else -math.inf)
        I, y = rows["I"].to_numpy(float), rows["y"].to_numpy(float)
        if len(I):
            first = float(I[0]) if math.isnan(first) else first
            dt = np.diff(I, prepend=I[0] if math.isnan(last) else last)
            sums = [a + float((y * np.exp(-b * (I - first)) * dt).sum()) for a, b in zip(sums, s)]
            last, n = float(I[-1]), n + len(I)
            span = last - first
            yield frame(dict(zip(KEY, key)), {"I": np.full(len(s), last), "s": np.array(s), "field": np.array(sums) / span if span else np.zeros(len(s))}, [*KEY, "I", "s", "field"])
        state.update((first, last, n, *sums))

    return _stateful(df, step, "I double, s double, field double", "first double, last double, n long, " + ", ".join(f"s{i} double" for i in range(len(s))))


def kalman_level(df: DataFrame, q: float = 1e-3, r: float = 1.0) -> DataFrame:
    """A local-level filter: state and variance carried from batch to batch."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        x, p, last = state.get if state.exists else (0.0, 1e6, -math.inf)
        rows = _ordered(pdfs, last)
        out = []
        for z in rows["y"].to_numpy(float):
            p += q
            k = p / (p + r)
            gap = z - x
            x, p = x + k * gap, (1 - k) ** 2 * p + k * k * r
            out.append((x, p, gap))
        if out:
            state.update((float(x), float(p), float(rows["I"].iloc[-1])))
            a = np.array(out)
            yield frame(dict(zip(KEY, key)), {"I": rows["I"].to_numpy(float), "level": a[:, 0], "variance": a[:, 1], "innovation": a[:, 2]}, [*KEY, "I", "level", "variance", "innovation"])

    return _stateful(df, step, "I double, level double, variance double, innovation double", "x double, p double, last double")


def buffered_kernel(df: DataFrame, name: str, size: int = 100) -> DataFrame:
    """A signal kernel on every `size` points of a signal as they come: the buffer is the state, and holds fewer than `size`."""
    k = KERNELS[name]
    columns = [*KEY, "block", "last_I", *(c.split()[0] for c in k.columns.split(", "))]

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        block, I, y = state.get if state.exists else (0, [], [])
        rows = _ordered(pdfs, I[-1] if I else -math.inf)
        I, y = list(I) + rows["I"].tolist(), list(y) + rows["y"].tolist()
        while len(I) >= size:
            a, b = np.array(I[:size], float), np.array(y[:size], float)
            I, y = I[size:], y[size:]
            yield frame({**dict(zip(KEY, key)), "block": block, "last_I": float(a[-1])}, k.run(a, b), columns)
            block += 1
        state.update((block, I, y))

    return _stateful(df, step, f"block long, last_I double, {k.columns}", "block long, I array<double>, y array<double>")


def run_once(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """Runs a streaming DataFrame over all that is there, into Parquet files that are complete or not there, and reads them back.

    The checkpoint lies beside the files, so a second call goes on where the first has ended.
    """
    query = df.writeStream.format("parquet").outputMode("append").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/rows")


def windowed(df: DataFrame, ts: str = "ts", window: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Event-time windows with a watermark: counts and moments of each signal."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    m = df.withWatermark(ts, late).groupBy(w.alias("window"), *KEY).agg(F.count("y").alias("n"), F.avg("y").alias("mean"), F.stddev("y").alias("std"), F.min("y").alias("min"), F.max("y").alias("max"))
    return m.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *KEY, "n", "mean", "std", "min", "max")


def sessions(df: DataFrame, ts: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    m = df.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("session"), *KEY).agg(F.count("y").alias("n"), F.sum("y").alias("total"))
    return m.select(F.col("session.start").alias("start"), F.col("session.end").alias("end"), *KEY, "n", "total")
