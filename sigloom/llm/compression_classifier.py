"""Quality classifier by compression.

Two zstandard dictionaries are built, one from texts labelled good and one from texts labelled bad. A text is compressed
with both, block by block, so that the dictionary counts as much at the end of a long text as at its beginning; the
difference of the sizes, divided by the text's length, becomes a score by a logistic curve that is fitted on labelled
texts which the dictionaries have not seen, weighted so that both classes have their share among all labelled rows.

The sample to learn from has a bound: MOST_ROWS rows of each class in the order of a hash of the id, up to the one with which
MOST_BYTES bytes are full, so that long texts have the same chance as short ones. Equal rows count once. The
dictionaries (DICT_BYTES each) and two coefficients are all that is sent to the workers. Scoring covers every whole text.

Defined cases: a null text is empty, with a difference of nought; labels that are null, or of ids without a document, are
not learned from; where a class has no labels every score is 0.5; an id with several labels counts once for each different one; repeated
rows are scored each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sigloom.llm import common as C

BLOCK, LEVEL, DICT_BYTES = 1024, 3, 1 << 16
MOST_ROWS, MOST_BYTES = 2000, 4_000_000
THRESHOLD, FOLDS = 0.3, 5


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    intercept: float

    def score(self, difference: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * difference + self.intercept, -30, 30)))


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(dictionary)
    held.precompute_compress(LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False)


def difference(raw: bytes, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> float:
    """Positive: the good dictionary makes the text smaller."""
    total = 0
    for at in range(0, len(raw), BLOCK):
        block = raw[at : at + BLOCK]
        total += len(bad.compress(block)) - len(good.compress(block))
    return total / max(1, len(raw))


def build_dictionary(texts: list[bytes]) -> bytes:
    blocks = [b for t in texts for b in (t[i : i + BLOCK] for i in range(0, len(t), BLOCK)) if len(b) >= 8]
    try:
        return zstandard.train_dictionary(DICT_BYTES, blocks).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their end is the dictionary as it is
        return b"".join(blocks)[-DICT_BYTES:] or b"\n" * 8


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Newton steps on one feature, with a small penalty on the slope."""
    scale = x.std() or 1.0
    z = np.stack([x / scale, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (weight * (p - y)) + np.array([1e-2, 0]) * w
        hessian = (z * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ z + np.diag([1e-2, 1e-9])
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def fold(column: str = "doc_id"):
    """crc32 of the id as text, modulo 5; 0 is held out."""
    return F.crc32(F.col(column).cast("string")) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> Model | None:
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & (fold() != 0))
    shares = {r.quality: r["count"] for r in usable.groupBy("quality").count().collect()}
    if len(shares) < 2:
        return None
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("hash")]
    picked = [usable.where(F.col("quality") == q).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows) for q in (0, 1)]
    few = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * most_rows rows of two numbers
    base = C.texts(docs).withColumn("hash", F.xxhash64("text"))
    found = base.select("doc_id", "hash", F.octet_length("text").alias("size")).join(few, "doc_id").distinct()
    first = [found.where(F.col("quality") == q).orderBy(*order).limit(most_rows) for q in (0, 1)]
    before = F.sum("size").over(W.partitionBy("quality").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size")
    wanted = first[0].unionByName(first[1]).withColumn("before", before).where(F.col("before") < most_bytes).select("doc_id", "hash", "quality")
    rows = base.join(F.broadcast(wanted), ["doc_id", "hash"]).dropDuplicates(["doc_id", "hash", "quality"]).orderBy(*order)
    texts: dict[int, list[bytes]] = {0: [], 1: []}
    for row in rows.select("quality", "text").toLocalIterator():
        texts[row.quality].append(row.text.encode())
    if not texts[0] or not texts[1]:
        return None
    # of four texts, three go to the dictionaries and one to the calibration
    learn = {q: [t for i, t in enumerate(ts) if i % 4 or len(ts) < 8] for q, ts in texts.items()}
    check = {q: [t for i, t in enumerate(ts) if i % 4 == 0 or len(ts) < 8] for q, ts in texts.items()}
    dictionaries = {q: build_dictionary(ts) for q, ts in learn.items()}
    good, bad = compressor(dictionaries[1]), compressor(dictionaries[0])
    x = np.array([difference(t, good, bad) for q in (0, 1) for t in check[q]])
    y = np.array([q for q in (0, 1) for _ in check[q]], float)
    total = sum(shares.values())
    weight = np.array([shares[q] / total * len(y) / len(check[q]) for q in (0, 1) for _ in check[q]])
    return Model(dictionaries[1], dictionaries[0], *logistic(x, y, weight))


SCHEMA = "doc_id long, difference double, score double"


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, the normalised difference and the score of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = (compressor(model.good), compressor(model.bad)) if model else None
        for batch in C.slices(batches):
            if pair:
                found = np.array([difference(t.encode(), *pair) for t in batch.column("text").to_pylist()])
                scores = model.score(found)
            else:
                found, scores = np.zeros(batch.num_rows), np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found), pa.array(scores)], ["doc_id", "difference", "score"])

    return C.texts(docs).mapInArrow(run, SCHEMA)


def op4_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    model = fit(docs, C.table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "difference")
