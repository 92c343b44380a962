"""What the operators share: the shared work folder, materialisation, and NumPy kernels on Arrow text buffers.

Words are maximal runs of bytes other than space and \\t..\\r; bytes of other UTF-8 characters are never white space.
"""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel works on at once; a longer document is worked on alone.
SLICE_BYTES = 2 << 20


# ---------------------------------------------------------------- shared folder


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share.

    Only a session without one that runs in a single JVM gets a folder of this machine; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sigloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


#: Paths that are made on the way to a result, one list for each `finished` that runs.
_on_the_way: list[list[str]] = []


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends here, and a lost executor costs nothing before it."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    if _on_the_way:
        _on_the_way[-1].append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.sigloom_path = path
    return out


def finished(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What `make` returns, written to the shared folder; all that was materialised on the way is deleted, also after a failure."""
    _on_the_way.append([])
    try:
        out = materialise(make(), name)
        _on_the_way[-1].remove(out.sigloom_path)
    finally:
        for path in _on_the_way.pop():
            delete(spark, path)
    if _on_the_way:
        _on_the_way[-1].append(out.sigloom_path)
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of a materialised table that nothing will read again."""
    if path := getattr(df, "sigloom_path", None):
        delete(df.sparkSession, path)


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    at, files = _files(spark, path)
    files.delete(at, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Renames a folder, with the folders above it."""
    at, files = _files(spark, path)
    there, _ = _files(spark, to)
    files.mkdirs(there.getParent())
    if not files.rename(at, there):
        raise OSError(f"cannot move {path} to {to}")


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing where there is none."""
    at, files = _files(spark, path)
    return sorted(x.getPath().getName() for x in files.listStatus(at)) if files.exists(at) else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and further columns; any others are left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


# ---------------------------------------------------------------- Arrow text


def flat(batch: pa.RecordBatch | pa.Table, column: str) -> pa.Array:
    got = batch.column(column)
    if isinstance(got, pa.ChunkedArray):
        got = got.combine_chunks() if got.num_chunks != 1 else got.chunk(0)
    return got


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each has at most so many bytes of text, or one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, offsets = buffers(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < n:
            to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
            to = min(n, max(at + 1, to))
            yield batch.slice(at, to - at)
            at = to


def buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array, and the n + 1 offsets of its values."""
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]] if len(offsets) else raw
    return raw, offsets - offsets[0]


# ---------------------------------------------------------------- memory


def release() -> None:
    """Gives the system back what Arrow and the C library keep of freed memory."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


def freed(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """For mapInArrow: a worker that waits for its next task holds no memory of the last one, beside the JVM that goes on."""

    @functools.wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            release()

    return run


# ---------------------------------------------------------------- hashes

_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_R = 0xD1342543DE82EF95
_RINV = pow(_R, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = np.asarray(x, np.uint64) + _ODD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


BYTE_CODES = mix(np.arange(256, dtype=np.uint64))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    if len(_powers.get(base, ())) < max(1, n):
        size = max(1 << 16, n + n // 8)
        factors = np.full(size, base, np.uint64)
        factors[0] = 1
        made = np.multiply.accumulate(factors)
        if size > 1 << 22:  # not kept: one huge document must not hold memory for good
            return made[:n]
        _powers[base] = made
    return _powers[base][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """n + 1 sums of code * R ** i."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODES[data] * powers(_R, len(data)), out=out[1:])
    return out


#: Bytes of a span that go into one sum: powers modulo 2 ** 64 fail on long strings of a certain build (Thue-Morse).
SPAN_BLOCK = 256


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], equal for equal bytes wherever they stand; longer spans are hashed block by block."""
    size = end - start
    back = powers(_RINV, len(prefix))
    out = mix((prefix[end] - prefix[start]) * back[start] + size.astype(np.uint64))
    long = np.flatnonzero(size > SPAN_BLOCK)
    if len(long):
        n = -(-size[long] // SPAN_BLOCK)
        first = np.cumsum(n) - n
        k = np.arange(int(n.sum())) - np.repeat(first, n)
        a = np.repeat(start[long], n) + k * SPAN_BLOCK
        b = np.minimum(a + SPAN_BLOCK, np.repeat(end[long], n))
        sums = mix((prefix[b] - prefix[a]) * back[a] + mix(k.astype(np.uint64)))
        out[long] = mix(np.add.reduceat(sums, first) + size[long].astype(np.uint64))
    return out


def words(data: np.ndarray, offsets: np.ndarray, white: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document number of each word; words never span documents."""
    white = (data == 32) | ((data >= 9) & (data <= 13)) if white is None else white
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begin = ~white
    begin[1:] &= white[:-1]
    begin[inner] = ~white[inner]
    finish = ~white
    finish[:-1] &= white[1:]
    finish[inner - 1] = ~white[inner - 1]
    start = np.flatnonzero(begin)
    return start, np.flatnonzero(finish) + 1, np.searchsorted(offsets, start, side="right") - 1


def window_hash(codes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of codes[i : i + k] for each i at which a window of k fits."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = codes[:n].copy()
    for j in range(1, k):
        out = mix(out) + codes[j : j + n]
    return mix(out)
