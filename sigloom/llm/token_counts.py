"""Token counts by overlap resynchronisation.

Short texts are encoded whole. A text of more than CHUNK characters is cut into chunks that overlap; the chunks travel
and are encoded apart, with offsets, and neighbours are spliced at a boundary that both have. Such a boundary is proven
to be one of the whole text where it begins a pre-token in both and stands MARGIN characters before the left chunk's end:

* merges never cross pre-tokens, and pre-tokens are matched from left to right without looking back, so what follows a
  common boundary is encoded alike from there on, up to the end of the left chunk;
* a match looks ahead by two characters at most, and a special string has no border with itself, so MARGIN characters
  before its end the left chunk matches what the whole text does; if its own beginning is not yet in step, the boundary
  joins it to the right chunk all the same, and its left neighbour's splice brings both into step: the counts telescope.

Where two neighbours have no common boundary in their overlap, the overlap doubles for that document, at last up to the
end of the text, which is a boundary of both.

Defined cases: a null text is empty and has no tokens; repeated rows are counted each, also with equal ids; special
strings are matched as the library does by default; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sigloom.llm import common as C

CHUNK, OVERLAP, MARGIN = 1 << 15, 512, 32
LIMIT = 512


@cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def boundaries(encoding, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where pre-tokens begin, and how many tokens stand before each; the end of the text is the last one.

    The library leaves white space out of a token's offsets, so a pre-token begins where the one before it ends.
    """
    words, spans = encoding.word_ids, encoding.offsets
    at, before, last, end = [0], [0], None, 0
    for i, (word, (_, to)) in enumerate(zip(words, spans)):
        # special tokens have no word: each is a pre-token of its own
        if i and (word is None or word != last):
            at.append(end)
            before.append(i)
        last, end = word, to
    at.append(len(text))
    before.append(len(spans))
    return np.array(at), np.array(before)


def encode_chunk(path: str, text: str, step: int, overlap: int, first: bool, last: bool) -> dict:
    """Boundaries, from the chunk's beginning, in the part it shares with the chunk before and in that with the one after."""
    encoding = tokenizer(path).encode(text, add_special_tokens=False)
    at, before = boundaries(encoding, text)
    keep = np.ones(len(at), bool)
    keep[:-1] = at[:-1] + MARGIN <= len(text)
    keep[-1] = last
    at, before = at[keep], before[keep]
    head = at <= overlap
    tail = at >= step
    return {
        "total": len(encoding.ids),
        "head": [] if first else list(zip(at[head].tolist(), before[head].tolist())),
        "tail": [] if last and len(text) <= step else list(zip((at[tail] - step).tolist(), before[tail].tolist())),
    }


CHUNK_SCHEMA = "row long, part int, total long, head map<long,long>, tail map<long,long>"


def _cut(step: int, overlap: int):
    """A row for each chunk of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches, most=1):
            row, text = batch.column("row")[0].as_py(), batch.column("text")[0].as_py()
            for part, at in enumerate(range(0, len(text), step)):
                to = at + step + overlap
                yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([part], pa.int32()), pa.array([text[at:to]]), pa.array([to >= len(text)])], ["row", "part", "text", "last"])

    return run


def _chunks(path: str, step: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("row", pa.int64()), ("part", pa.int32()), ("total", pa.int64()), ("head", pa.map_(pa.int64(), pa.int64())), ("tail", pa.map_(pa.int64(), pa.int64()))])
        for batch in batches:
            for x in batch.to_pylist():
                got = encode_chunk(path, x["text"], step, overlap, x["part"] == 0, x["last"])
                yield pa.RecordBatch.from_pylist([{"row": x["row"], "part": x["part"], **got}], schema=kind)

    return run


#: Bytes of long texts that a task encodes, and the most tasks.
TASK_BYTES, MOST_TASKS = 2 << 20, 100_000


def _spliced(long: DataFrame, path: str, step: int, overlap: int, tasks: int) -> DataFrame:
    """row, n_tokens (null where some neighbours have no common boundary) of texts in chunks of step + overlap characters."""
    cut = long.select("row", "text").mapInArrow(_cut(step, overlap), "row long, part int, text string, last boolean")
    # by a number that the bytes settle: encoding costs more than its bytes say, so tasks must not be put together by them
    coded = cut.repartition(tasks, F.col("row"), F.col("part")).mapInArrow(_chunks(path, step, overlap), CHUNK_SCHEMA)
    next_head = F.lead("head").over(W.partitionBy("row").orderBy("part"))
    paired = coded.withColumn("next", next_head).withColumn("at", F.array_min(F.array_intersect(F.map_keys("tail"), F.map_keys("next"))))
    # tokens of the left chunk before the splice, less those of the right chunk before it
    own = F.when(F.col("next").isNull(), F.col("total")).otherwise(F.try_element_at("tail", F.col("at")) - F.try_element_at("next", F.col("at")))
    return paired.groupBy("row").agg(F.sum(own).alias("sum"), F.count(own).alias("n"), F.count(F.lit(1)).alias("all")).select("row", F.when(F.col("n") == F.col("all"), F.col("sum")).alias("n_tokens"))


def token_counts(docs: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens of each row."""
    base = C.texts(docs)
    short, long = base.where(F.length("text") <= chunk), base.where(F.length("text") > chunk)
    size = F.octet_length("text").cast("long").alias("n_bytes")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path)
        for batch in C.slices(batches, most=1 << 20):
            got = encode.encode_batch_fast(batch.column("text").to_pylist(), add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array([len(x.ids) for x in got], pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    out = short.select("doc_id", "text", size).mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long")

    # long texts: a number of its own for each row, kept in the shared folder, so that equal ids and retries do no harm
    queue = C.materialise(long.select("doc_id", size, "text").withColumn("row", F.monotonically_increasing_id()), "long-texts")
    left, done = queue, None
    size = queue.agg(F.sum("n_bytes")).first()[0] or 0
    tasks = min(MOST_TASKS, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / TASK_BYTES)))
    while not left.isEmpty():
        found = C.materialise(_spliced(left, path, chunk, overlap, tasks), "spliced")
        good = found.where("n_tokens is not null")
        done = good if done is None else done.unionByName(good)
        left = left.join(found.where("n_tokens is null").select("row"), "row", "left_semi")
        overlap *= 2
    if done is not None:
        out = out.unionByName(queue.drop("text").join(done, "row").select("doc_id", "n_bytes", "n_tokens"))
    return out


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = C.finished(spark, lambda: token_counts(C.table(spark, sf_dir, "documents"), public("byte_bpe_50k.json")), "token-counts")
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)
