"""Token ids in directly addressable codes (Brisaboa, Ladra and Navarro 2013).

A segment holds the ids of consecutive documents. Each id is cut into chunks of eight bits; level k holds the k-th chunks
of all ids that have one, and a bitmap that says which of them go on in level k + 1. A directory of ranks, one for each
512 bits, turns a position in one level into the position in the next, so that any id is read with a few loads, without
decoding its neighbours.

A segment in bytes, little-endian, all parts padded to eight bytes:

    magic 'SLDAC1\\0\\0', n_docs u64, n_tokens u64, n_levels u64
    for each level: its number of chunks u64
    doc_id i64[n_docs], offset u64[n_docs + 1]
    for each level: chunks u8[], and, but for the last level, bitmap u64[] and ranks u64[] (ones before each 512 bits)

Segments are stored as binary values in Parquet, in ascending doc_id order, through Spark's own writer: a lost task or a
second attempt never leaves half a file behind, and any store that Spark writes to will do.

Defined cases: a null text is empty and has the end id alone; repeated ids keep all their rows, ordered by a hash of the
text; rows without an id come first; an empty table gives an empty store; other columns are left behind.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sigloom.llm import common as C
from sigloom.llm.token_counts import public, tokenizer

MAGIC = b"SLDAC1\0\0"
END_ID = 2
SEGMENT_TOKENS = 1 << 20
#: Words whose ids a worker keeps; a cache that is full starts afresh.
CACHE_WORDS, CACHE_CORES = 1_500_000, 400_000
BLOCK = 512


# ---------------------------------------------------------------- the code


def _pad(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % 8)


def encode_segment(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """Codes of u32 ids: the first lengths[0] of them are those of doc_ids[0], and so on."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        levels.append(((rest & 0xFF).astype(np.uint8), more))
        if not more.any():
            break
        rest = rest[more] >> 8
    parts = [MAGIC, np.array([len(doc_ids), len(ids), len(levels), *(len(c) for c, _ in levels)], np.uint64).tobytes()]
    parts += [doc_ids.astype("<i8").tobytes(), np.concatenate([[0], np.cumsum(lengths)]).astype("<u8").tobytes()]
    for k, (chunks, more) in enumerate(levels):
        parts.append(_pad(chunks.tobytes()))
        if k + 1 < len(levels):
            bits = np.zeros(-(-len(more) // BLOCK) * BLOCK, np.uint8)
            bits[: len(more)] = more
            ones = bits.reshape(-1, BLOCK).sum(1, dtype=np.uint64)
            parts += [np.packbits(bits, bitorder="little").tobytes(), np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u8").tobytes()]
    return b"".join(parts)


class Segment:
    """Reads a segment in place."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a segment")
        self.n_docs, self.n_tokens, n_levels = (int(x) for x in np.frombuffer(raw, "<u8", 3, 8))
        sizes = np.frombuffer(raw, "<u8", n_levels, 32).astype(int)
        at = 32 + 8 * n_levels
        self.doc_ids = np.frombuffer(raw, "<i8", self.n_docs, at)
        at += 8 * self.n_docs
        self.offsets = np.frombuffer(raw, "<u8", self.n_docs + 1, at).astype(np.int64)
        at += 8 * (self.n_docs + 1)
        self.levels = []
        for k, n in enumerate(sizes):
            chunks = np.frombuffer(raw, np.uint8, n, at)
            at += n + -n % 8
            words = ranks = None
            if k + 1 < n_levels:
                blocks = -(-n // BLOCK)
                words = np.frombuffer(raw, "<u8", blocks * BLOCK // 64, at)
                at += blocks * BLOCK // 8
                ranks = np.frombuffer(raw, "<u8", blocks, at)
                at += 8 * blocks
            self.levels.append((chunks, words, ranks))

    def __getitem__(self, i: int) -> int:
        """The i-th id, by one chunk and one rank for each of its levels."""
        value, shift = 0, 0
        for chunks, words, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if words is None or not int(words[i >> 6]) >> (i & 63) & 1:
                return value
            block = i // BLOCK
            first = block * BLOCK >> 6
            whole = sum(int(w).bit_count() for w in words[first : i >> 6])
            i = int(ranks[block]) + whole + (int(words[i >> 6]) & ((1 << (i & 63)) - 1)).bit_count()
            shift += 8
        return value

    def ids(self, start: int = 0, end: int | None = None) -> np.ndarray:
        """The ids from start to end: a run of positions is a run in every level too."""
        end = self.n_tokens if end is None else end
        out = np.zeros(end - start, np.uint32)
        where, shift = np.arange(end - start), 0
        for chunks, words, ranks in self.levels:
            out[where] |= chunks[start:end].astype(np.uint32) << np.uint32(shift)
            if words is None or start == end:
                break
            low, high = start >> 6, (end + 63) >> 6
            bits = np.unpackbits(words[low:high].view(np.uint8), bitorder="little")[start - 64 * low : end - 64 * low].astype(bool)
            where, shift = where[bits], shift + 8
            start = self._rank(words, ranks, start)
            end = start + len(where)
        return out

    @staticmethod
    def _rank(words: np.ndarray, ranks: np.ndarray, i: int) -> int:
        block = i // BLOCK
        if block == len(ranks):
            return int(ranks[-1]) + int(np.bitwise_count(words[(block - 1) * BLOCK >> 6 :]).sum())
        low = np.bitwise_count(words[block * BLOCK >> 6 : i >> 6]).sum()
        return int(ranks[block]) + int(low) + (int(words[i >> 6]) & ((1 << (i & 63)) - 1)).bit_count() if i & 63 else int(ranks[block]) + int(low)


# ---------------------------------------------------------------- encoding


@cache
def _specials(path: str) -> tuple[str, ...]:
    return tuple(t.content for t in tokenizer(path).get_added_tokens_decoder().values())


#: What may be cut off behind an ASCII letter before a word is encoded: never part of a contraction, nor joined to such a
#: letter. Letters of other scripts may end in a combining mark once normalised, which joins the sign behind it.
TAILS = ".,!?;:%$&#|*"
#: Stands between words that are encoded at one go; texts that hold it are encoded whole.
BETWEEN = "\x01"


class Words:
    """Ids by words, for tokenizers that drop white space and part letters from other signs.

    A word is what stands between blanks or line ends. Words are known by 64-bit hashes; one that is new is looked up
    without its tail and, if it is ASCII, in lower case, and only what is new then is encoded. All else is in NumPy.
    Special strings match by case, so a word that holds one in lower case only is encoded as it stands.
    """

    def __init__(self, path: str):
        self.encode, self.cores, self.tails = tokenizer(path), {}, {"": b""}
        self.specials = _specials(path)
        self.whole = tuple(s.encode() for s in (*self.specials, BETWEEN))
        (self.between,) = self.encode.encode(BETWEEN, add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        """keys: hashes in order; at, n: where each word's ids stand in the pool."""
        self.keys, self.at, self.n, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def fresh(self, words: list[str]) -> list[bytes]:
        """Encodes words that hold neither blanks nor BETWEEN."""
        out = []
        for at in range(0, len(words), 2000):
            joined = f" {BETWEEN} ".join(words[at : at + 2000])
            ids = np.array(self.encode.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            cut = (np.flatnonzero(ids == self.between) * 4).tolist()
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *(c + 4 for c in cut)], [*cut, len(raw)])]
        return out

    def learn(self, keys: np.ndarray, words: list[str]) -> None:
        if len(self.cores) > CACHE_CORES or len(self.tails) > CACHE_CORES:
            self.cores.clear()
            self.tails = {"": b""}
        parts = []
        for word in words:
            core = word.rstrip(TAILS)
            if not core or not (core[-1].isascii() and core[-1].isalpha()):
                core = word
            low = core.lower() if core.isascii() else core
            parts.append((core if any(s in low for s in self.specials) else low, word[len(core) :]))
        cores, tails = self.cores, self.tails
        new = list({c for c, _ in parts} - cores.keys())
        cores.update(zip(new, self.fresh(new)))
        new = list({t for _, t in parts} - tails.keys())
        tails.update(zip(new, self.fresh(new)))
        made = [cores[core] + tails[tail] for core, tail in parts]
        n = np.array([len(x) for x in made], np.int64) >> 2
        at = len(self.pool) + np.cumsum(n) - n
        self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(made), "<u4")])
        keys, at, n = np.concatenate([self.keys, keys]), np.concatenate([self.at, at]), np.concatenate([self.n, n])
        order = np.argsort(keys, kind="stable")
        self.keys, self.at, self.n = keys[order], at[order], n[order]

    def __call__(self, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, with the end id after each document, and how many each document has."""
        raw = data.tobytes()
        if any(s in raw for s in self.whole):
            parts = [self.one(raw[a:b], end) for a, b in zip(offsets[:-1], offsets[1:])]
            return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        start, stop, doc = C.words(data, offsets, (data == 32) | (data == 10))
        codes = C.span_hash(C.prefix_hash(data), start, stop)
        keys, first, back = np.unique(codes, return_index=True, return_inverse=True)
        if len(self.keys) > CACHE_WORDS:
            self.forget()
        new = ~np.isin(keys, self.keys, assume_unique=True, kind="sort") if len(self.keys) else np.ones(len(keys), bool)
        if new.any():
            self.learn(keys[new], [raw[a:b].decode() for a, b in zip(start[first[new]].tolist(), stop[first[new]].tolist())])
        hit = np.searchsorted(self.keys, keys)[back]
        at, n = self.at[hit], self.n[hit]
        total = int(n.sum())
        i = np.arange(total)
        lengths = np.bincount(doc, n, len(offsets) - 1).astype(np.int64) + 1
        out = np.full(total + len(lengths), end, "<u4")
        out[i + np.repeat(doc, n)] = self.pool[i + np.repeat(at - (np.cumsum(n) - n), n)]
        return out, lengths

    def one(self, raw: bytes, end: int) -> np.ndarray:
        if any(s in raw for s in self.whole):
            return np.array([*self.encode.encode(raw.decode(), add_special_tokens=False).ids, end], "<u4")
        return self(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), end)[0]


@cache
def _words(path: str) -> Words:
    return Words(path)


def encode_slice(path: str, texts: pa.Array, end: int, by_word: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """All ids of some texts, each with the end id, and their counts; by_word only for tokenizers that Words is right for."""
    if by_word:
        return _words(path)(*C.buffers(texts), end)
    ids = [np.array([*x.ids, end], "<u4") for x in tokenizer(path).encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
    return np.concatenate(ids), np.array([len(x) for x in ids], np.int64)


STORE_SCHEMA = "part int, segment int, first_token long, n_docs long, n_tokens long, codes binary"


def _segments(path: str, end_id: int, by_word: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, segment, before = TaskContext.get().partitionId(), 0, 0
        docs, lengths, ids = [], [], []

        def sealed() -> pa.RecordBatch:
            n = sum(map(len, ids))
            codes = encode_segment(np.concatenate(docs), np.concatenate(lengths), np.concatenate(ids))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([segment], pa.int32()), *(pa.array([x], pa.int64()) for x in (before, sum(map(len, docs)), n)), pa.array([codes], pa.binary())], ["part", "segment", "first_token", "n_docs", "n_tokens", "codes"])

        for batch in C.slices(batches):
            got, n = encode_slice(path, C.flat(batch, "text"), end_id, by_word)
            docs.append(batch.column("doc_id").to_numpy(zero_copy_only=False))
            lengths.append(n)
            ids.append(got)
            if sum(map(len, ids)) >= SEGMENT_TOKENS:
                yield sealed()
                segment, before = segment + 1, before + sum(map(len, ids))
                docs, lengths, ids = [], [], []
        if lengths:
            yield sealed()

    return run


NO_ID = -(1 << 63)


def write_store(docs: DataFrame, out: str, path: str, end_id: int = END_ID, by_word: bool = True) -> None:
    """Encodes all documents and writes the store: ranges of doc_id, sorted, a file or more for each."""
    spark = docs.sparkSession
    source = C.texts(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("tie", F.xxhash64("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = source.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    ordered.mapInArrow(_segments(path, end_id, by_word), STORE_SCHEMA).write.parquet(out)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for codes, first in zip(batch.column("codes"), batch.column("first").to_pylist()):
            s = Segment(codes.as_buffer().to_pybytes())
            raw, at = s.ids().astype("<u4").tobytes(), s.offsets
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(s.doc_ids, mask=s.doc_ids == NO_ID), pa.array(first + at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
            )


def placed(spark: SparkSession, out: str) -> DataFrame:
    """The segments with `first`, the number of ids before each: one sum for each range of doc_id, then within it."""
    store = spark.read.schema(STORE_SCHEMA).parquet(out)
    sums = store.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = sums.select(F.col("part").alias("of"), (F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")).alias("base"))
    # one row for each range of doc_id, as many as the writing stage had partitions: small by its making
    return store.join(F.broadcast(before), F.col("part") == F.col("of")).withColumn("first", F.col("base") + F.col("first_token"))


def read_store(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the store's bytes."""
    return placed(spark, out).select("codes", "first").mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_at(spark: SparkSession, out: str, position: int) -> int:
    """One id by its place among all ids: reads one segment, decodes one id."""
    hit = placed(spark, out).where((F.col("first") <= position) & (position < F.col("first") + F.col("n_tokens"))).select("codes", "first").first()
    if hit is None:
        raise IndexError(position)
    return Segment(bytes(hit.codes))[position - hit.first]


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.work_dir(spark, "token-store")
    write_store(C.table(spark, sf_dir, "documents"), out, public("word_bpe_49k.json"))
    return read_store(spark, out)
