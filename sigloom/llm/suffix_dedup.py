"""Suffix-array deduplication with a logarithmic family of indexes.

A byte goes where it is covered by a string of LENGTH bytes that also starts in a document with a smaller doc_id. The
suffixes that can matter are found first: every string of LENGTH bytes holds an anchor, the K-byte gram with the least
hash, and strings whose anchor occurs in one document only cannot repeat. Each string belongs to its leftmost least gram,
so that an anchor stands for a short run of strings, its context.

1. The texts are packed into chunks, in a table of the shared folder with buckets of a bounded size, which later joins
   read in place.
2. Chunks send 32-bit fingerprints of their anchors, spread over Q key ranges; each range answers which of them occur in
   more than one document. A false answer costs a context, and nothing else.
3. Chunks send the contexts of those anchors, each different one once, with the smallest doc_id that has it, to the same
   ranges. A range takes the contexts in batches of ascending doc_id. A batch gets its suffix array (places in the text of
   its contexts, in the order of the LENGTH bytes that begin there), which is merge-scanned against each level of the
   family: where the longest common prefix of neighbours in the merged order has LENGTH bytes, the string is known. What is
   new becomes a level; levels of like size are merged, so that a suffix moves a logarithmic number of times.
4. The answers, a bit for each string, go back to the chunks, where the removed bytes are marked.

All that moves are packed arrays; contexts that repeat within a chunk move once, so a passage of a third of all documents
costs one context for each chunk. Equal hashes decide nothing: contexts that are taken to be equal are compared in bytes. An
anchor of more than HOT_CHUNKS chunks, which may stand in as many different surroundings, is dealt out over ranges of its own,
by a hash of each string.

SuffixIndex keeps the levels in a folder, for batches that come later: each batch is scanned against what is stored, whose
strings all count as earlier ones, and becomes a level. There all contexts move, as a string that is new now may repeat then.

Defined cases: a null text is empty; texts shorter than LENGTH stay whole; rows that repeat a doc_id are not removed for
one another; rows without an id count as having the largest one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm import common as C
from sigloom.llm.near_duplicates import borders, grouped

LENGTH, K = 50, 24
CHUNK_BYTES, BUCKET_BYTES = 2 << 20, 64 << 20
#: Strings for a key range, and in a batch of a range.
RANGE_STRINGS, BATCH_STRINGS = 4 << 20, 1 << 18
#: Chunks with an anchor beyond which it has ranges of its own, one more for each so many chunks.
HOT_CHUNKS = 4096
NO_ID = (1 << 63) - 1

CHUNK_SCHEMA = "chunk long, n_bytes long, ids binary, offsets binary, blob binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, seq = TaskContext.get().partitionId(), 0
    ids, lengths, blobs, size = [], [], [], 0

    def packed() -> pa.RecordBatch:
        n = np.concatenate(lengths)
        values = [[(part << 32) + seq], [int(n.sum())], [np.concatenate(ids).astype("<i8").tobytes()], [np.concatenate([[0], np.cumsum(n)]).astype("<i8").tobytes()], [b"".join(blobs)]]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()])], ["chunk", "n_bytes", "ids", "offsets", "blob"])

    for batch in C.slices(batches, most=CHUNK_BYTES):
        data, offsets = C.buffers(C.flat(batch, "text"))
        ids.append(batch.column("doc_id").to_numpy(zero_copy_only=False))
        lengths.append(np.diff(offsets))
        blobs.append(data.tobytes())
        size += len(data)
        if size >= CHUNK_BYTES // 2:
            yield packed()
            ids, lengths, blobs, size, seq = [], [], [], 0, seq + 1
    if ids:
        yield packed()


# ---------------------------------------------------------------- anchors and contexts


def slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over each window of so many values."""
    n = 1
    m = x
    while 2 * n <= width:
        m = f(m[:-n], m[n:])
        n *= 2
    return f(m[: len(m) - (width - n)], m[width - n :]) if n < width else m


class Chunk:
    """The texts of a chunk with their anchors."""

    def __init__(self, ids: bytes, offsets: bytes, blob: bytes, length: int = LENGTH, k: int = K):
        self.length, self.k, self.width = length, k, length - k + 1
        self.ids, self.offsets, self.data = np.frombuffer(ids, "<i8"), np.frombuffer(offsets, "<i8"), np.frombuffer(blob, np.uint8)
        self.prefix = C.prefix_hash(self.data)
        n = len(self.data) - length + 1  # strings, also those across documents, which are left out below
        if n <= 0:
            self.at, self.key, self.rank = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint32)
            return
        code = C.mix((self.prefix[k:] - self.prefix[:-k]) * C.powers(C._RINV, len(self.prefix))[: len(self.prefix) - k])
        self.rank = (code >> np.uint64(32)).astype(np.uint32)
        # grams that cross a border come last, so they are anchors of strings that cross it only
        crossing = np.zeros(len(self.rank), bool)
        for border in self.offsets[1:-1]:
            crossing[max(0, border - k + 1) : border] = True
        self.rank[crossing] = 0xFFFFFFFF
        least = slide(self.rank, self.width, np.minimum)
        pad = np.zeros(self.width - 1, np.uint32)
        most = slide(np.concatenate([pad, least, pad]), self.width, np.maximum)
        self.at = np.flatnonzero((self.rank == most[: len(self.rank)]) & ~crossing)
        self.key = C.mix(code[self.at] ^ np.uint64(0x5851F42D4C957F2D))

    def documents(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, at, side="right") - 1

    def fingerprints(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Different fingerprints (range, then 32 bits) in order, and which occur in several documents here."""
        key = self.key >> np.uint64(32 - bits)
        order = np.argsort(key, kind="stable")
        key, doc = key[order], self.ids[self.documents(self.at)][order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        if not len(first):
            return key, np.zeros(0, bool)
        return key[first], np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)

    def contexts(self, repeated: np.ndarray | None, bits: int, hot: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """Contexts of the anchors with these fingerprints (None: of all): range, place (lo, to hi: the first and last string), document; and, for the different ones in order of range and hash, `first` and the smallest doc_id.

        hot: for each fingerprint the number of ranges of its own, 0 for the usual one.
        """
        key = self.key >> np.uint64(32 - bits)
        if repeated is None:
            wanted, own = np.ones(len(key), bool), np.zeros(len(key), np.int64)
        else:
            place = np.minimum(np.searchsorted(repeated, key), max(0, len(repeated) - 1))
            wanted = repeated[place] == key if len(repeated) else np.zeros(len(key), bool)
            own = hot[place] if hot is not None and len(repeated) else np.zeros(len(key), np.int64)
        at, key, own = self.at[wanted], self.key[wanted], own[wanted]
        doc = self.documents(at)
        rank = self.rank[at]
        lo, hi = np.maximum(at - self.width + 1, self.offsets[doc]), np.minimum(at, self.offsets[doc + 1] - self.length)
        for d in range(1, self.width):
            before, after = at - d, at + d
            held = (before >= lo) & (self.rank[np.maximum(before, 0)] <= rank)
            lo[held] = before[held] + 1
            held = (after < len(self.rank)) & (self.rank[np.minimum(after, len(self.rank) - 1)] < rank)
            hi[held] = np.minimum(hi[held], after[held] - self.width)
        good = lo <= hi
        lo, hi, doc, key, own = lo[good], hi[good], doc[good], key[good], own[good]
        part = (key >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
        if own.any():  # each string of a hot anchor by itself, in the range that its hash says
            n = np.where(own > 0, hi - lo + 1, 1)
            lo, hi, doc, part, own = (np.repeat(x, n) for x in (lo, hi, doc, part, own))
            step = np.arange(len(lo)) - np.repeat(np.cumsum(n) - n, n)
            lo = lo + step
            hi = np.where(own > 0, lo, hi)
            code = C.span_hash(self.prefix, lo, lo + self.length)
            part = np.where(own > 0, part | ((1 + (code >> np.uint64(20)).astype(np.int64) % np.maximum(own, 1)) << 40), part)
        code = C.span_hash(self.prefix, lo, hi + self.length)
        order = np.lexsort((self.ids[doc], hi - lo, code, part))
        lo, hi, doc, part, code = lo[order], hi[order], doc[order], part[order], code[order]
        new = np.append(True, (code[1:] != code[:-1]) | (part[1:] != part[:-1]) | (np.diff(hi - lo) != 0)) if len(code) else np.zeros(0, bool)
        apart(self.data, lo, hi - lo + self.length, new)
        return {"lo": lo, "hi": hi, "id": self.ids[doc], "part": part, "of": np.cumsum(new) - 1, "first": np.flatnonzero(new)}


def apart(data: np.ndarray, start: np.ndarray, size: np.ndarray, new: np.ndarray) -> None:
    """Marks in `new`, where it says that groups of equal spans begin, all spans of groups that are not equal in bytes."""
    if new.all():
        return
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    rest = np.flatnonzero(~new)
    for a in range(0, len(rest), 1 << 16):
        some = rest[a : a + (1 << 16)]
        n = size[some]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        unlike = data[np.repeat(start[some], n) + step] != data[np.repeat(start[first[group[some]]], n) + step]
        if unlike.any():
            new |= np.isin(group, group[some][np.unique(np.repeat(np.arange(len(some)), n)[unlike])])


def ranges(key: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """Range, from and to of sorted fingerprints."""
    part = (key >> np.uint64(32)).astype(np.int64)
    cut = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]]) if len(part) else [0]
    return [(int(part[a]), int(a), int(b)) for a, b in zip(cut[:-1], cut[1:])]


FINGER_SCHEMA = "g long, chunk long, keys binary, many binary"


def _send_fingerprints(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, offsets, blob = (batch.column(c)[row].as_buffer() for c in ("ids", "offsets", "blob"))
                key, many = Chunk(ids, offsets, blob).fingerprints(bits)
                out = [(g, (key[a:b] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), np.packbits(many[a:b]).tobytes()) for g, a, b in ranges(key, bits)]
                chunk = batch.column("chunk")[row].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([chunk] * len(out), pa.int64()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())], ["g", "chunk", "keys", "many"])

    return run


ANSWER_SCHEMA = "chunk long, g long, keys binary, hot binary"


def _repeated(table: pa.Table) -> Iterator[pa.RecordBatch]:
    cut = borders(table.column("g").to_numpy())
    for lo, hi in zip(cut[:-1], cut[1:]):
        part = table.slice(lo, hi - lo)
        keys = [np.frombuffer(x.as_buffer(), "<u4") for x in part.column("keys")]
        many = [np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=len(k)).astype(bool) for x, k in zip(part.column("many"), keys)]
        everything = np.sort(np.concatenate([*keys, *(k[m] for k, m in zip(keys, many))]))
        twice, count = np.unique(everything, return_counts=True)
        twice, count = twice[count > 1], count[count > 1]
        chunk, g = part.column("chunk").to_pylist(), part.column("g")[0].as_py()
        for i, k in enumerate(keys):
            at = np.flatnonzero(np.isin(twice, k, assume_unique=True, kind="sort"))
            if len(at):
                hot = (count[at] > HOT_CHUNKS) * (1 + count[at] // HOT_CHUNKS)
                values = [[chunk[i]], [g], [twice[at].tobytes()], [hot.astype("<u4").tobytes() if hot.any() else None]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, [pa.int64(), pa.int64(), pa.binary(), pa.binary()])], ["chunk", "g", "keys", "hot"])


def _wanted(answers) -> tuple[np.ndarray, np.ndarray]:
    """All fingerprints that some ranges have answered with, in order, and for each the number of ranges of its own."""
    answers = sorted(answers or [], key=lambda x: x["g"])
    keys = [np.frombuffer(x["keys"], "<u4").astype(np.uint64) for x in answers]
    hot = [np.frombuffer(x["hot"], "<u4").astype(np.int64) if x["hot"] else np.zeros(len(k), np.int64) for x, k in zip(answers, keys)]
    keys = [(np.uint64(x["g"]) << np.uint64(32)) | k for x, k in zip(answers, keys)]
    return (np.concatenate(keys), np.concatenate(hot)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


CONTEXT_SCHEMA = "g long, chunk long, lengths binary, ids binary, text binary"


def _send_contexts(bits: int, every: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield from one(batch, row)

    def one(batch: pa.RecordBatch, row: int) -> Iterator[pa.RecordBatch]:
        ids, offsets, blob = (batch.column(c)[row].as_buffer() for c in ("ids", "offsets", "blob"))
        chunk = Chunk(ids, offsets, blob)
        keys, hot = (None, None) if every else _wanted(batch.column("answers")[row].as_py())
        x = chunk.contexts(keys, bits, hot)
        first = x["first"]
        lo, n, part, doc = x["lo"][first], x["hi"][first] - x["lo"][first] + chunk.length, x["part"][first], x["id"][first]
        # bytes of all contexts, one after the other
        flat = chunk.data[np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)]
        cut = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]]) if len(part) else np.zeros(1, int)
        ends = np.concatenate([[0], np.cumsum(n)])
        name = batch.column("chunk")[row].as_py()
        for a, b in zip(cut[:-1], cut[1:]):
            values = [[int(part[a])], [name], [n[a:b].astype("<u2").tobytes()], [doc[a:b].astype("<i8").tobytes()], [flat[ends[a] : ends[b]].tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()])], ["g", "chunk", "lengths", "ids", "text"])

    return run


# ---------------------------------------------------------------- the family


def strings(text: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The strings of `length` bytes at some places, as values that NumPy orders by their bytes."""
    return np.lib.stride_tricks.sliding_window_view(text, length)[at].reshape(len(at) * length).view(f"S{length}")


def prefixes(keys: np.ndarray) -> np.ndarray:
    """Longest common prefix of each string with the one before it; of the first, 0."""
    width = keys.dtype.itemsize
    out = np.zeros(len(keys), np.int64)
    for a in range(1, len(keys), 1 << 16):
        x = keys[a - 1 : a + (1 << 16)].view(np.uint8).reshape(-1, width)
        unlike = x[1:] != x[:-1]
        out[a : a + (1 << 16)] = np.where(unlike.any(1), unlike.argmax(1), width)
    return out


class Level:
    """A text and its suffix array: the places of different strings of `length` bytes, in the order of those bytes."""

    def __init__(self, text: np.ndarray, at: np.ndarray, length: int):
        self.text, self.at, self.length = text, at, length

    def __len__(self) -> int:
        return len(self.at)

    def keys(self) -> np.ndarray:
        return strings(self.text, self.at, self.length)

    def scan(self, keys: np.ndarray) -> np.ndarray:
        """Merge-scan: which of these different strings in order the level has."""
        both = np.concatenate([self.keys(), keys])
        order = np.argsort(both, kind="stable")  # a merge of two runs
        same = prefixes(both[order]) == self.length
        out = np.zeros(len(both), bool)
        out[order] = same
        return out[len(self) :]

    def merged(self, other: Level) -> Level:
        """One level of two that have no string in common."""
        order = np.argsort(np.concatenate([self.keys(), other.keys()]), kind="stable")
        return Level(np.concatenate([self.text, other.text]), np.concatenate([self.at, other.at + len(self.text)])[order], self.length)


class Family:
    """Suffix arrays in levels; a level has about twice the size of the next at least."""

    def __init__(self, levels: list[Level] | None = None):
        self.levels: list[Level] = list(levels or [])

    def seen(self, keys: np.ndarray) -> np.ndarray:
        """Which of these different strings in order some level has."""
        out = np.zeros(len(keys), bool)
        for level in self.levels:
            if len(level):
                left = np.flatnonzero(~out)
                out[left] = level.scan(keys[left])
        return out

    def add(self, level: Level) -> None:
        """A new level of strings that no other has; levels that it has caught up with are merged into it."""
        if not len(level):
            return
        self.levels.append(level)
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            a, b = self.levels.pop(), self.levels.pop()
            self.levels.append(b.merged(a))


def batches_of(ids: np.ndarray, strings: np.ndarray, most: int = BATCH_STRINGS) -> Iterator[np.ndarray]:
    """Contexts in batches of ascending ids; a batch ends where an id ends, after so many strings at the least."""
    order = np.argsort(ids, kind="stable")
    ends = np.append(np.flatnonzero(ids[order][1:] != ids[order][:-1]) + 1, len(order))
    total = np.cumsum(strings[order])[ends - 1]
    at, done = 0, 0
    while at < len(order):
        to = int(ends[min(np.searchsorted(total, done + most), len(ends) - 1)])
        yield order[at:to]
        at, done = to, int(total[np.searchsorted(ends, to)])


def hashes(text: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of spans that lie end to end, some million bytes at a time."""
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(start, start[at] + (1 << 20))))
        low = start[at]
        out[at:to] = C.span_hash(C.prefix_hash(text[low : start[to - 1] + size[to - 1]]), start[at:to] - low, start[at:to] - low + size[at:to])
        at = to
    return out


def earlier(family: Family, text: np.ndarray, start: np.ndarray, size: np.ndarray, code: np.ndarray, ids: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For a batch of contexts with hashes, string by string: whether it starts in a document with a smaller id, in the batch or before it; adds the batch."""
    # equal contexts: the one with the smallest id stands for all
    order = np.lexsort((ids, size, code))
    new = np.append(True, (np.diff(code[order]) != 0) | (np.diff(size[order]) != 0))
    apart(text, start[order], size[order], new)
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    own = order[new]
    n = size[own]
    begin = np.cumsum(n) - n
    held = text[np.arange(int(n.sum())) + np.repeat(start[own] - begin, n)]

    count = n - length + 1
    first = np.cumsum(count) - count
    context = np.repeat(np.arange(len(own)), count)
    at = np.arange(int(count.sum())) - np.repeat(first, count) + begin[context]
    # the batch's suffix array, and its different strings
    keys = strings(held, at, length)
    rank = np.argsort(keys, kind="stable")
    keys = keys[rank]
    opens = prefixes(keys) < length
    opens[:1] = True
    group = np.cumsum(opens) - 1
    lead = np.flatnonzero(opens)
    who = ids[own][context][rank]
    least = np.minimum.reduceat(who, lead) if len(lead) else who
    known = family.seen(keys[lead])
    hit = np.zeros(len(at), bool)
    hit[rank] = known[group] | (who > least[group])

    # what is new becomes a level, with the contexts that hold it
    fresh = rank[lead[~known]]
    used = np.zeros(len(own), bool)
    used[context[fresh]] = True
    kept = np.where(used, n, 0)
    moved = np.cumsum(kept) - kept
    family.add(Level(held[np.repeat(used, n)], (at - begin[context] + moved[context])[fresh], length))

    each = size - length + 1
    step = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
    return hit[np.repeat(first[of], each) + step] | np.repeat(ids > ids[own][of], each)


BIT_SCHEMA = "chunk long, g long, bits binary, text binary"
_BIT_KINDS = list(zip(["chunk", "g", "bits", "text"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()]))


def _scan(length: int, store: bool = False):
    """Answers of a range; store: levels come as rows with a negative chunk, and the new one goes out as such a row."""

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        cut = borders(table.column("g").to_numpy())
        for lo, hi in zip(cut[:-1], cut[1:]):
            yield from one(table.slice(lo, hi - lo))

    def one(part: pa.Table) -> Iterator[pa.RecordBatch]:
        g = part.column("g")[0].as_py()
        chunk = part.column("chunk").to_numpy()
        view = lambda x, kind: np.frombuffer(x.as_buffer(), kind)
        levels = [Level(view(part.column("text")[i], np.uint8), view(part.column("ids")[i], "<i8"), length) for i in np.flatnonzero(chunk < 0).tolist()]
        part = part.filter(pa.array(chunk >= 0))
        if not part.num_rows:
            return
        family, n_stored = Family(sorted(levels, key=len, reverse=True)), len(levels)
        lengths = [view(x, "<u2").astype(np.int64) for x in part.column("lengths")]
        ids = np.concatenate([view(x, "<i8") for x in part.column("ids")])
        data = np.concatenate([view(x, np.uint8) for x in part.column("text")])
        chunks = part.column("chunk").to_pylist()
        del part
        n = np.concatenate(lengths)
        count = n - length + 1
        begin, place = np.cumsum(n) - n, np.cumsum(count) - count
        hit, stored = np.zeros(int(count.sum()), bool), family.levels[:n_stored]
        fresh, code = Family(), hashes(data, begin, n)
        for batch in batches_of(ids, count):
            k = count[batch]
            found = earlier(_Both(stored, fresh), data, begin[batch], n[batch], code[batch], ids[batch], length)
            hit[np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k) + np.repeat(place[batch], k)] = found
        ends = np.concatenate([[0], np.cumsum([int((x - length + 1).sum()) for x in lengths])])
        rows = [(c, g, np.packbits(hit[a:b]).tobytes(), None) for c, a, b in zip(chunks, ends[:-1], ends[1:])]
        if store and fresh.levels:
            new = fresh.levels[0]
            for level in fresh.levels[1:]:
                new = new.merged(level)
            rows.append((-1, g, new.at.astype("<i8").tobytes(), new.text.tobytes()))
        for a in range(0, len(rows), 256):
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(zip(*rows[a : a + 256]), _BIT_KINDS)], [c for c, _ in _BIT_KINDS])

    return grouped(work)


class _Both(Family):
    """Levels that are stored, which stay as they are, and a family that takes what is new."""

    def __init__(self, stored: list[Level], fresh: Family):
        super().__init__([*stored, *fresh.levels])
        self.fresh = fresh

    def add(self, level: Level) -> None:
        self.fresh.add(level)


SPAN_SCHEMA = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept_sha256 string"


def _mark(bits: int, every: bool = False):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield one(batch, row)

    def one(batch: pa.RecordBatch, row: int) -> pa.RecordBatch:
        ids, offsets, blob = (batch.column(c)[row].as_buffer() for c in ("ids", "offsets", "blob"))
        chunk = Chunk(ids, offsets, blob)
        keys, hot = (None, None) if every else _wanted(batch.column("answers")[row].as_py())
        x = chunk.contexts(keys, bits, hot)
        n = len(chunk.data)
        steps = np.zeros(n + 1, np.int64)
        if len(x["first"]):
            # the answers' bits stand in the order of the different contexts, range by range
            strings = x["hi"] - x["lo"] + 1
            part, own = x["part"][x["first"]], strings[x["first"]]
            hit = np.zeros(int(own.sum()), bool)
            ends = np.concatenate([[0], np.cumsum(own)])
            for answer in batch.column("marks")[row].as_py() or []:
                a, b = np.searchsorted(part, [answer["g"], answer["g"] + 1])
                hit[ends[a] : ends[b]] = np.unpackbits(np.frombuffer(answer["bits"], np.uint8), count=int(ends[b] - ends[a]))
            at = np.arange(int(strings.sum())) - np.repeat(np.cumsum(strings) - strings, strings)
            of = np.repeat(x["of"], strings)
            copy = np.repeat(x["id"] > x["id"][x["first"]][x["of"]], strings)
            gone = (hit[ends[of] + at] | copy).nonzero()[0]
            start = (np.repeat(x["lo"], strings) + at)[gone]
            steps += np.bincount(start, minlength=n + 1) - np.bincount(start + chunk.length, minlength=n + 1)
        removed = np.cumsum(steps[:n]) > 0
        edge = np.diff(np.concatenate([[0], removed.view(np.int8), [0]]))
        opens, closes = edge[:-1] == 1, edge[1:] == -1
        inner = chunk.offsets[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        opens[inner] |= removed[inner]
        closes[inner - 1] |= removed[inner - 1]
        opens, closes = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        bounds = np.searchsorted(opens, chunk.offsets)
        data, spans, shas = blob.to_pybytes(), [], []
        for d, (a, b) in enumerate(zip(chunk.offsets[:-1].tolist(), chunk.offsets[1:].tolist())):
            here = list(zip(opens[bounds[d] : bounds[d + 1]].tolist(), closes[bounds[d] : bounds[d + 1]].tolist()))
            sha, at = hashlib.sha256(), a
            for s, e in here:
                sha.update(data[at:s])
                at = e
            sha.update(data[at:b])
            shas.append(sha.hexdigest())
            spans.append([{"start": s - a, "end": e - a} for s, e in here])
        return pa.RecordBatch.from_arrays([pa.array(chunk.ids, mask=chunk.ids == NO_ID), pa.array(np.diff(chunk.offsets)), pa.array(spans, kind), pa.array(shas)], ["doc_id", "n_bytes", "spans", "kept_sha256"])

    return run


class _Chunks:
    """The packed texts: a bucketed table whose name is dropped, and its files deleted, once nothing reads it any more."""

    def __init__(self, docs: DataFrame):
        self.spark, self.name, self.path = docs.sparkSession, f"sigloom_chunks_{uuid.uuid4().hex[:12]}", C.work_dir(docs.sparkSession, "chunks")
        base = C.texts(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
        self.total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(self.total / BUCKET_BYTES))
        base.mapInArrow(C.freed(_pack), CHUNK_SCHEMA).write.bucketBy(min(buckets, 100_000), "chunk").option("path", self.path).format("parquet").saveAsTable(self.name)
        self.table = self.spark.table(self.name)

    def finish(self, result: DataFrame) -> DataFrame:
        result = C.materialise(result, "spans")
        self.spark.sql(f"DROP TABLE {self.name}")
        C.delete(self.spark, self.path)
        return result


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (removed bytes, maximal runs) and kept_sha256 of each row."""
    chunks = _Chunks(docs)
    bits = max(0, (chunks.total // RANGE_STRINGS).bit_length())

    sent = chunks.table.mapInArrow(C.freed(_send_fingerprints(bits)), FINGER_SCHEMA)
    answers = C.materialise(sent.repartition("g").sortWithinPartitions("g").mapInArrow(C.freed(grouped(_repeated)), ANSWER_SCHEMA), "repeated")
    by_chunk = answers.groupBy("chunk").agg(F.collect_list(F.struct("g", "keys", "hot")).alias("answers"))
    asked = chunks.table.join(by_chunk, "chunk", "left")

    contexts = asked.select("chunk", "ids", "offsets", "blob", "answers").mapInArrow(C.freed(_send_contexts(bits)), CONTEXT_SCHEMA)
    marks = C.materialise(contexts.repartition("g").sortWithinPartitions("g").mapInArrow(C.freed(_scan(LENGTH)), BIT_SCHEMA), "marks")
    marked = asked.join(marks.groupBy("chunk").agg(F.collect_list(F.struct("g", "bits")).alias("marks")), "chunk", "left")
    spans = chunks.finish(marked.select("chunk", "ids", "offsets", "blob", "answers", "marks").mapInArrow(C.freed(_mark(bits)), SPAN_SCHEMA))
    C.discard(answers)
    C.discard(marks)
    return spans


LEVEL_SCHEMA = "g long, n long, at binary, text binary"


class SuffixIndex:
    """Levels of suffix arrays in a shared folder, one row for each key range of a level.

    add() scans a batch against them, as if all that is stored had smaller ids, and stores it; levels of like size are
    merged, range by range. The number of ranges is settled when the folder is new. A level's folder appears under its name
    once it is complete, and what it replaces is deleted after that, so a run that is lost leaves the levels as they were.
    """

    def __init__(self, spark: SparkSession, path: str, bits: int = 8):
        self.spark, self.path = spark, path.rstrip("/")
        made = [n.split("-") for n in C.names(spark, self.path) if n.startswith("level-")]
        # level-<bits>-<number>-<strings>-<numbers that it replaces>
        gone = {x for _, _, _, _, old in made for x in old.split(".")}
        self.levels = sorted(((int(number), int(n)) for _, _, number, n, _ in made if number not in gone), key=lambda x: -x[1])
        self.names = {int(m[2]): "-".join(m) for m in made}
        self.bits = int(made[0][1]) if made else bits

    def _read(self, number: int) -> DataFrame:
        return self.spark.read.schema(LEVEL_SCHEMA).parquet(f"{self.path}/{self.names[number]}")

    def _write(self, level: DataFrame, old: list[int]) -> None:
        held = C.materialise(level, "level")
        n = held.agg(F.sum("n")).first()[0] or 0
        number = max(self.names, default=0) + 1
        name = f"level-{self.bits}-{number}-{n}-{'.'.join(map(str, old))}"
        C.move(self.spark, held.sigloom_path, f"{self.path}/{name}")
        self.names[number] = name
        for x in old:
            C.delete(self.spark, f"{self.path}/{self.names[x]}")
        self.levels = sorted([x for x in self.levels if x[0] not in old] + [(number, n)], key=lambda x: -x[1])

    def add(self, docs: DataFrame) -> DataFrame:
        """The result of suffix_dedup for a batch after all that are stored."""
        chunks = _Chunks(docs)
        contexts = chunks.table.mapInArrow(C.freed(_send_contexts(self.bits, True)), CONTEXT_SCHEMA)
        for number, _ in self.levels:
            contexts = contexts.unionByName(self._read(number).select("g", F.lit(-1 - number).cast("long").alias("chunk"), F.lit(b"").alias("lengths"), F.col("at").alias("ids"), "text"))
        found = C.materialise(contexts.repartition("g").sortWithinPartitions("g", "chunk").mapInArrow(C.freed(_scan(LENGTH, True)), BIT_SCHEMA), "marks")
        marks = found.where("chunk >= 0").groupBy("chunk").agg(F.collect_list(F.struct("g", "bits")).alias("marks"))
        spans = chunks.finish(chunks.table.join(marks, "chunk", "left").select("chunk", "ids", "offsets", "blob", "marks").mapInArrow(C.freed(_mark(self.bits, True)), SPAN_SCHEMA))
        self._write(found.where("chunk < 0").select("g", (F.octet_length("bits") / 8).cast("long").alias("n"), F.col("bits").alias("at"), "text"), [])
        C.discard(found)
        while near := [(x[0], y[0]) for x, y in zip(self.levels, self.levels[1:]) if x[1] < 2 * y[1]]:
            a, b = near[-1]
            both = self._read(a).unionByName(self._read(b))
            self._write(both.repartition("g").sortWithinPartitions("g").mapInArrow(C.freed(grouped(_merge_levels(LENGTH))), LEVEL_SCHEMA), [a, b])
        return spans


def _merge_levels(length: int):
    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        cut = borders(table.column("g").to_numpy())
        for lo, hi in zip(cut[:-1], cut[1:]):
            levels = [Level(np.frombuffer(table.column("text")[i].as_buffer(), np.uint8), np.frombuffer(table.column("at")[i].as_buffer(), "<i8"), length) for i in range(lo, hi)]
            made = levels[0].merged(levels[1]) if len(levels) > 1 else levels[0]
            values = [[table.column("g")[lo].as_py()], [len(made)], [made.at.astype("<i8").tobytes()], [made.text.tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, [pa.int64(), pa.int64(), pa.binary(), pa.binary()])], ["g", "n", "at", "text"])

    return work


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["end"] - s["start"])
    return suffix_dedup(C.table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", length.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


#: Bytes as pairs of hexadecimal digits: every string of LENGTH bytes, the smallest doc_id that has it, and the runs of what goes.
OP9_SQL = f"""
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
s AS (SELECT doc_id, i, substr(h, 2 * i + 1, {2 * LENGTH}) AS x FROM (SELECT doc_id, h, unnest(range(n - {LENGTH} + 1)) AS i FROM t)),
f AS (SELECT x, min(doc_id) AS first FROM s GROUP BY x HAVING count(DISTINCT doc_id) > 1),
g AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {LENGTH}, true) AS opens FROM s JOIN f USING (x) WHERE first < doc_id),
r AS (SELECT doc_id, min(i) AS a, max(i) + {LENGTH} AS b FROM (SELECT *, count(*) FILTER (opens) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g) GROUP BY doc_id, k),
p AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS last FROM r),
q AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS runs, max(b) AS tail, string_agg(substr(h, 2 * last + 1, 2 * (a - last)), '' ORDER BY a) AS kept FROM p JOIN t USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(runs, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM t LEFT JOIN q USING (doc_id)"""
