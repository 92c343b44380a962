"""Benchmark decontamination by template canonicalisation.

Words lose the signs around them and their case; numbers, names (capitalised words inside a sentence, but not words in capitals throughout) and units (after a
number) become typed placeholders. Windows of WINDOW such words, with LITERALS of them not placeholders, are hashed for the
benchmark and for the documents and joined. For each document and item, windows at one shift form an alignment; what stands
in the item's slots must be taken over consistently there: one value of the item has one value in the document, and
different values of a kind stay different. Consistent alignments are put together; the document is contaminated where they
cover SHARE of the item's words, so a question with other numbers or names is found, and one with a phrase in common is not.

Items of fewer words than WINDOW are one window of their own length; those with fewer than LITERALS words that are no
placeholders have no template. Whether a word begins a sentence, and so is no name, depends on what stands before the item.

So exact copies have a way of their own, for items of any length: windows of the words themselves, without case and the signs
around them (quotes and stops beyond ASCII too), laid end to end over the item. A document with all of them at one shift
holds the item word for word; a part of them counts for nothing. The figures of a pair are those of the templates where they
cover SHARE of the item, and else those of the exact copy. An item without a word is not found.

The windows of the benchmark are kept by each worker as sorted hashes where there are MOST_KEPT of them at most, which is
checked; else all windows of the documents are joined by shuffle.

Defined cases: null and blank texts hold no item; rows that repeat a doc_id, or have none, are matched as one document by
id and text; equal items are each reported; other columns are ignored; an empty table on either side gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm import common as C

WINDOW, LITERALS, SHARE = 8, 4, 0.5
MOST_KEPT = 2_000_000
NO_ID = -(1 << 63)

#: What counts as a unit after a number.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg t ton tons lb lbs oz ounce ounces pound pounds ml l liter liters litre litres "
    "gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years cent cents dollar dollars usd eur euro "
    "euros percent degree degrees hz khz mhz w kw kwh v a j kj cal kcal pa kpa kmh mph"
).split()

LITERAL, NUMBER, NAME, UNIT = 0, 1, 2, 3
_CODES = C.mix(np.arange(1, 5, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))

_is = lambda chars: np.isin(np.arange(256), np.frombuffer(chars, np.uint8))
_EDGE = _is(b"\"'`.,;:!?()[]{}<>*#$%&|-_~^/\\=+@")
_STOP = _is(b".!?:;|")
#: Signs beyond ASCII that may stand at a word's edge: of Latin-1, general punctuation, and those of wide scripts.
WIDE_SIGNS = (0xA1, 0xAB, 0xB4, 0xB7, 0xBB, 0xBF, *range(0x2000, 0x2070), *range(0x3000, 0x3004), *range(0x3008, 0x3012), *range(0x3014, 0x3020), *range(0xFF01, 0xFF10), *range(0xFF1A, 0xFF21))
_WIDE = np.sort([int.from_bytes(chr(c).encode()) for c in WIDE_SIGNS])
_LEAD = _is(bytes([0xC2, 0xE2, 0xE3, 0xEF]))
#: Keeps the hashes of exact windows apart from those of templates.
_EXACT = np.uint64(1 << 32)
_DIGIT, _NUMERIC, _UPPER = _is(b"0123456789"), _is(b"0123456789.,:/"), _is(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def lower(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes in lower case (ASCII and Latin-1 letters), and which bytes began a capital."""
    out = data.copy()
    upper = _UPPER[data]
    out[upper] += 32
    second = np.zeros(len(data), bool)
    second[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    out[second] += 32
    capital = upper
    capital[:-1] |= second[1:]
    return out, capital


def _hash_words(words: list[str]) -> np.ndarray:
    raw = "".join(words).encode()
    ends = np.cumsum([len(w.encode()) for w in words])
    data = np.frombuffer(raw, np.uint8)
    return np.sort(C.span_hash(C.prefix_hash(data), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends.astype(np.int64)))


_UNIT_CODES = _hash_words(UNITS)


def _sign(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Whether data[at : at + size] is a sign that may stand at a word's edge."""
    if size == 1:
        return _EDGE[data[at]]
    key = np.zeros(len(at), np.int64)
    for j in range(size):
        key = key << 8 | data[at + j]
    return _WIDE[np.minimum(np.searchsorted(_WIDE, key), len(_WIDE) - 1)] == key


def _bared(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words that have lost their ASCII signs, without signs beyond ASCII and what stands behind those."""
    start, end = start.copy(), end.copy()
    live = np.flatnonzero(_LEAD[data[start]])
    while len(live):
        before = start[live]
        for size in (1, 2, 3):
            fits = live[end[live] - start[live] >= size]
            start[fits] += size * _sign(data, start[fits], size)
        live = live[start[live] > before]
    live = np.flatnonzero((end - start >= 2) & (data[end - 1] >= 0x80) & (_LEAD[data[end - 2]] | _LEAD[data[np.maximum(end - 3, 0)]]))
    while len(live):
        before = end[live]
        for size in (1, 2, 3):
            fits = live[end[live] - start[live] >= size]
            end[fits] -= size * _sign(data, end[fits] - size, size)
        live = live[end[live] < before]
    return start, end


def canonical(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Start, end, document, kind and code (of the word or its placeholder) of each canonical word; value: hash of what stands there; plain: of what is left of it without signs beyond ASCII, if real."""
    low, capital = lower(data)
    start, end, doc = C.words(data, offsets)
    raw_end = end
    start, end = start.copy(), end.copy()
    live = np.arange(len(start))
    while len(live):  # signs before a word
        live = live[(start[live] < end[live])]
        live = live[_EDGE[data[start[live]]]]
        start[live] += 1
    live = np.arange(len(start))
    while len(live):  # and after it
        live = live[(start[live] < end[live])]
        live = live[_EDGE[data[end[live] - 1]]]
        end[live] -= 1
    stops = _STOP[data[raw_end - 1]] if len(raw_end) else np.zeros(0, bool)
    begins = np.ones(len(start), bool)  # of a sentence
    begins[1:] = stops[:-1] | (doc[1:] != doc[:-1])
    bare = start >= end  # signs alone: no word, but a sentence may end there
    if bare.any():
        carry = begins.copy()
        for i in np.flatnonzero(bare):
            if i + 1 < len(carry) and doc[i + 1] == doc[i]:
                carry[i + 1] |= carry[i]
        begins = carry
    keep = ~bare
    start, end, doc, begins = start[keep], end[keep], doc[keep], begins[keep]
    prefix = C.prefix_hash(low)
    value = C.span_hash(prefix, start, end)
    plain, real = value.copy(), np.ones(len(start), bool)
    if len(start):
        s, e = _bared(data, start, end)
        other = np.flatnonzero((s > start) | (e < end))
        plain[other], real[other] = C.span_hash(prefix, s[other], e[other]), s[other] < e[other]
    numeric = np.concatenate([[0], np.cumsum(_NUMERIC[data])])
    number = _DIGIT[data[start]] & (numeric[end] - numeric[start] == end - start) if len(start) else np.zeros(0, bool)
    # one capital, at the beginning: words in capitals throughout are no names, nor are single letters
    capitals = np.concatenate([[0], np.cumsum(capital)])
    name = (capital[start] & ~begins & (capitals[end] - capitals[start] == 1) & (end - start > 1)) if len(start) else np.zeros(0, bool)
    unit = np.zeros(len(start), bool)
    if len(start) > 1:
        at = np.minimum(np.searchsorted(_UNIT_CODES, value), len(_UNIT_CODES) - 1)
        unit[1:] = (_UNIT_CODES[at] == value)[1:] & number[:-1] & (doc[1:] == doc[:-1])
    kind = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, LITERAL)))
    code = np.where(kind == LITERAL, value, _CODES[kind])
    return {"start": start, "end": end, "doc": doc, "kind": kind, "code": code, "value": value, "plain": plain, "real": real}


def windows(x: dict[str, np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Place (of the first word) and hash of each window with enough literals."""
    n = len(x["code"])
    if n < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    literal = np.concatenate([[0], np.cumsum(x["kind"] == LITERAL)])
    at = np.arange(n - size + 1)
    good = (x["doc"][at] == x["doc"][at + size - 1]) & (literal[at + size] - literal[at] >= min(LITERALS, size))
    at = at[good]
    return at, C.mix(C.window_hash(x["code"], size)[at] + np.uint64(size))


def exact_words(x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of each word as it stands."""
    return x["doc"][x["real"]], x["plain"][x["real"]]


def exact_windows(doc: np.ndarray, plain: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash of each window of words as they stand."""
    at = np.arange(max(0, len(plain) - size + 1))
    at = at[doc[at] == doc[at + size - 1]]
    return at, C.mix(C.window_hash(plain, size)[at] + np.uint64(size) + _EXACT)


def _slots(x: dict[str, np.ndarray], at: np.ndarray, size: int) -> list[bytes]:
    """Kind and value of each slot of a window, nine bytes each; literals are left out."""
    n = np.concatenate([[0], np.cumsum(x["kind"] != LITERAL)])
    out = [b""] * len(at)
    for i in np.flatnonzero(n[at + size] > n[at]).tolist():
        a = int(at[i])
        slot = a + np.flatnonzero(x["kind"][a : a + size] != LITERAL)
        out[i] = b"".join(bytes([x["kind"][s]]) + int(x["value"][s]).to_bytes(8, "little") for s in slot)
    return out


#: exact: how many exact windows the item has, and 0 for a template; the slots of an exact window are a digest of the item.
ITEM_SCHEMA = "item_id long, n_words int, size int, item_pos int, window long, item_slots binary, exact int"


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in C.slices(batches):
        x = canonical(*C.buffers(C.flat(batch, "text")))
        count = np.bincount(x["doc"], minlength=batch.num_rows)
        first = np.concatenate([[0], np.cumsum(count)])
        ids = batch.column("item_id").to_numpy(zero_copy_only=False)
        names = ["item_id", "n_words", "size", "item_pos", "window", "item_slots", "exact"]
        for size in sorted({WINDOW, *(int(c) for c in np.unique(count) if LITERALS <= c < WINDOW)}):
            at, code = windows(x, size)
            doc = x["doc"][at]
            right = count[doc] >= WINDOW if size == WINDOW else count[doc] == size
            at, code, doc = at[right], code[right], doc[right]
            values = [ids[doc], count[doc].astype(np.int32), np.full(len(at), size, np.int32), (at - first[doc]).astype(np.int32), code.view(np.int64)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, values), pa.array(_slots(x, at, size), pa.binary()), pa.array(np.zeros(len(at), np.int32))], names)
        owner, plain = exact_words(x)
        n = np.bincount(owner, minlength=batch.num_rows)
        first = np.concatenate([[0], np.cumsum(n)])
        digests = [hashlib.blake2b(t.encode(), digest_size=8).digest() for t in batch.column("text").to_pylist()]
        for size in sorted({min(WINDOW, int(c)) for c in np.unique(n) if c}):
            at, code = exact_windows(owner, plain, size)
            doc = owner[at]
            pos = at - first[doc]
            right = (np.minimum(n[doc], WINDOW) == size) & ((pos % size == 0) | (pos == n[doc] - size))
            pos, code, doc = pos[right], code[right], doc[right]
            values = [ids[doc], count[doc].astype(np.int32), np.full(len(pos), size, np.int32), pos.astype(np.int32), code.view(np.int64)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, values), pa.array([digests[d] for d in doc.tolist()], pa.binary()), pa.array((-(-n[doc] // size)).astype(np.int32))], names)


DOC_SCHEMA = "doc_id long, tie long, doc_pos int, window long, doc_slots binary"


def _doc_windows(sizes: list[int], exact_sizes: list[int], kept: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches):
            x = canonical(*C.buffers(C.flat(batch, "text")))
            first = np.searchsorted(x["doc"], np.arange(batch.num_rows))
            ids, tie = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("tie").to_numpy(zero_copy_only=False)
            owner, plain = exact_words(x) if exact_sizes else (None, None)
            for size, exact in [*((s, False) for s in sizes), *((s, True) for s in exact_sizes)]:
                at, code = exact_windows(owner, plain, size) if exact else windows(x, size)
                if kept is not None and len(at):
                    hit = kept[np.minimum(np.searchsorted(kept, code), len(kept) - 1)] == code
                    at, code = at[hit], code[hit]
                if exact:
                    doc = owner[at]
                    if size < WINDOW:  # the whole item: one copy of it is enough
                        order = np.lexsort((at, code, doc))
                        new = np.ones(len(order), bool)
                        new[1:] = (doc[order][1:] != doc[order][:-1]) | (code[order][1:] != code[order][:-1])
                        at, code, doc = at[order[new]], code[order[new]], doc[order[new]]
                    values = [ids[doc], tie[doc], (at - np.searchsorted(owner, doc)).astype(np.int32), code.view(np.int64)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, values), pa.array([b""] * len(at), pa.binary())], ["doc_id", "tie", "doc_pos", "window", "doc_slots"])
                    continue
                doc = x["doc"][at]
                values = [ids[doc], tie[doc], (at - first[doc]).astype(np.int32), code.view(np.int64)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, values), pa.array(_slots(x, at, size), pa.binary())], ["doc_id", "tie", "doc_pos", "window", "doc_slots"])

    return run


def consistent(pairs: list[tuple[bytes, bytes]]) -> bool:
    """Whether one value of the item has one value in the document, and different values of a kind stay different."""
    there: dict[bytes, bytes] = {}
    back: dict[bytes, bytes] = {}
    for item, doc in pairs:
        for i in range(0, len(item), 9):
            a, b = item[i : i + 9], doc[i : i + 9]
            if there.setdefault(a, b) != b or back.setdefault(b, a) != a:
                return False
    return True


ALIGNED_SCHEMA = "doc_id long, tie long, item_id long, n_words int, marks array<long>"
#: Marks of an alignment: places of the item that it covers, from 0; slots with another value, below 0; and that it holds the whole item.
WHOLE = (1 << 63) - 1


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Judges each alignment: one document, one item, one shift, at most one hit for each window of the item."""
    kinds = {"doc_id": pa.int64(), "tie": pa.int64(), "item_id": pa.int64(), "n_words": pa.int32(), "marks": pa.list_(pa.int64())}
    for batch in batches:
        marks = []
        for hits in batch.column("hits").to_pylist():
            found: set[int] = set()
            copies: dict[bytes, set[int]] = {}
            for h in hits:
                if h["exact"]:
                    there = copies.setdefault(h["item_slots"], set())
                    there.add(h["item_pos"])
                    if len(there) == h["exact"]:
                        found.add(WHOLE)
            windows = [h for h in hits if not h["exact"]]
            if consistent([(h["item_slots"], h["doc_slots"]) for h in windows]):
                for h in windows:
                    found |= set(range(h["item_pos"], h["item_pos"] + h["size"]))
                    a, b = h["item_slots"], h["doc_slots"]
                    found |= {-1 - (int.from_bytes(hashlib.blake2b(a[i : i + 9], digest_size=8).digest()) >> 2) for i in range(0, len(a), 9) if a[i : i + 9] != b[i : i + 9]}
            marks.append(list(found))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in list(kinds)[:4]), pa.array(marks, kinds["marks"])], list(kinds))


def matches(docs: DataFrame, benchmark: DataFrame, most_kept: int = MOST_KEPT, share: float = SHARE) -> DataFrame:
    """doc_id, item_id, n_words, n_covered, n_changed (slots with another value) and share of each pair with windows in common."""
    items = C.materialise(
        benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(NO_ID)).alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(C.freed(_items), ITEM_SCHEMA).distinct(), "items"
    )
    found = items.select("size", (F.col("exact") > 0).alias("exact")).distinct().collect()  # 2 * WINDOW rows at most
    sizes, exact_sizes = (sorted(r["size"] for r in found if r["exact"] == exact) for exact in (False, True))
    codes = C.materialise(items.select("window").distinct(), "windows")
    kept = None
    if codes.count() <= most_kept:
        kept = np.sort(C.flat(codes.toArrow(), "window").to_numpy(zero_copy_only=False).view(np.uint64))
        if not len(kept):
            sizes = exact_sizes = []
    C.discard(codes)
    base = C.texts(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("tie", F.xxhash64("text"))
    found = base.mapInArrow(C.freed(_doc_windows(sizes, exact_sizes, kept)), DOC_SCHEMA)
    pair = ["doc_id", "tie", "item_id", "n_words"]
    shift = (F.col("doc_pos") - F.col("item_pos")).alias("shift")
    hits = found.join(items, "window").select(*pair, shift, F.struct("item_pos", "size", "doc_slots", "item_slots", "exact").alias("hit"))
    # the hits of one alignment: at most one for each window of the item
    aligned = hits.groupBy(*pair, "shift").agg(F.collect_set("hit").alias("hits")).mapInArrow(C.freed(_align), ALIGNED_SCHEMA)
    # marks are made different before they are counted, so that a document with many alignments costs no row of many
    marks = aligned.select(*pair, F.explode_outer("marks").alias("mark")).distinct()
    told = marks.groupBy(*pair).agg(
        F.count_if((F.col("mark") >= 0) & (F.col("mark") < WHOLE)).cast("int").alias("covered"), F.count_if(F.col("mark") < 0).cast("int").alias("changed"), F.count_if(F.col("mark") == WHOLE).alias("whole")
    )
    copy = (F.col("whole") > 0) & (F.col("covered") / F.col("n_words") < share)
    covered = F.when(copy, F.col("n_words")).otherwise(F.col("covered"))
    return told.select(
        F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "item_id", "n_words", covered.alias("n_covered"), F.when(copy, 0).otherwise(F.col("changed")).alias("n_changed"), (covered / F.col("n_words")).alias("share")
    )


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """The pairs in which a document holds an item."""
    return matches(docs, benchmark, share=share).where(F.col("share") >= share)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.finished(spark, lambda: leaks(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark")), "leaks")


def _words_sql(name: str, key: str, table: str) -> str:
    """Canonical words of a table: place, code, kind and value; a sign that stands alone passes on that a sentence begins."""
    edge, stop = r"""["'`.,;:!?()\[\]{}<>*#$%&|\-_~^/\\=+@]""".replace("'", "''"), "[.!?:;|]$"
    return f"""
{name}0 AS (SELECT k, unnest(w) AS raw, unnest(range(len(w))) AS i FROM (SELECT {key} AS k, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM {table})),
{name}1 AS (SELECT *, regexp_replace(regexp_replace(raw, '^{edge}+', ''), '{edge}+$', '') AS s, coalesce(regexp_matches(lag(raw) OVER (PARTITION BY k ORDER BY i), '{stop}'), true) AS b FROM {name}0),
{name}2 AS (SELECT *, count(*) FILTER (s <> '') OVER (PARTITION BY k ORDER BY i) - (s <> '')::BIGINT AS nth FROM {name}1),
{name}3 AS (SELECT k, nth AS i, max(s) AS s, bool_or(b) AS b FROM {name}2 GROUP BY k, nth HAVING max(s) <> ''),
{name}4 AS (SELECT *, regexp_full_match(s, '[0-9][0-9.,:/]*') AS num FROM {name}3),
{name}5 AS (SELECT k, i, lower(s) AS v, CASE WHEN num THEN 1 WHEN coalesce(lag(num) OVER (PARTITION BY k ORDER BY i), false) AND lower(s) IN ({", ".join(f"'{u}'" for u in UNITS)}) THEN 3
  WHEN NOT b AND regexp_matches(s, '^[A-ZÀ-ÖØ-Þ]') AND len(regexp_extract_all(s, '[A-ZÀ-ÖØ-Þ]')) = 1 AND octet_length(encode(s)) > 1 THEN 2 ELSE 0 END AS kind FROM {name}4),
{name} AS (SELECT k, i, kind, v, CASE kind WHEN 0 THEN v ELSE chr(1) || kind END AS code FROM {name}5)"""


def _windows_sql(name: str, words: str) -> str:
    ahead = " || ' ' || ".join(["code", *(f"CASE WHEN size > {j} THEN coalesce(lead(code, {j}) OVER o, chr(2)) ELSE '' END" for j in range(1, WINDOW))])
    literal = " + ".join(f"CASE WHEN size > {j} AND coalesce(lead(kind, {j}) OVER o, 1) = 0 THEN 1 ELSE 0 END" for j in range(WINDOW))
    return f"{name} AS (SELECT * FROM (SELECT k, i, size, {ahead} AS win, {literal} AS literals FROM {words}, sizes WINDOW o AS (PARTITION BY k, size ORDER BY i)) WHERE literals >= {LITERALS} AND NOT contains(win, chr(2)))"


def _copies_sql() -> str:
    """copied: documents that hold an item word for word; words without case and the signs around them, also those beyond ASCII."""
    wide = "".join(chr(c) for c in WIDE_SIGNS)
    edge = (r"""["'`.,;:!?()\[\]{}<>*#$%&|\-_~^/\\=+@""" + wide + "]").replace("'", "''")
    bare = lambda name, of: f"{name} AS (SELECT k, ' ' || string_agg(w, ' ' ORDER BY i) || ' ' AS t FROM (SELECT k, i, regexp_replace(regexp_replace(v, '^{edge}+', ''), '{edge}+$', '') AS w FROM {of}) WHERE w <> '' GROUP BY k)"
    return f"""{bare("dt", "d")}, {bare("bt", "b")},
copied AS (SELECT dt.k AS doc_id, bt.k AS item_id FROM dt JOIN bt ON contains(dt.t, bt.t))"""


OP8_SQL = f"""
WITH {_words_sql("d", "doc_id", "documents")}, {_words_sql("b", "item_id", "(SELECT DISTINCT item_id, text FROM benchmark)")},
bn AS (SELECT k, count(*) AS n FROM b GROUP BY k),
sizes AS (SELECT DISTINCT least(n, {WINDOW}) AS size FROM bn WHERE n >= {LITERALS}),
{_windows_sql("dw", "d")}, {_windows_sql("bw", "b")},
hit AS (SELECT DISTINCT dw.k AS doc_id, bw.k AS item_id, n, bw.i AS pos, dw.i - bw.i AS shift, bw.size FROM dw JOIN bw USING (size, win) JOIN bn ON bn.k = bw.k WHERE bw.size = least(n, {WINDOW})),
part AS (SELECT DISTINCT doc_id, item_id, n, shift, unnest(range(pos, pos + size)) AS p FROM hit),
slot AS (SELECT DISTINCT doc_id, item_id, shift, b.kind, b.v AS x, d.v AS z FROM part JOIN b ON b.k = item_id AND b.i = p JOIN d ON d.k = doc_id AND d.i = p + shift WHERE b.kind > 0),
bad AS (SELECT doc_id, item_id, shift FROM slot GROUP BY ALL HAVING count(*) > count(DISTINCT (kind, x)) OR count(*) > count(DISTINCT (kind, z))),
good AS (SELECT * FROM part ANTI JOIN bad USING (doc_id, item_id, shift)),
{_copies_sql()},
changed AS (SELECT doc_id, item_id, count(DISTINCT (kind, x)) AS n_changed FROM slot ANTI JOIN bad USING (doc_id, item_id, shift) WHERE x <> z GROUP BY ALL),
template AS (SELECT doc_id, item_id, n::INTEGER AS n_words, count(DISTINCT p)::INTEGER AS n_covered, coalesce(any_value(n_changed), 0)::INTEGER AS n_changed, count(DISTINCT p) / n::DOUBLE AS share
  FROM good LEFT JOIN changed USING (doc_id, item_id) GROUP BY doc_id, item_id, n HAVING count(DISTINCT p) / n::DOUBLE >= {SHARE})
SELECT * FROM template UNION ALL
SELECT doc_id, item_id, n::INTEGER, n::INTEGER, 0::INTEGER, 1::DOUBLE FROM copied JOIN bn ON k = item_id ANTI JOIN template USING (doc_id, item_id)"""
