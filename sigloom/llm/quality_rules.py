"""Quality rules by repetition coverage: rolling hashes of several n-gram lengths, in NumPy.

For each length, the windows of words that occur earlier in the same text are found by their hashes, and the characters
(code points of words) under them are counted once; the same is done for lines. A text is rejected where one of these
shares is above its limit, where it has more than one symbol for ten words, or where it fails the base rules. Longer windows are looked for only where the shorter one
repeats, since a repeated window has repeated parts.

Defined cases: a null or blank text has no words and fails the base rules; ties and repeated rows are judged alike, each
on its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from sigloom.llm import common as C

#: Window lengths, and the largest share of word characters that later copies of such windows may cover.
NGRAM_LIMITS = {5: 0.20, 6: 0.20, 7: 0.20, 8: 0.20, 9: 0.20, 10: 0.20}
#: The largest share of word characters in lines that repeat an earlier line.
LINE_LIMIT = 0.20
#: The largest number of symbols for a word.
SYMBOL_LIMIT = 0.1
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "dup_line_chars long, " + ", ".join(f"dup_{n}gram_chars long" for n in NGRAM_LIMITS)
)


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it occurs more than once, and whether it occurs earlier."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    later, many = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    many[order[1:]] = same
    many[order[:-1]] |= same
    return many, later


def _covered(at: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n words lie under windows of k words that begin at `at`."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + k, -1)
    return np.cumsum(steps[:-1]) > 0


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """All counts of the contract and of the method, for each document of one buffer."""
    n_docs = len(offsets) - 1
    start, end, doc = C.words(data, offsets)
    n = len(start)
    prefix = C.prefix_hash(data)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = points[end] - points[start]
    per_doc = lambda weights: np.bincount(doc, weights, n_docs).astype(np.int64)
    is_symbol = np.zeros(256, bool)
    is_symbol[np.frombuffer(SYMBOLS, np.uint8)] = True
    symbols = np.concatenate([[0], np.cumsum(is_symbol[data])])
    out = {"n_words": np.bincount(doc, minlength=n_docs), "word_chars": per_doc(chars), "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]]}

    # lines; a document without text has one empty line, which has no word
    breaks = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    line_doc = np.concatenate([np.arange(n_docs), np.searchsorted(offsets, breaks, side="right") - 1])[np.argsort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")]
    # a line that begins where the next document does sorts after that document's own start: order by document instead
    order = np.lexsort((line_start, line_doc))
    line_start, line_doc = line_start[order], line_doc[order]
    line_end = np.append(line_start[1:] - 1, len(data))
    last = np.append(line_doc[1:] != line_doc[:-1], True) if len(line_doc) else np.zeros(0, bool)
    line_end[last] = offsets[line_doc[last] + 1]
    first_word = np.searchsorted(start, line_start)
    end_word = np.searchsorted(start, line_end)
    real = end_word > first_word
    key = C.mix(C.span_hash(prefix, line_start, line_end) + C.mix(line_doc.astype(np.uint64)))[real]
    _, again = _groups(key)
    sums = np.concatenate([[0], np.cumsum(chars)])
    line_chars = (sums[end_word] - sums[first_word])[real]
    out["n_dup_lines"] = np.bincount(line_doc[real][again], minlength=n_docs)
    out["dup_line_chars"] = np.bincount(line_doc[real][again], line_chars[again], n_docs).astype(np.int64)

    # windows of words; the hash of each longer window goes on from the shorter one
    codes = C.span_hash(prefix, start, end)
    salt = C.mix(doc.astype(np.uint64) + np.uint64(1))
    at = np.arange(max(0, n - 2))
    at = at[doc[at] == doc[at + 2]] if n > 2 else at[:0]
    rolled = C.mix(C.mix(C.mix(codes[at] + salt[at]) + codes[at + 1]) + codes[at + 2])
    many, _ = _groups(rolled)
    out["n_repeat_words"] = per_doc(_covered(at[many], 3, n))
    at, rolled, k = at[many], rolled[many], 3
    for size in NGRAM_LIMITS:
        while k < size:
            fits = at + k < n
            at, rolled = at[fits], rolled[fits]
            fits = doc[at + k] == doc[at]
            at, rolled = at[fits], rolled[fits]
            rolled = C.mix(rolled + codes[at + k])
            k += 1
        many, again = _groups(rolled)
        out[f"dup_{size}gram_chars"] = per_doc(chars * _covered(at[again], k, n))
        at, rolled = at[many], rolled[many]
    return {k: np.asarray(v, np.int64) for k, v in out.items()}


def verdict(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
    bad = m["dup_line_chars"] > LINE_LIMIT * m["word_chars"]
    for size, most in NGRAM_LIMITS.items():
        bad |= m[f"dup_{size}gram_chars"] > most * m["word_chars"]
    bad |= m["n_symbols"] > SYMBOL_LIMIT * m["n_words"]
    return failed, ~failed & ~bad


def _rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for batch in C.slices(batches):
        m = measure(*C.buffers(C.flat(batch, "text")))
        failed, kept = verdict(m)
        columns = {"doc_id": C.flat(batch, "doc_id"), "base_failed": failed, "kept": kept} | m
        yield pa.RecordBatch.from_arrays([pa.array(columns[k]) if isinstance(columns[k], np.ndarray) else columns[k] for k in names], names)


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row for each document with its counts and the verdict."""
    return C.texts(docs).mapInArrow(C.freed(_rules), SCHEMA)


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows that the rules keep, with all their columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pc.fill_null(batch.column(batch.schema.get_field_index("text")), "")
            marks = [verdict(measure(*C.buffers(C.flat(part, "text"))))[1] for part in C.slices(iter([pa.RecordBatch.from_arrays([text], ["text"])]))]
            yield batch.filter(pa.array(np.concatenate(marks) if marks else [], pa.bool_()))

    return docs.mapInArrow(C.freed(run), docs.schema)


def op10_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(C.table(spark, sf_dir, "documents"))


def _gram_sql(n: int) -> str:
    gram = " || ' ' || ".join(["word", *(f"lead(word, {j}) OVER d" for j in range(1, n))])
    return f"SELECT doc_id, i, {n} AS n, {gram} AS gram FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY i)"


OP10_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM t),
g AS ({" UNION ALL ".join(_gram_sql(n) for n in (3, *NGRAM_LIMITS))}),
c AS (SELECT doc_id, n, i, count(*) OVER (PARTITION BY doc_id, n, gram) AS many, row_number() OVER (PARTITION BY doc_id, n, gram ORDER BY i) AS nth FROM g WHERE gram IS NOT NULL),
hit AS (SELECT DISTINCT doc_id, n, unnest(range(i, i + n)) AS i FROM c WHERE many > 1 AND (n = 3 OR nth > 1)),
cov AS (SELECT h.doc_id, {", ".join(f"sum(CASE WHEN n = {n} THEN length(word) ELSE 0 END) AS c{n}" for n in NGRAM_LIMITS)}, count(CASE WHEN n = 3 THEN 1 END) AS n_repeat
  FROM hit h JOIN w USING (doc_id, i) GROUP BY h.doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS j FROM t),
r AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY j) AS nth FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
dl AS (SELECT doc_id, count(*) AS n_dup, sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g'))) AS chars FROM r WHERE nth > 1 GROUP BY doc_id),
m AS (SELECT t.doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words,
  coalesce(chars, 0)::BIGINT AS dup_line_chars, {", ".join(f"coalesce(c{n}, 0)::BIGINT AS dup_{n}gram_chars" for n in NGRAM_LIMITS)}
  FROM t LEFT JOIN cov USING (doc_id) LEFT JOIN dl USING (doc_id)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND dup_line_chars <= {LINE_LIMIT} * word_chars AND n_symbols <= {SYMBOL_LIMIT} * n_words
  AND {" AND ".join(f"dup_{n}gram_chars <= {v} * word_chars" for n, v in NGRAM_LIMITS.items())} AS kept
FROM b"""
