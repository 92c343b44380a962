"""Line deduplication by a suffix array over line ids.

The lines that hold a word, in the order of doc_id and place, are a long sequence of line ids with borders between the
documents. Prefix doubling sorts its suffixes: the rank of a suffix by its first 2 ** (k + 1) lines comes from the pair of
ranks by 2 ** k lines at its beginning and 2 ** k lines on. Suffixes with one rank at level k are an interval of the suffix
array whose longest common prefix has at least 2 ** k lines; intervals of one suffix are settled and go no further, so
only what repeats is carried on, until nothing does. The first suffix of each interval keeps its lines; every other one is
a later copy, and its lines go if the run has MIN_LINES lines (a power of two), or is a line of MIN_WORDS words. What goes
from a document in a row is one run. Where true lengths are asked for, the longest common prefix of a document's suffixes
with earlier ones is then found exactly, from the ranks of the level below it; what is deleted does not depend on it.

Ranks are dealt out over the different pairs, which are counted before they move, so a line that a third of all documents
have is one row there; the way back is an equi-join, whose hot keys Spark splits.

Defined cases: null and blank texts have no lines and stay as they are (null becomes empty); rows with one doc_id and one
text are one document, and all get its result; rows without an id come last; other columns are left behind by line_runs
and kept by dedup_lines; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sigloom.llm import common as C

MIN_LINES, MIN_WORDS = 2, 3
NO_ID = (1 << 63) - 1

LINE_SCHEMA = "doc_id long, tie long, pos int, name long, n_words int"


def real_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, document and number of words of each line that has one."""
    breaks = np.flatnonzero(data == 10)
    n = len(offsets) - 1
    start = np.concatenate([offsets[:-1], breaks + 1])
    doc = np.concatenate([np.arange(n), np.searchsorted(offsets, breaks, side="right") - 1])
    order = np.lexsort((start, doc))
    start, doc = start[order], doc[order]
    end = np.append(start[1:] - 1, len(data))
    last = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.zeros(0, bool)
    end[last] = offsets[doc[last] + 1]
    begins, _, _ = C.words(data, offsets)
    count = np.searchsorted(begins, end) - np.searchsorted(begins, start)
    real = count > 0
    return start[real], end[real], doc[real], count[real]


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in C.slices(batches):
        data, offsets = C.buffers(C.flat(batch, "text"))
        start, end, doc, count = real_lines(data, offsets)
        name = C.span_hash(C.prefix_hash(data), start, end).view(np.int64)
        pos = np.arange(len(doc)) - np.searchsorted(doc, doc)
        ids, tie = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("tie").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(ids[doc]), pa.array(tie[doc]), pa.array(pos.astype(np.int32)), pa.array(name), pa.array(count.astype(np.int32))], ["doc_id", "tie", "pos", "name", "n_words"])


def _intervals(suffixes: DataFrame, *by: str) -> DataFrame:
    """Intervals of two suffixes or more: their rank, in the order of `by`, and the first suffix in the text."""
    found = suffixes.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "tie", "pos")).alias("first")).where("n > 1").drop("n")
    # ids that grow from range to range and within each: ranks in order, without a count over all
    ordered = found.repartitionByRange(int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by)
    return C.materialise(ordered.withColumn("rank", F.monotonically_increasing_id()), "intervals")


def suffix_intervals(docs: DataFrame) -> DataFrame:
    """level, doc_id, tie, pos, n_words, rank, later: each suffix in an interval of two or more, at each level; later: not its first."""
    here = F.struct("doc_id", "tie", "pos")
    lines = C.materialise(docs.mapInArrow(C.freed(_lines), LINE_SCHEMA).dropDuplicates(["doc_id", "tie", "pos"]), "lines")
    ranks = _intervals(lines, "name")
    active = C.materialise(lines.join(ranks, "name").select("doc_id", "tie", "pos", "n_words", "rank", (here != F.col("first")).alias("later")), "suffixes")
    level, out = 0, None
    while True:
        rows = active.select(F.lit(level).alias("level"), "doc_id", "tie", "pos", "n_words", "rank", "later")
        out = rows if out is None else out.unionByName(rows)
        on = active.select("doc_id", "tie", (F.col("pos") - (1 << level)).alias("pos"), F.col("rank").alias("next"))
        pairs = C.materialise(active.select("doc_id", "tie", "pos", "n_words", "rank").join(on, ["doc_id", "tie", "pos"]), "pairs")
        if pairs.isEmpty():
            return out
        ranks = _named(pairs)
        active = C.materialise(pairs.join(ranks, ["rank", "next"]).select("doc_id", "tie", "pos", "n_words", F.col("new").alias("rank"), (here != F.col("first")).alias("later")), "suffixes")
        C.discard(pairs)
        level += 1
        if active.isEmpty():
            return out


DOC, PLACE = ["doc_id", "tie"], ["level", "doc_id", "tie", "pos"]


def longest_prefixes(suffixes: DataFrame) -> DataFrame:
    """doc_id, tie, longest_lines: the longest common prefix of any suffix of a document with an earlier one, in lines.

    A prefix of m lines, 2 ** k <= m < 2 ** (k + 1), is told by two ranks of level k: at its beginning, and so far on that
    both cover it. A document's length is found by halving between powers of two; each time, the suffixes of the intervals
    that are asked for get the second rank, and the first suffix with both is found by an aggregate.
    """
    here = F.struct("doc_id", "tie", "pos")
    done = suffixes.where("later").groupBy(*DOC).agg(F.max("level").alias("level")).where("level = 0").select(*DOC, F.lit(1).cast("long").alias("longest_lines"))
    # only runs of two lines or more are halved: one table of them, for short plans
    suffixes = C.materialise(suffixes.where("level > 0").select(*PLACE, "rank", "later"), "runs")
    later = suffixes.where("later")
    top = later.groupBy(*DOC).agg(F.max("level").alias("level"))
    two = lambda c: F.expr(f"shiftleft(1, {c})")
    open_ = later.join(top, [*DOC, "level"]).select(*PLACE, "rank", two("level").alias("low"), (2 * two("level")).alias("high"))
    open_ = C.materialise(open_, "prefixes")
    while not open_.isEmpty():
        off = (F.floor((F.col("low") + F.col("high")) / 2) - two("level")).cast("int")
        asked = open_.withColumn("off", off)
        second = suffixes.select(*PLACE, F.col("rank").alias("then"))
        at = lambda df, second=second: df.join(second.withColumnRenamed("pos", "next"), ["level", *DOC, "next"])
        held = suffixes.select(*PLACE, "rank").join(asked.select("level", "rank", "off").distinct(), ["level", "rank"])
        firsts = at(held.withColumn("next", F.col("pos") + F.col("off"))).groupBy("level", "rank", "off", "then").agg(F.min(here).alias("first"))
        found = at(asked.withColumn("next", F.col("pos") + F.col("off"))).join(firsts, ["level", "rank", "off", "then"]).where(here != F.col("first"))
        told = asked.join(found.select(*PLACE, F.lit(True).alias("longer")), PLACE, "left").withColumn("longer", F.coalesce("longer", F.lit(False)))
        # a document goes on with the suffixes that are longer, if there are any
        told = told.withColumns({"any": F.max("longer").over(W.partitionBy(*DOC)), "middle": two("level") + F.col("off")}).where("longer or not any")
        after = C.materialise(told.select(*PLACE, "rank", F.when(F.col("any"), F.col("middle")).otherwise(F.col("low")).alias("low"), F.when(F.col("any"), F.col("high")).otherwise(F.col("middle")).alias("high")), "prefixes")
        done = done.unionByName(after.where("high - low <= 1").groupBy(*DOC).agg(F.max("low").cast("long").alias("longest_lines")))
        open_ = after.where("high - low > 1")
    return done


def _named(pairs: DataFrame) -> DataFrame:
    made = _intervals(pairs.select("doc_id", "tie", "pos", F.col("rank").alias("left"), F.col("next").alias("right")), "left", "right")
    return made.select(F.col("left").alias("rank"), F.col("right").alias("next"), "first", F.col("rank").alias("new"))


OUT_SCHEMA = "doc_id long, tie long, n_lines long, n_deleted long, n_runs long, longest_run long, longest_lines long, text string"


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in C.slices(batches):
        texts = C.flat(batch, "text")
        data, offsets = C.buffers(texts)
        start, end, doc, _ = real_lines(data, offsets)
        n_lines = np.bincount(doc, minlength=batch.num_rows)
        first = np.concatenate([[0], np.cumsum(n_lines)])
        raw, out, deleted, runs = data.tobytes(), [], [], []
        for row, (gone, a, b) in enumerate(zip(batch.column("gone").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist())):
            gone = np.unique(np.array(gone or [], np.int64))
            deleted.append(len(gone))
            runs.append(int((np.diff(gone) > 1).sum()) + 1 if len(gone) else 0)
            if not len(gone):
                out.append(raw[a:b].decode())
                continue
            parts, at = [], a
            for i in gone + first[row]:
                s, e = int(start[i]), int(end[i])
                parts.append(raw[at:s])
                at = e + 1  # with the break that ends the line
            parts.append(raw[at:b])
            text = b"".join(parts).decode()
            if at == b + 1 and text.endswith("\n"):
                text = text[:-1]  # the last line went, and with it the break before it
            out.append(text)
        ids = batch.column("doc_id")
        values = [ids, batch.column("tie"), pa.array(n_lines, pa.int64()), pa.array(deleted, pa.int64()), pa.array(runs, pa.int64()), batch.column("longest"), batch.column("longest_lines"), pa.array(out, pa.string())]
        names = ["doc_id", "tie", "n_lines", "n_deleted", "n_runs", "longest_run", "longest_lines", "text"]
        if "row" in batch.schema.names:  # columns that are carried along
            values, names = [*values, batch.column("row")], [*names, "row"]
        yield pa.RecordBatch.from_arrays(values, names)


def _runs(base: DataFrame, min_lines: int, min_words: int, lengths: bool) -> DataFrame:
    """OUT_SCHEMA, and the column `row` if base has one, for base's rows of doc_id, tie and text; lengths: find longest_lines, else null."""
    level = min_lines.bit_length() - 1
    if 1 << level != min_lines:
        raise ValueError("min_lines must be a power of two")
    suffixes = suffix_intervals(base.select("doc_id", "tie", "text"))
    later = suffixes.where("later")
    gone = later.where((F.col("level") == level) | (F.col("level") == 0) & (F.col("n_words") >= min_words)).select(
        "doc_id", "tie", F.explode(F.sequence("pos", F.col("pos") + F.when(F.col("level") == 0, 0).otherwise(min_lines - 1).cast("int"))).alias("pos")
    )
    # at most one row for each line of a document
    by_doc = gone.groupBy("doc_id", "tie").agg(F.collect_set("pos").alias("gone"))
    longest = later.groupBy("doc_id", "tie").agg(F.pow(F.lit(2), F.max("level")).cast("long").alias("longest"))
    found = longest.join(by_doc, ["doc_id", "tie"], "left")
    none = F.lit(None).cast("long")
    found = found.join(longest_prefixes(suffixes), ["doc_id", "tie"], "left") if lengths else found.withColumn("longest_lines", none)
    joined = base.join(found.hint("merge"), ["doc_id", "tie"], "left").withColumn("longest", F.coalesce("longest", F.lit(0).cast("long")))
    joined = joined.withColumn("longest_lines", F.coalesce("longest_lines", F.lit(0).cast("long") if lengths else none))
    kind = OUT_SCHEMA
    if "row" in base.columns:
        kind += f", row {base.schema['row'].dataType.simpleString()}"
    return joined.mapInArrow(C.freed(_rebuild), kind).withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("tie", F.xxhash64("text"))


def line_runs(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, lengths: bool = False) -> DataFrame:
    """doc_id, tie, n_lines, n_deleted, n_runs, longest_run (lines of the longest later copy, as a power of two), longest_lines (their true number, where `lengths` are asked for) and the text that is left."""
    return _runs(_keyed(C.texts(docs)), min_lines, min_words, lengths)


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of docs, with what is left of each text; documents of which no line is left, though they had some, are gone.

    A column n_chars is counted anew where the text has changed.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    runs = _runs(_keyed(C.texts(docs, row)), min_lines, min_words, False).where("n_lines = 0 or n_deleted < n_lines")
    text = F.when(F.col("n_deleted") > 0, F.col("text")).otherwise(F.col("row.text"))
    counted = F.when(F.col("n_deleted") > 0, F.length("text")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None
    new = {"text": text, "n_chars": counted}
    return runs.select(*[(new[c].cast(docs.schema[c].dataType) if new.get(c) is not None else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_lines", "n_deleted", "n_runs", "longest_run", F.md5("text").alias("kept_md5")]
    return C.finished(spark, lambda: line_runs(C.table(spark, sf_dir, "documents")).select(*columns), "line-runs")


#: Rows (doc_id, j, gone) for each line, for a table `{docs}`; runs are built from later copies of one line and of MIN_LINES lines.
LINES_SQL = f"""
ln AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS j FROM {{docs}}),
rl AS (SELECT doc_id, j, line, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS nw, row_number() OVER (PARTITION BY doc_id ORDER BY j) - 1 AS pos
  FROM ln WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
g1 AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS nth FROM rl),
g2 AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY gram ORDER BY doc_id, pos) AS nth
  FROM (SELECT doc_id, pos, line || chr(10) || lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS gram FROM rl) WHERE gram IS NOT NULL),
dead AS (SELECT doc_id, pos FROM g1 WHERE nth > 1 AND nw >= {MIN_WORDS} UNION SELECT doc_id, pos FROM g2 WHERE nth > 1 UNION SELECT doc_id, pos + 1 FROM g2 WHERE nth > 1),
kept AS (SELECT ln.doc_id, ln.j, ln.line, rl.pos, d.pos IS NOT NULL AS gone
  FROM ln LEFT JOIN rl ON ln.doc_id = rl.doc_id AND ln.j = rl.j LEFT JOIN dead d ON d.doc_id = rl.doc_id AND d.pos = rl.pos)"""

OP7_SQL = f"""
WITH {LINES_SQL.format(docs="documents")},
ids AS (SELECT doc_id, list(line ORDER BY pos) AS names FROM rl GROUP BY doc_id),
grams AS (SELECT doc_id, k, i, names[i + 1 : i + (1 << k)] AS gram FROM (SELECT doc_id, names, k, unnest(range(len(names) - (1 << k) + 1)) AS i FROM ids, range(0, 13) t(k))),
longest AS (SELECT doc_id, max(1 << k) AS longest_run FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY k, gram ORDER BY doc_id, i) AS nth FROM grams) WHERE nth > 1 GROUP BY doc_id),
marks AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS opens FROM kept WHERE pos IS NOT NULL),
s AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_deleted, count(*) FILTER (opens) AS n_runs FROM marks GROUP BY doc_id)
SELECT k.doc_id, coalesce(max(s.n_lines), 0) AS n_lines, coalesce(max(s.n_deleted), 0) AS n_deleted, coalesce(max(s.n_runs), 0) AS n_runs, coalesce(max(longest.longest_run), 0)::BIGINT AS longest_run,
  md5(coalesce(string_agg(line, chr(10) ORDER BY j) FILTER (NOT gone), '')) AS kept_md5
FROM kept k LEFT JOIN s USING (doc_id) LEFT JOIN longest USING (doc_id) GROUP BY k.doc_id"""
