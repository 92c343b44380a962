"""A training corpus from raw documents, in five stages: each is written, and the next works on all that was kept.

1. quality rules: documents that they reject go;
2. line deduplication: later copies of lines go, and documents of which nothing is left;
3. n-gram Jaccard join: of each class of near copies the smallest doc_id stays; rows without an id stay;
4. benchmark decontamination: documents that hold an item of the benchmark go;
5. SentencePiece encoding and decoding: one row for each document that is left, with its pieces' checksums.

Rows that repeat a doc_id stay or go together in stages 3 and 4.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sigloom.llm import common, decontamination, line_dedup, near_duplicates, quality_rules, sentencepieces


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.kept_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    classes = near_duplicates.jaccard_join(docs)
    copies = classes.where("doc_id <> class_id").select("doc_id").distinct()
    # the documents move once, whatever the number of copies
    return docs.join(copies.hint("merge"), "doc_id", "left_anti").select(docs.columns)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontamination.leaks(docs, common.table(spark, sf_dir, "benchmark"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepieces.digest(docs, sentencepieces.public("piece_bpe_32k.model"))


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("jaccard_join", near_copies), ("decontamination", leaks), ("sentencepieces", encode)]

#: Sketches, shingles and pieces have no SQL; tests/llm/test_pipeline.py has a brute-force version of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, common.finished(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
        common.discard(before)  # the next stage's files stand for it
    return docs
