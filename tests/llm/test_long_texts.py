"""Texts longer than what the kernels work on at once (common.SLICE_BYTES), among short ones, through every operator."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sigloom.llm import common as C
from sigloom.llm import decontamination, line_dedup, near_duplicates, quality_rules, sentencepieces, token_counts, token_store

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    text = "\n".join(" ".join(r.choice(words) for _ in range(12)) for _ in range(34_000))
    assert len(text) > C.SLICE_BYTES
    return [(1, "short text one"), (2, text), (3, text.replace(words[0], "changed")), (4, "short text two"), (5, None)]


def test_token_store(spark, rows):
    path = token_store.public("word_bpe_49k.json")
    out = C.work_dir(spark, "long")
    token_store.write_store(spark.createDataFrame(rows, SCHEMA), out, path)
    got = {r.doc_id: r.ids_crc32 for r in token_store.read_store(spark, out).collect()}
    for i, t in rows:
        ids = [*token_store.tokenizer(path).encode(t or "", add_special_tokens=False).ids, 2]
        assert got[i] == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_counts(spark, rows):
    path = token_counts.public("byte_bpe_50k.json")
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(spark.createDataFrame(rows, SCHEMA), path).collect()}
    assert got == {i: len(token_counts.tokenizer(path).encode(t or "", add_special_tokens=False).ids) for i, t in rows}


def test_jaccard_join(spark, rows):
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_duplicates.jaccard_join(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (1, 0), 2: (2, 1), 3: (2, 1), 4: (4, 0), 5: (5, 0)}


def test_line_dedup(spark, rows):
    got = {r.doc_id: r for r in line_dedup.line_runs(spark.createDataFrame(rows, SCHEMA)).collect()}
    first, second = rows[1][1].split("\n"), rows[2][1].split("\n")
    assert got[2].n_deleted == 0 and got[3].text.split("\n") == [b for a, b in zip(first, second) if a != b]


def test_sentencepieces(spark, rows):
    got = sentencepieces.digest(spark.createDataFrame(rows[1:3] + rows[:1], SCHEMA), sentencepieces.public("piece_bpe_32k.model")).collect()
    assert all(r.round_trip and all(r.ways_round_trip) for r in got) and {r.doc_id: r.text_crc32 for r in got} == {i: zlib.crc32(t.encode()) for i, t in rows[1:3] + rows[:1]}


def test_decontamination(spark, rows):
    line = rows[1][1].split("\n")[30_000]
    items = spark.createDataFrame([(7, line)], "item_id long, text string")
    found = {r.doc_id for r in decontamination.leaks(spark.createDataFrame(rows, SCHEMA), items).collect()}
    assert 2 in found and found <= {2, 3}


def test_quality_rules(rows):
    whole = quality_rules.measure(*C.buffers(pa.array([t or "" for _, t in rows])))
    for n, (_, t) in enumerate(rows):
        alone = quality_rules.measure(*C.buffers(pa.array([t or ""])))
        assert {k: v[n] for k, v in whole.items()} == {k: v[0] for k, v in alone.items()}
