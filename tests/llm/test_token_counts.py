import random

import pytest

from sigloom.llm import token_counts as T

PATH = T.public("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, row string, n_bytes string"


def whole(text):
    return len(T.tokenizer(PATH).encode(text or "", add_special_tokens=False).ids)


def noisy(seed, n):
    r = random.Random(seed)
    parts = ["word", " the", "'re", "'ll", "'", "  ", "\n", "\n\n ", "\t", " 123", "45", "...", "!?", "é", "漢字", "👍🏽", "<|endoftext|>", "<|endof", "text|>", " <|", " ", "  ", "Ж", "a" * 40]
    return "".join(r.choice(parts) for _ in range(n))


def test_splices_equal_whole_texts(spark):
    texts = [None, "", "short", " ", "x" * 900, "x" * 3000, " " * 2500, "\n" * 1000 + "a", "ab " * 700, "<|endoftext|>" * 200, "1" * 1500 + " b" * 500, "'re" * 600] + [noisy(i, 60 + 90 * (i % 5)) for i in range(40)]
    docs = spark.createDataFrame([(i, t, "r", None) for i, t in enumerate(texts)] + [(0, "again " * 300, None, None), (None, "y " * 600, None, None)], SCHEMA)
    got = T.token_counts(docs, PATH, chunk=200, overlap=40).collect()
    assert len(got) == len(texts) + 2
    want = sorted([(i, len((t or "").encode()), whole(t)) for i, t in enumerate(texts)] + [(0, 1800, whole("again " * 300)), (-1, 1200, whole("y " * 600))])
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want


def test_empty_table(spark):
    assert T.token_counts(spark.createDataFrame([], SCHEMA), PATH).count() == 0


@pytest.mark.parametrize("chunk", [1000, T.CHUNK])
def test_documents(spark, chunk):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in T.token_counts(docs, PATH, chunk=chunk).collect()}
    assert got == {r.doc_id: whole(r.text) for r in docs.collect()}
