import math
import struct
import zlib

import numpy as np
import pytest
import xxhash
import zstandard

from sigloom.llm import compression_classifier as K

DOCS, LABELS = "doc_id long, text string, score string, quality int", "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = K.op4_compression_classifier(spark, d).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [(labels[r.doc_id], r.score) for r in got if r.held_out and r.doc_id in labels]
    good, bad = [s for q, s in held if q], [s for q, s in held if not q]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([(s >= 0.3) == bool(q) for q, s in held]) > 0.93
    assert abs(np.mean([s for _, s in held]) - len(good) / len(held)) < 0.05  # calibrated


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, None, 0)], [(i, i % 2, 0) for i in range(40)]])
def test_odd_tables(spark, labels):
    docs = spark.createDataFrame([(None, "x", "a", 1), (1, None, None, None), (1, None, None, None), (2, "", "b", 0), (3, "é" * 70000, None, None), (4, "w " * 9, None, 1)], DOCS)
    marks = spark.createDataFrame(labels, LABELS)
    got = K.score(docs, K.fit(docs, marks)).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert K.score(docs.limit(0), None).count() == 0


def test_held_out_labels_are_not_learned(spark):
    docs = spark.createDataFrame([(i, ("good words " if i % 2 else "B@D!! ") * (i % 9 + 3), None, None) for i in range(200)], DOCS)
    rows = [(i, i % 2, 0) for i in range(200)]
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in rows]
    a, b = (K.fit(docs, spark.createDataFrame(x, LABELS)) for x in (rows, flipped))
    assert a == b


def brute(docs, labels):
    """doc_id -> score, by plain loops over rows of (doc_id, text) and (doc_id, quality)."""
    signed = lambda n: n - (1 << 64) if n >> 63 else n
    of_id = lambda i: signed(xxhash.xxh64(struct.pack("<q", i), seed=42).intdigest())
    of_text = lambda t: signed(xxhash.xxh64(t.encode(), seed=42).intdigest())
    learned = [(i, q) for i, q in labels if q in (0, 1) and zlib.crc32(str(i).encode()) % 5]
    sample = {}
    for q in (0, 1):
        ids = {i for i, _ in sorted({x for x in learned if x[1] == q}, key=lambda x: (of_id(x[0]), x[0]))[: K.MOST_ROWS]}
        rows = sorted({(of_id(i), i, of_text(t), t) for i, t in docs if i in ids})[: K.MOST_ROWS]
        size, kept = 0, []
        for _, _, _, t in rows:
            if size >= K.MOST_BYTES:
                break
            kept.append(t.encode())
            size += len(kept[-1])
        sample[q] = kept
    blocks = lambda raw: [raw[a : a + K.BLOCK] for a in range(0, len(raw), K.BLOCK)]
    packers, check = {}, []
    for q, texts in sample.items():
        learn = [b for n, t in enumerate(texts) if n % 4 for b in blocks(t) if len(b) >= 8]
        dictionary = zstandard.ZstdCompressionDict(zstandard.train_dictionary(K.DICT_BYTES, learn).as_bytes())
        packers[q] = zstandard.ZstdCompressor(level=K.LEVEL, dict_data=dictionary, write_checksum=False, write_content_size=False, write_dict_id=False)
        check += [(t, q) for n, t in enumerate(texts) if n % 4 == 0]
    gain = lambda raw: sum(len(packers[0].compress(b)) - len(packers[1].compress(b)) for b in blocks(raw)) / max(1, len(raw))
    share = {q: sum(x[1] == q for x in learned) / len(learned) for q in (0, 1)}
    rows = [(gain(t), q, share[q] * len(check) / sum(y == q for _, y in check)) for t, q in check]
    spread = float(np.std([x for x, _, _ in rows]))
    a = b = 0.0
    for _ in range(200):  # Newton's steps on slope and intercept, row by row
        ga, gb, haa, hab, hbb = 0.01 * a, 0.0, 0.01, 0.0, 1e-9
        for x, y, w in rows:
            z = x / spread
            p = 1 / (1 + math.exp(-max(-30, min(30, a * z + b))))
            ga, gb = ga + w * (p - y) * z, gb + w * (p - y)
            k = w * max(p * (1 - p), 1e-9)
            haa, hab, hbb = haa + k * z * z, hab + k * z, hbb + k
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - max(-2, min(2, da)), b - max(-2, min(2, db))
    return {i: 1 / (1 + math.exp(-max(-30, min(30, a / spread * gain(t.encode()) + b)))) for i, t in docs}


@pytest.mark.parametrize("bounds", [(2000, 4_000_000), (60, 40_000)])
def test_query_against_brute_force(spark, monkeypatch, bounds):
    monkeypatch.setattr(K, "MOST_ROWS", bounds[0])
    monkeypatch.setattr(K, "MOST_BYTES", bounds[1])
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    want = brute([(r.doc_id, r.text or "") for r in docs.collect()], [(r.doc_id, r.quality) for r in labels.collect()])
    got = {r.doc_id: r.score for r in K.score(docs, K.fit(docs, labels, *bounds)).collect()}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-9
    if bounds[0] == 2000:
        assert {r.doc_id: r.score for r in K.op4_compression_classifier(spark, d).collect()} == got


def test_hot_labelled_id(spark):
    """One labelled id with very many equal rows and some texts: the sample keeps its bound."""
    rows = [(1, "hot good words here")] * 3000 + [(1, f"text {i} " * 20) for i in range(50)] + [(i, f"B@D {i} !! " * 9) for i in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(1, 1, 0), (1, 1, 0), *((i, 0, 0) for i in range(2, 60))], LABELS)
    got = K.score(docs, K.fit(docs, marks, 20, 2000))
    assert got.count() == len(rows) and got.where("score < 0 or score > 1").count() == 0
