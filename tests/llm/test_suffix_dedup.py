import hashlib
import random

import numpy as np
import pytest

from sigloom.llm import suffix_dedup as S

SCHEMA = "doc_id long, text string, blob string, chunk string"


def brute(rows, length=50):
    first = {}
    for i, t in rows:
        raw = (t or "").encode()
        i = S.NO_ID if i is None else i
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            first[s] = min(i, first.get(s, i))
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for p in range(len(raw) - length + 1):
            if first[raw[p : p + length]] < (S.NO_ID if i is None else i):
                gone[p : p + length] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(raw) else 0
        out.append((-1 if i is None else i, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, t, "b", None) for i, t in rows], SCHEMA)
    got = S.suffix_dedup(df.repartition(3) if len(rows) > 3 else df).collect()
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), r.kept_sha256) for r in got)


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert run(spark, rows) == brute(rows)


def test_planted(spark):
    r = random.Random(3)
    text = lambda n, a="abcdeé ": "".join(r.choice(a) for _ in range(n))
    shared = [text(n) for n in (20, 40, 49, 50, 51, 60, 120, 700)]
    rows = [(i, "".join(x for _ in range(4) for x in (text(r.randrange(40)), r.choice(shared)))) for i in range(90)]
    rows += [(200 + i, "x" * n) for i, n in enumerate((10, 49, 50, 51, 300))] + [(210 + i, "ab" * n) for i, n in enumerate((24, 25, 26, 90))]
    rows += [(300, None), (301, ""), (3, shared[7]), (3, shared[7]), (None, shared[7]), (None, shared[6]), (None, None), (-5, shared[7])]
    rows += [(400 + i, text(60, "ab")) for i in range(40)] + [(500 + i, rows[7][1]) for i in range(20)]
    assert run(spark, rows) == brute(rows)


def test_many_ranges_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(S, "RANGE_STRINGS", 1 << 14)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert run(spark, rows) == brute(rows)


def contexts(r, n):
    """Texts of n contexts of 6 to 9 bytes over two letters, with ids; strings have 5 bytes."""
    size = r.integers(6, 10, n)
    return r.integers(97, 99, int(size.sum())).astype(np.uint8), np.cumsum(size) - size, size, r.integers(0, 40, n)


@pytest.mark.parametrize("batch", [1, 7, 100, 10**6])
def test_family(batch):
    text, start, size, ids = contexts(np.random.default_rng(1), 600)
    where = [(text[s + j : s + j + 5].tobytes(), i) for s, n, i in zip(start, size, ids) for j in range(n - 4)]
    least = {}
    for x, i in where:
        least[x] = min(i, least.get(x, i))
    count, code = size - 4, S.hashes(text, start, size)
    place = np.cumsum(count) - count
    got, family, seen = np.zeros(len(where), bool), S.Family(), []
    for rows in S.batches_of(ids, count, batch):
        found = S.earlier(family, text, start[rows], size[rows], code[rows], ids[rows], 5)
        got[np.concatenate([place[r] + np.arange(count[r]) for r in rows])] = found
        seen += [ids[rows].min(), ids[rows].max()]
    assert got.tolist() == [least[x] < i for x, i in where] and seen == sorted(seen)
    kept = [k for level in family.levels for k in level.keys().tolist()]
    assert sorted(kept) == sorted(least) and all(level.keys().tolist() == sorted(level.keys().tolist()) for level in family.levels)


def test_levels_are_geometric():
    family = S.Family()
    numbers = np.random.default_rng(0).permutation(6400).reshape(64, 100)
    text = lambda x: np.frombuffer(b"".join(b"%08d" % i for i in x), np.uint8)
    for batch in numbers:
        family.add(S.Level(text(np.sort(batch)), np.arange(100) * 8, 8))
        assert len(family.levels) <= 8
    assert family.seen(S.strings(text(range(7000)), np.arange(7000) * 8, 8)).sum() == 6400


def test_prefixes():
    keys = np.array([b"abcd", b"abce", b"abce", b"b\0\0a", b"b\0\0\0"], "S4")
    assert S.prefixes(keys).tolist() == [0, 3, 4, 0, 3]


def test_equal_hashes_of_other_bytes_stay_apart():
    data = np.frombuffer(b"abcabcabdxyzxyz", np.uint8)
    new = np.array([True, False, False, True, False])
    S.apart(data, np.arange(5) * 3, np.full(5, 3), new)
    assert new.tolist() == [True, True, True, True, False]


def test_hot_anchors_have_ranges_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT_CHUNKS", 2)
    monkeypatch.setattr(S, "CHUNK_BYTES", 1 << 12)
    r = random.Random(5)
    text = lambda n: "".join(r.choice("abcdef ") for _ in range(n))
    short, long = text(30), text(90)
    rows = [(i, text(r.randrange(60)) + (short if i % 3 else long) + text(r.randrange(60))) for i in range(300)]
    assert run(spark, rows) == brute(rows)


def test_nothing_is_left(spark):
    rows = [(i, "some text that is the same in each of the documents and long enough " * 2) for i in range(9)]
    assert run(spark, rows) == brute(rows)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("sigloom_chunks")]


def test_stored_levels(spark, tmp_path):
    """Batches scanned one after the other against what is stored, by an index opened anew each time, give what one run over all gives."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = sorted(rows) + [(10**6 + i, rows[i][1]) for i in range(3)]
    got, sizes = [], []
    for a, b in ((0, 90), (90, 150), (150, 151), (151, len(rows))):
        index = S.SuffixIndex(spark, f"file://{tmp_path}/index", bits=2)
        sizes.append(len(index.levels))
        found = index.add(spark.createDataFrame(rows[a:b], "doc_id long, text string"))
        got += [(r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), r.kept_sha256) for r in found.collect()]
    assert sorted(got) == brute(rows)
    assert sizes[0] == 0 and max(sizes) <= 3 and len(S.SuffixIndex(spark, f"file://{tmp_path}/index").levels) <= 3


def test_very_long_text(spark):
    """A text above what is worked on at once."""
    r = random.Random(2)
    block = "".join(r.choice("abcdefgh ") for _ in range(60_000))
    rows = [(1, "".join(r.choice("abcdefgh ") for _ in range(2_500_000)) + block), (2, "z" + block + "y")]
    got = run(spark, rows)
    assert [(x[0], x[2], x[3]) for x in got] == [(1, 0, 0), (2, 60_000, 1)]


def test_empty_table(spark):
    assert run(spark, []) == []
