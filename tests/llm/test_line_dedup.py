import random
import re

import pytest

from sigloom.llm import line_dedup as L

SCHEMA = "doc_id long, text string, tie string, name string"


def brute(rows):
    """doc_id, n_lines, n_deleted, n_runs, kept text; rows must differ."""
    order = sorted(range(len(rows)), key=lambda r: L.NO_ID if rows[r][0] is None else rows[r][0])
    seen1, seen2, out = set(), set(), []
    for r in order:
        lines = (rows[r][1] or "").split("\n")
        real = [j for j, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x)]
        gone = set()
        for p, j in enumerate(real):
            if lines[j] in seen1 and len(re.findall(r"[^\x20\x09-\x0D]+", lines[j])) >= 3:
                gone.add(p)
            seen1.add(lines[j])
            if p + 1 < len(real):
                pair = (lines[j], lines[real[p + 1]])
                if pair in seen2:
                    gone |= {p, p + 1}
                seen2.add(pair)
        dead = {real[p] for p in gone}
        out.append((-1 if rows[r][0] is None else rows[r][0], len(real), len(gone), sum(p - 1 not in gone for p in gone), "\n".join(x for j, x in enumerate(lines) if j not in dead)))
    return sorted(out)


def run(spark, rows):
    got = L.line_runs(spark.createDataFrame([(i, t, "t", None) for i, t in rows], SCHEMA)).collect()
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_deleted, r.n_runs, r.text) for r in got)


ROWS = [
    (1, "a b c\nd e f\ng h i\n\nj"), (2, "x y z\na b c\nshort\nj"), (3, "q\nd e f\ng h i"), (4, "g h i\n\n j\nj\nj\nj\nj"), (5, "one two\nthree\nfour"), (6, "one two\n\nthree\nx"),
    (7, None), (8, ""), (9, "\n\n \n"), (10, "a b c"), (11, "tail\na b c"), (12, "tail\na b c\n"), (None, "a b c\nnew one here"), (13, "new one here"), (14, "é é é\r\né é é"), (15, "é é é"),
    (16, "\n".join(f"w{i} x y" for i in range(3000))), (17, "\n".join(f"w{i} x y" for i in range(1500, 3500))), (18, "same line again\n" * 40), (19, "k " * 40000),
]


def test_brute_force(spark):
    assert run(spark, ROWS) == brute(ROWS)


def test_repeated_rows_are_one_document(spark):
    rows = [(1, "a b c\nd e f"), (1, "a b c\nd e f"), (2, "d e f"), (None, "d e f"), (None, "d e f")]
    assert run(spark, rows) == [(-1, 1, 1, 1, "")] * 2 + [(1, 2, 0, 0, "a b c\nd e f")] * 2 + [(2, 1, 1, 1, "")]


def test_longest_run(spark):
    rows = [(1, "\n".join("abcdefghijk")), (2, "\n".join("bcdefgxabc"))]
    got = L.line_runs(spark.createDataFrame([(i, t, None, None) for i, t in rows], SCHEMA)).collect()
    assert {r.doc_id: r.longest_run for r in got} == {1: 0, 2: 4}
    with pytest.raises(ValueError):
        L.line_runs(spark.createDataFrame([], SCHEMA), min_lines=3)


def lengths(rows):
    """doc_id -> the longest run of lines that also begins earlier, in the document or before it, by comparing all places."""
    docs = [(i, [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]) for i, t in sorted(rows)]
    flat = [(i, p, x) for i, lines in docs for p, x in enumerate(lines)]
    size = {i: len(lines) for i, lines in docs}
    at, out = {}, {i: 0 for i, _ in docs}
    index = {(i, p): n for n, (i, p, _) in enumerate(flat)}
    for n, (i, p, x) in enumerate(flat):
        for m in at.get(x, []):
            j, q, _ = flat[m]
            k = 0
            while p + k < size[i] and q + k < size[j] and flat[index[i, p + k]][2] == flat[index[j, q + k]][2]:
                k += 1
            out[i] = max(out[i], k)
        at.setdefault(x, []).append(n)
    return out


def test_true_lengths(spark):
    r = random.Random(6)
    rows = [(i, "\n".join(r.choice("abcdefgh") for _ in range(r.randrange(40)))) for i in range(60)]
    long = [f"line {i}" for i in range(200)]
    rows += [(100 + i, "\n".join(["own %d" % i, *long[a : a + n], "end %d" % i])) for i, (a, n) in enumerate([(0, 200), (3, 77), (50, 100), (149, 51), (0, 127), (0, 128), (60, 129), (10, 1), (10, 2), (10, 3)])]
    rows += [(200, "same\n" * 37), (201, "same\n" * 20), (202, None)]
    got = L.line_runs(spark.createDataFrame([(i, t, None, None) for i, t in rows], SCHEMA), lengths=True).collect()
    want = lengths(rows)
    assert {r.doc_id: r.longest_lines for r in got} == want
    assert all(r.longest_run == (1 << r.longest_lines.bit_length() >> 1) for r in got)


def test_empty_table(spark):
    assert run(spark, []) == []
