import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sigloom.llm import graph
from sigloom.llm import near_duplicates as N

SCHEMA = "doc_id long, text string, set string, g string"


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if 0 < len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows):
    """(doc_id, class_id, n_links) of each row, from all pairs that share a shingle."""
    sets = [shingle_set(t) if i is not None else frozenset() for i, t in rows]
    where = defaultdict(list)
    for r, s in enumerate(sets):
        for x in s:
            where[x].append(r)
    root = list(range(len(rows)))

    def find(r):
        while root[r] != r:
            root[r] = root[root[r]]
            r = root[r]
        return r

    links = Counter()
    for r, s in enumerate(sets):
        shared = Counter(o for x in s for o in where[x] if o > r)
        for o, n in shared.items():
            if 5 * n >= 4 * (len(s) + len(sets[o]) - n):
                links[r] += 1
                links[o] += 1
                root[find(r)] = find(o)
    least = {}
    for r, (i, _) in enumerate(rows):
        if i is not None:
            least[find(r)] = min(i, least.get(find(r), i))
    return sorted(((-1, -1, 0) if i is None else (i, least[find(r)], links[r])) for r, (i, _) in enumerate(rows))


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "s", None) for i, t in rows], SCHEMA)
    return sorted((-1, -1, r.n_links) if r.doc_id is None else (r.doc_id, r.class_id, r.n_links) for r in N.jaccard_join(df).collect())


def test_runs_reach_the_recall():
    assert N.runs_for(0.9999) == 4 and N.runs_for(0.9) == 1
    assert N.expected_recall(4) >= 0.9999 > N.expected_recall(3)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()]
    assert run(spark, rows) == brute(rows)


def test_groups_chains_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(N, "GROUP_BLOCK", 16)
    monkeypatch.setattr(N, "NODE_BLOCK", 32)
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(300)]
    rows = []
    for _ in range(120):  # a large group of near copies
        w = list(base)
        for _ in range(r.randrange(4)):
            w[r.randrange(300)] = word()
        rows.append(" ".join(w))
    chain = [word() for _ in range(400)]
    rows += [" ".join(chain[9 * i : 9 * i + 150]) for i in range(28)]  # links between neighbours only
    passage = [word() for _ in range(60)]
    rows += [" ".join([word() for _ in range(150)] + passage + [word() for _ in range(50)]) for _ in range(150)]
    rows += ["one two"] * 5 + ["one  two\n", "two one", "x", "x", "", " ", None] + ["a b c d e"] * 9 + ["w " * 30, "w " * 31]
    rows = list(enumerate(rows))
    rows += [(3, rows[3][1]), (3, rows[3][1]), (None, rows[3][1]), (None, None), (5, "one two")]
    assert run(spark, rows) == brute(rows)


def family(r, base, n, most):
    """n texts, each the base with some words changed."""
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randrange(most + 1)):
            w[r.randrange(len(w))] = word()
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [16, 40])
def test_large_groups(spark, monkeypatch, block):
    """Families around one text, around versions of it at several distances, and with texts at the threshold's border."""
    monkeypatch.setattr(N, "GROUP_BLOCK", block)
    monkeypatch.setattr(N, "NODE_BLOCK", 64)
    r = random.Random(block)
    base = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(260)]
    version = lambda n: [f"v{n}x{i}" if i % 26 < n // 10 else w for i, w in enumerate(base)]
    rows = family(r, base, 150, 3) + family(r, base, 60, 14)
    rows += family(r, version(10), 70, 2) + family(r, version(20), 60, 2) + family(r, [*base[:200], *(f"t{i}" for i in range(50))], 50, 4)
    rows += [" ".join(base[:k]) for k in range(200, 260, 2)] + [" ".join(base)] * 5
    r.shuffle(rows)
    assert run(spark, list(enumerate(rows))) == brute(list(enumerate(rows)))


def test_rows_of_a_large_group_do_not_grow_with_its_pairs(spark, monkeypatch):
    """Near copies of one text: each set's tokens move a few times, whatever the number of blocks."""
    monkeypatch.setattr(N, "GROUP_BLOCK", 8)
    dealt = []
    whole, mixed = N.in_block_pairs, N.across
    monkeypatch.setattr(N, "in_block_pairs", lambda df, *a: dealt.append(x := whole(df, *a)) or x)
    monkeypatch.setattr(N, "across", lambda *a: dealt.append(x := mixed(*a)) or x)
    r = random.Random(9)
    base = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    rows = list(enumerate(family(r, base, 300, 2)))
    assert run(spark, rows) == brute(rows)
    assert sum(x.count() for x in dealt) < 300


def test_pairs_just_above_the_threshold(spark):
    """Pairs of 0.80 to 0.82 are found, each with its one link."""
    r = random.Random(4)
    rows = []
    for i in range(400):
        words = [f"p{i}w{j}q{r.randrange(9)}" for j in range(104)]  # 100 shingles; k new words at the end take k of them
        k = r.choice([10, 11])  # 90 / 110 = 0.818, 89 / 111 = 0.8018
        rows += [" ".join(words), " ".join(words[:-k] + [f"n{i}x{j}" for j in range(k)])]
    got = run(spark, list(enumerate(rows)))
    assert got == [(i, i - i % 2, 1) for i in range(800)]


def test_empty_table(spark):
    assert N.jaccard_join(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(1000 + i, 1000) for i in range(1, 80)] + [(r.randrange(5000, 5200), r.randrange(5000, 5200)) for _ in range(150)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_intersections():
    r = np.random.default_rng(0)
    sets = [np.unique(r.integers(0, 400, 90).astype(np.uint64)) for _ in range(7)]
    got, want = N.intersections(sets), np.array([[len(set(a) & set(b)) for b in sets] for a in sets])
    assert ((got == want) | np.eye(7, dtype=bool)).all()  # the diagonal is not asked for
    assert N.intersections(sets[:2]).tolist() == [[len(set(a) & set(b)) for b in sets[:2]] for a in sets[:2]]
