import duckdb
import numpy as np
import pyarrow as pa
import pytest

from sigloom.llm import decontamination as D

DOCS, ITEMS = "doc_id long, text string, window string, hit string", "item_id long, text string, size string"
ITEM = "A train from Paris to Lyon covers 450 km in 3 hours while another train covers 300 km in 2 hours. How fast is the train to Lyon going on average?"
PLAIN = "the quick brown fox jumps over the lazy dog and then it sleeps under the old oak tree until dawn"


def run(spark, docs, items, **how):
    got = D.matches(spark.createDataFrame([(i, t, None, "h") for i, t in docs], DOCS), spark.createDataFrame([(i, t, None) for i, t in items], ITEMS), **how)
    return {(r.doc_id, r.item_id): r for r in got.where(f"share >= {D.SHARE}").collect()}


CASES = [
    (1, f"Intro words. {ITEM} And more."),
    (2, ITEM.replace("450", "520").replace("Lyon", "Nice").replace(" 3 ", " 4 ")),  # other parameters, taken over alike
    (3, ITEM.replace("to Lyon covers", "to Nice covers")),  # Lyon is Nice in one place and Lyon in another
    (4, PLAIN.upper().replace(" ", "\n")),
    (5, "“" + PLAIN.replace("fox", "cat") + "”"),  # one word changed
    (6, "the quick brown fox jumps over the lazy"),  # a phrase only
    (7, None), (8, ""), (9, "filler " * 9000 + PLAIN + " filler" * 9000), (9, PLAIN), (None, PLAIN), (10, "one two three four five"), (11, "one two THREE, four five six"), (12, "x"),
]
ITEMS_IN = [(1, ITEM), (2, PLAIN), (2, PLAIN), (3, None), (4, "one two three four five"), (5, "5 km"), (None, PLAIN)]


def test_cases(spark):
    got = run(spark, CASES, ITEMS_IN)
    assert {d for d, i in got if i == 1} == {1, 2}
    assert {d for d, i in got if i == 2} == {4, 5, 9, None}
    assert {d for d, i in got if i == 4} == {10, 11}
    assert {i for _, i in got} == {1, 2, 4, D.NO_ID}
    assert got[1, 1].n_changed == 0 and got[2, 1].n_changed == 3


def test_shuffled_windows_give_the_same(spark):
    assert run(spark, CASES, ITEMS_IN, most_kept=0) == run(spark, CASES, ITEMS_IN)


def test_exact_copies(spark):
    items = {
        1: "2, 4, 8, 16, 32, 64: what comes next?", 2: "Compute 12 + 7 - 3 * 4 / 2", 3: "What is the capital city of France today?", 4: "Ann Lee", 5: "42", 6: "¿Qué es — “esto”?",
        7: " ".join(f"{i} Word{i}" for i in range(30)) + " end", 8: "?! --",
    }
    docs = {i: t for j, q in items.items() for i, t in ((10 * j, f"Homework page\n{q} Then more."), (10 * j + 1, f"He said: (“{q}”)"), (10 * j + 2, q.upper()), (10 * j + 3, q), (10 * j + 4, f"about {q.split()[0]}x none"))}
    docs[75] = items[7].replace("Word15", "other")
    docs[76] = items[7] + " and " + items[4] + " twice " + items[4]
    want = {(10 * j + k, j) for j in items if j < 8 for k in range(4)} | {(76, 7), (76, 4)}
    for most in (D.MOST_KEPT, 0):
        got = run(spark, docs.items(), items.items(), most_kept=most)
        assert set(got) == want
        assert all(got[pair].share == 1 for pair in want)


def test_many_alignments_and_sql(spark):
    """A document that repeats a line often against an item that does; and both tables through the query's SQL."""
    line = "every cat of the house sat on Monday with 3 mice. "
    items = {1: line * 40, 2: PLAIN, 3: "“Ann” Lee, 42!", 4: ITEM}
    docs = {1: line * 300, 2: f"x\n{items[3]} y", 3: PLAIN.replace("fox", "cat"), 4: "nothing", 5: ITEM.replace("450", "520"), 6: "ann lee 42"}
    got = run(spark, docs.items(), items.items())
    assert set(got) == {(1, 1), (2, 3), (6, 3), (3, 2), (5, 4)} and got[1, 1].n_covered == 440
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": list(docs), "text": list(docs.values())}))
    con.register("benchmark", pa.table({"item_id": list(items), "text": list(items.values())}))
    want = con.sql(D.OP8_SQL).fetchall()
    assert sorted(want) == sorted((r.doc_id, r.item_id, r.n_words, r.n_covered, r.n_changed, r.share) for r in got.values())


def test_empty_tables(spark):
    assert run(spark, [], ITEMS_IN) == {} == run(spark, CASES, [])


def test_slots():
    a, b, c = (bytes([1]) + bytes([i]) * 8 for i in range(3))
    assert D.consistent([(a + b, b + c), (b, c)]) and not D.consistent([(a + b, b + b)]) and not D.consistent([(a, b), (a, c)])


def test_kinds():
    raw = "He paid 30 dollars to Ann Lee. Ann kept 1,500 km -- (Élan) 5 s".encode()
    x = D.canonical(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    words = [raw[a:b].decode() for a, b in zip(x["start"], x["end"])]
    kinds = dict(zip(words, x["kind"].tolist()))
    assert kinds["30"] == kinds["1,500"] == D.NUMBER and kinds["dollars"] == kinds["km"] == kinds["s"] == D.UNIT and kinds["Lee"] == kinds["Élan"] == D.NAME and kinds["He"] == D.LITERAL and "--" not in kinds


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_planted_passages(spark, sf):
    """Against whole items as substrings, white space apart."""
    d = f"/root/testdata/{sf}"
    squeeze = lambda t: " ".join(t.split())
    docs = {r.doc_id: squeeze(r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    items = {r.item_id: squeeze(r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()}
    want = {(i, j) for i, t in docs.items() for j, q in items.items() if q in t}
    got = {(r.doc_id, r.item_id) for r in D.op8_decontamination(spark, d).collect()}
    assert want and want <= got and len(got - want) <= len(want) // 5
