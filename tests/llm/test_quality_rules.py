import re
from collections import Counter

import pytest

from sigloom.llm import quality_rules as Q

SCHEMA = "doc_id long, text string, kept string"
TEXTS = [
    None, "", " \n\t ", "one", "a b c a b c", "x\nx\n \nx", "the cat # sat * on", "é ü ß 漢字 é ü ß 漢字",
    " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i % 20}" for i in range(200)), " ".join(f"w{i}" for i in range(20000)), "same line here\n" * 80,
    " ".join(f"w{i} #" for i in range(60)), "tail\nhead", "head",
]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(3)}
    seen, dups, dup_chars = set(), 0, 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            if line in seen:
                dups += 1
                dup_chars += sum(map(len, re.findall(r"[^\x20\x09-\x0D]+", line)))
            seen.add(line)
    chars = sum(map(len, words))
    out = {"n_words": len(words), "word_chars": chars, "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": dups, "n_repeat_words": len(hit), "dup_line_chars": dup_chars}
    bad = dup_chars > Q.LINE_LIMIT * chars or out["n_symbols"] > Q.SYMBOL_LIMIT * len(words)
    for n, most in Q.NGRAM_LIMITS.items():
        seen, cover = set(), set()
        for i in range(len(words) - n + 1):
            g = tuple(words[i : i + n])
            if g in seen:
                cover |= set(range(i, i + n))
            seen.add(g)
        out[f"dup_{n}gram_chars"] = sum(len(words[i]) for i in cover)
        bad |= out[f"dup_{n}gram_chars"] > most * chars
    out["base_failed"] = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    out["kept"] = not out["base_failed"] and not bad
    return out


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "a b", None), (3, "one", "y")], SCHEMA)
    got = Q.quality_rules(docs).collect()
    assert len(got) == len(TEXTS) + 2
    for row in got:
        if row.doc_id is not None:
            want = brute(TEXTS[row.doc_id])
            assert {k: row[k] for k in want} == want, row.doc_id


def test_empty_table(spark):
    assert Q.quality_rules(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("text", [t for t in TEXTS if t])
def test_slices_do_not_change_counts(text):
    import numpy as np
    data = np.frombuffer((text + text).encode(), np.uint8)
    n = len(text.encode())
    m = Q.measure(data, np.array([0, n, 2 * n]))
    assert all(v[0] == v[1] for v in m.values())
