import random
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sigloom.llm import common as C
from sigloom.llm import token_store as S

PATH = S.public("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, codes string, part string"


@pytest.mark.parametrize("n", [1, 7, 511, 512, 513, 5000])
@pytest.mark.parametrize("top", [200, 256, 40000, 1 << 20, (1 << 32) - 1])
def test_random_access(n, top):
    r = np.random.default_rng(n)
    ids = r.integers(0, top, n, endpoint=True).astype(np.uint32)
    s = S.Segment(S.encode_segment(np.array([5, 9]), np.array([n // 2, n - n // 2]), ids))
    assert s.doc_ids.tolist() == [5, 9] and s.offsets.tolist() == [0, n // 2, n]
    assert (s.ids() == ids).all()
    for i in {0, n - 1, n // 2, n // 3, min(n - 1, 64), min(n - 1, 512)}:
        assert s[i] == ids[i]
        assert (s.ids(i, n) == ids[i:]).all() and (s.ids(0, i) == ids[:i]).all()


WORDS = ["It's", "naïve", "don't", "ΑΣ", "Σ.", "x\ty", "a b", "é", "̈x", "İ", "123abc", "…!!", "<|endoftext|>", "<|endof", "ﬁ", "\x1cq", "a b", "", "\r", "漢字", "'s", "'", "s", "It'll.", "'.", "a'.", "1.", "x.|", "CAFÉ!", "Dog,,", "...", "Ⅷ.", "ª.", "x\x01y", "ǅ.", "TARİHİ,", "GEZİ.", "ড়,", "ਗ਼.", "གྷ!", "e\u0301.", "İstanbul;"]


def encoded(texts, by_word):
    ids, n = S.encode_slice(PATH, pa.array(texts), 2, by_word)
    return [x.tobytes() for x in np.split(ids, np.cumsum(n)[:-1])]


def test_words_equal_whole_texts(monkeypatch):
    monkeypatch.setattr(S, "CACHE_WORDS", 40)
    r = np.random.default_rng(0)
    texts = ["", " ", "\n\n"] + [str(r.choice([" ", "\n", "  ", " \n"])).join(r.choice(WORDS, 12)) for _ in range(300)]
    whole = encoded(texts, False)
    assert encoded(texts, True) == whole
    assert [x for i in range(0, len(texts), 3) for x in encoded(texts[i : i + 3], True)] == whole


def test_words_of_all_scripts():
    """Random words of letters, marks and signs of all scripts below U+3000, with stops behind them."""
    r = random.Random(3)
    chars = [chr(c) for c in range(0x21, 0x3000) if unicodedata.category(chr(c))[0] in "LMNPS"]
    marks = [c for c in chars if unicodedata.category(c)[0] == "M"]
    word = lambda: "".join(r.choice(r.choice((chars, marks, "aIxM"))) for _ in range(r.randint(1, 4))) + r.choice(".,!?;:%$&#|*")
    texts = [" ".join(word() for _ in range(8)) for _ in range(1500)]
    assert encoded(texts, True) == encoded(texts, False)


def test_special_strings_in_other_case():
    words = [w for s in ("<|endoftext|>", "<|startoftext|>") for w in (s.upper(), s.title(), f"x{s.upper()}y", f"{s.title()}.", f"({s.upper()},", s.upper()[:-1], s.upper() + s.title(), f"É{s.upper()}")]
    texts = [*words, " ".join(words), "\n".join(words), *(f"A {w} {s}" for w in words for s in ("<|endoftext|>", "b"))]
    assert encoded(texts, True) == encoded(texts, False)


def test_store(spark):
    rows = [(i * 3, " ".join(WORDS[: i % len(WORDS)]) * (i % 9), "c", None) for i in range(300)] + [(None, "no id", None, None), (3, "again", None, None), (3, "again", None, None), (700, None, None, None)]
    out = C.work_dir(spark, "store")
    S.write_store(spark.createDataFrame(rows, SCHEMA).repartition(5), out, PATH)
    got = sorted(S.read_store(spark, out).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: -1 if x is None else x)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]
    ids = {t: encoded([t], False)[0] for t in {r[1] or "" for r in rows}}
    assert sorted((r.n_tokens, r.ids_crc32) for r in got) == sorted((len(ids[t or ""]) // 4, zlib.crc32(ids[t or ""])) for _, t, _, _ in rows)
    assert S.token_at(spark, out, got[5].start + got[5].n_tokens - 1) == 2
    with pytest.raises(IndexError):
        S.token_at(spark, out, 1 << 40)


def test_empty_table(spark):
    out = C.work_dir(spark, "store")
    S.write_store(spark.createDataFrame([], SCHEMA), out, PATH)
    assert S.read_store(spark, out).count() == 0
