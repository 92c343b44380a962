import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sigloom.llm import sentencepieces as S

PATH = S.public("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, ids string, scores string"
TEXTS = ["a", "the cat", " lead", "trail ", "a  b", "x\ny", "\n", "\n\n a\n", "é", "naïve café", "漢字かな", "👍🏽 ok", "\tz\r", "tions that", "   ", "▁x", "<0x41>", "</s>", "ꙮ", "zzzzzzzz", "the the the"]


def brute(text):
    """Scores and ids of all segmentations, best first."""
    model, unit = S.pieces(PATH), S.prepared(text)
    by_text = {p.replace(b" ", S.SPACE.encode()).decode(): i for i, p in enumerate(model.raw) if model.score[i] < 0 or i > 258}
    ways = {0: [(0, [])]}
    for at in range(len(unit)):
        for score, ids in ways.pop(at, []):
            fits = [(by_text[unit[at:to]], at, to) for to in range(at + 1, min(len(unit), at + 16) + 1) if unit[at:to] in by_text]
            if unit[at] not in by_text:
                fits.append((-1, at, at + 1))
            for p, a, to in fits:
                ways.setdefault(to, []).append((score + (int(model.score[p]) if p >= 0 else model.unknown), ids + model.spell(p, unit[a])))
    return sorted(ways[len(unit)], key=lambda w: -w[0])


@pytest.mark.parametrize("text", TEXTS)
def test_n_best_is_that_of_all_segmentations(text):
    want = brute(text)
    got = S.n_best(S.pieces(PATH), S.prepared(text), 12)
    assert [s for s, _ in got] == [s for s, _ in want[:12]]
    every = {(s, tuple(i)) for s, i in want}
    assert len({tuple(i) for _, i in got}) == len(got) and all((s, tuple(i)) in every for s, i in got)
    ids, count, scores = S.Encoder(PATH)(pa.array([text]), 6)
    assert scores == [[s for s, _ in want[:6]]] and (scores[0][0], tuple(ids.tolist())) in every
    if text != "▁x":
        assert S.decode(PATH, ids, count) == [text.encode()]


def test_bulk_equals_whole_lattices(monkeypatch):
    monkeypatch.setattr(S, "KEPT_UNITS", 30)
    r = np.random.default_rng(2)
    texts = ["", None] + ["".join(r.choice(TEXTS, 8)) for _ in range(60)]
    texts = [t or "" for t in texts if t is None or "▁" not in t]
    bulk = S.Encoder(PATH)
    for at in range(0, len(texts), 7):
        part = texts[at : at + 7]
        ids, count, scores = bulk(pa.array(part), 4)
        for text, got, own in zip(part, np.split(ids, np.cumsum(count)[:-1]), scores):
            want = S.n_best(S.pieces(PATH), S.prepared(text), 4)
            assert own == [s for s, _ in want]
            assert S.n_best(S.pieces(PATH), S.prepared(text), 1)[0][1] == got.tolist() or own[:1] * 2 == own[:2]
        assert S.decode(PATH, ids, count) == [t.encode() for t in part]


def test_decoding_agrees_with_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    coded = S.encode(docs, PATH)
    rows = coded.collect()
    assert all(library.decode(list(r.ids)) == text[r.doc_id] for r in rows)
    assert {r.doc_id: r.text for r in S.decoded(coded, PATH).collect()} == text
    own = S.decode(PATH, np.array(library.encode(text[0])), np.array([len(library.encode(text[0]))]))
    assert own == [text[0].encode()]


def test_rows(spark):
    rows = [(1, None, "x", None), (2, "", None, None), (3, "a b", None, None), (3, "a b", None, None), (None, "q" * 50000 + " " + "the " * 9000, None, None)]
    got = S.digest(spark.createDataFrame(rows, SCHEMA), PATH).collect()
    assert len(got) == 5 and all(r.round_trip and r.scores == sorted(r.scores, reverse=True) and r.best_score == r.scores[0] for r in got)
    assert all(r.text_crc32 == zlib.crc32((t or "").encode()) for r in got for i, t, _, _ in rows if i == r.doc_id)
    assert S.digest(spark.createDataFrame([], SCHEMA), PATH).count() == 0
    assert [(r.n_pieces, list(r.scores)) for r in got if r.doc_id in (1, 2)] == [(0, [0])] * 2


def worth(ids):
    """Score of a list of ids; a run of byte pieces counts for each character that it spells."""
    model, out, run = S.pieces(PATH), 0, b""
    is_byte = set(model.byte.tolist())
    for i in [*ids, -1]:
        if i in is_byte:
            run += model.raw[i]
            continue
        out, run = out + model.unknown * len(run.decode()), b""
        out += int(model.score[i]) if i >= 0 else 0
    return out


def test_ids_of_all_segmentations(spark):
    r = np.random.default_rng(3)
    texts = [t for t in TEXTS if t != "▁x"]
    texts = ["", *texts, *("".join(r.choice(texts, 8)) for _ in range(60))]
    rows = S.encode(spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], SCHEMA).coalesce(1), PATH).collect()
    digests = {r.doc_id: r for r in S.digest(spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], SCHEMA), PATH).collect()}
    assert len(rows) == len(texts)
    for row in rows:
        text, ways = texts[row.doc_id], [list(w) for w in row.ways]
        want = S.n_best(S.pieces(PATH), S.prepared(text), S.N_BEST)
        assert ways[0] == list(row.ids) and len({tuple(w) for w in ways}) == len(ways) == len(row.scores)
        assert [worth(w) for w in ways] == list(row.scores) == [s for s, _ in want]
        assert S.decode(PATH, np.array(sum(ways, []), np.int64), np.array([len(w) for w in ways])) == [text.encode()] * len(ways)
        got = digests[row.doc_id]
        assert got.ways_crc32 == [zlib.crc32(np.array(w, "<u4").tobytes()) for w in ways] and got.ways_round_trip == [True] * len(ways)
        assert got.ids_crc32 == got.ways_crc32[0]


def unigram(path, scores, kind=1, spaces=b""):
    """A model file in the library's format: control and byte pieces, and pieces with their logarithms of probabilities."""

    def field(number, wire, raw):
        return bytes([number << 3 | wire]) if number < 16 else bytes([(number << 3 | wire) & 0x7F | 0x80, number >> 4]), raw

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def message(*fields):
        return b"".join(tag + (varint(len(raw)) + raw if tag[0] & 7 == 2 else raw) for tag, raw in fields)

    def piece(text, score, type_):
        return message(field(1, 2, message(field(1, 2, text.encode()), field(2, 5, struct.pack("<f", score)), field(3, 0, varint(type_)))))

    pieces = piece("<unk>", 0, 2) + piece("<s>", 0, 3) + piece("</s>", 0, 3)
    pieces += b"".join(piece(f"<0x{i:02X}>", 0, 6) for i in range(256)) + b"".join(piece(p, s, 1) for p, s in scores.items())
    n = 259 + len(scores)
    trainer = message(field(3, 0, varint(kind)), field(4, 0, varint(n)), field(35, 0, varint(1)))
    normal = message(field(1, 2, b"identity"), field(3, 0, varint(1)), field(4, 0, varint(0)), field(5, 0, varint(1)))
    path.write_bytes(pieces + message(field(2, 2, trainer), field(3, 2, normal)))
    return str(path)


def test_unigram_model_as_the_library(tmp_path):
    """Fractional scores: best and n best segmentations, with their scores, are those of the library."""
    import sentencepiece

    r = np.random.default_rng(4)
    texts = {t.strip() for t in "the then there their other mother father than that tea eat heat at he her here a e h t r m o n f".split()}
    scores = {(S.SPACE if r.random() < 0.4 and len(t) > 1 else "") + t: float(-1 - 9 * r.random()) for t in sorted(texts)} | {S.SPACE: -2.25, S.SPACE + "the": -1.5}
    path = unigram(tmp_path / "own.model", scores)
    library, model = sentencepiece.SentencePieceProcessor(model_file=path), S.Pieces(path)
    for text in ("the mother", "then there at the tea", "heat", "their father eat other than that", "a", "hhtt aeo the"):
        got = S.n_best(model, S.prepared(text), 5)
        assert got[0][1] == library.encode(text)
        assert sorted(ids for _, ids in got) == sorted(library.nbest_encode_as_ids(text, len(got)))
        ids, count, found = S.Encoder(path)(pa.array([text, text]), 5)
        assert np.allclose(found[0], [s for s, _ in got]) and found[0] == found[1] and S.decode(path, ids, count) == [text.encode()] * 2
        assert found[0][0] == pytest.approx(sum(model.score[i] for i in got[0][1])) and found[0][0] != round(found[0][0])


def test_changing_normaliser_is_refused(monkeypatch):
    class Changing:
        def __init__(self, model_file):
            pass

        def normalize(self, text):
            return "fi A é 1/2"

    monkeypatch.setattr("sentencepiece.SentencePieceProcessor", Changing)
    with pytest.raises(ValueError, match="normaliser"):
        S.Pieces(PATH)
