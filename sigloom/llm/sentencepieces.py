"""SentencePiece encoding and decoding with N-best segmentation.

A text is a lattice: nodes between characters, an edge for each piece that fits, with the piece's score; characters without
a piece of their own have an edge of the least score less PENALTY, which stands for their byte pieces. Forward Viterbi gives
each node the score of the best way to it from the beginning. From the end, A* search goes back through the lattice with
those scores as its heuristic, which is exact, so complete ways leave the queue in order of their scores: the N best.

No piece crosses from other characters to a space, and none holds a line end, so a lattice falls into units there. In bulk,
units are known by 64-bit hashes; the new ones of a slice go through one forward and one backward Viterbi in NumPy, which
gives their best segmentation and how much the second best loses. The N best segmentations of a text differ from the best in
the N - 1 units that lose least, and A* is run on those, so the result is that of A* over the whole text: the ids of each of
the N are the best ones with those of A* in the place of such units. The first is Viterbi's, which A* equals up to ties.

Scores are those of the model, unrounded: integers in a BPE model, logarithms of probabilities in a unigram model, whose best
and n best segmentations are the library's. Models whose normaliser changes texts are refused, since decoding could not give them back.

Ties go to the longer piece at the end, and between units to the earlier one. Decoding joins the pieces and gives back every text exactly.

Defined cases: a null text is empty, and an empty one has no pieces, a score of 0 and one segmentation; rows that repeat a
doc_id are encoded each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from sigloom.llm import common as C
from sigloom.llm.token_counts import public

PENALTY, N_BEST = 10, 4
#: Units that a worker keeps, and searches; what is full starts afresh.
KEPT_UNITS, KEPT_SEARCHES = 600_000, 100_000
NEVER = 1e300
#: What a normaliser would change: ligatures, wide letters, accents apart, runs of spaces.
PROBE = "ﬁ  Ａ e\u0301 ½"
SPACE = "▁"


class Pieces:
    """The pieces of a model as a trie, and what each stands for."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize(PROBE).replace(SPACE, " ").strip() != PROBE:
            raise ValueError("the model's normaliser changes texts")
        n = model.get_piece_size()
        self.byte = np.full(256, -1)
        plain: dict[str, int] = {}
        self.score = np.zeros(n)
        self.raw = [b""] * n
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:-1], 16)] = i
                self.raw[i] = bytes([int(piece[3:-1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                if SPACE in piece.lstrip(SPACE) or "\n" in piece:
                    raise ValueError(f"a piece crosses a unit: {piece!r}")
                plain[piece] = i
                self.score[i] = model.get_score(i)
                self.raw[i] = piece.replace(SPACE, " ").encode()
        if (self.byte < 0).any():
            raise ValueError("the model has no byte pieces")
        self.unknown = float(self.score.min()) - PENALTY
        # trie: (state, character) -> state, as sorted keys
        states: dict[str, int] = {"": 0}
        keys, to, ends = [], [], {}
        for piece, i in sorted(plain.items()):
            for k in range(1, len(piece) + 1):
                if piece[:k] not in states:
                    states[piece[:k]] = len(states)
                    keys.append(states[piece[: k - 1]] << 21 | ord(piece[k - 1]))
                    to.append(states[piece[:k]])
            ends[states[piece]] = i
        order = np.argsort(keys)
        self.keys, self.to = np.array(keys, np.int64)[order], np.array(to, np.int64)[order]
        self.ends = np.full(len(states), -1)
        self.ends[list(ends)] = list(ends.values())
        self.blob = np.frombuffer(b"".join(self.raw), np.uint8)
        self.size = np.array([len(x) for x in self.raw])
        self.begin = np.cumsum(self.size) - self.size

    def edges(self, chars: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From, length and piece (-1: bytes) of all edges; end: where the unit of each character ends."""
        at = np.arange(len(chars))
        state = np.zeros(len(chars), np.int64)
        found, length = [], 0
        alone = np.zeros(len(chars), bool)
        while len(at):
            key = state << 21 | chars[at + length]
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[i] == key
            at, state = at[hit], self.to[i[hit]]
            length += 1
            piece = self.ends[state]
            full = piece >= 0
            found.append((at[full], np.full(int(full.sum()), length), piece[full]))
            if length == 1:
                alone[at[full]] = True
            inside = at + length < end[at]
            at, state = at[inside], state[inside]
        rest = np.flatnonzero(~alone)
        found.append((rest, np.ones(len(rest), np.int64), np.full(len(rest), -1)))
        return tuple(np.concatenate(x) for x in zip(*found))  # type: ignore[return-value]

    def worth(self, piece: np.ndarray) -> np.ndarray:
        return np.where(piece >= 0, self.score[piece], self.unknown)

    def spell(self, piece: int, char: str) -> list[int]:
        return [piece] if piece >= 0 else [int(self.byte[b]) for b in (char if char != SPACE else " ").encode()]


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


# ---------------------------------------------------------------- one lattice


def n_best(model: Pieces, unit: str, n: int) -> list[tuple[float, list[int]]]:
    """Score and ids of the n best segmentations of a string in which spaces are SPACE."""
    chars = np.frombuffer(unit.encode("utf-32-le"), np.uint32).astype(np.int64)
    size = len(chars)
    start, length, piece = model.edges(chars, np.full(size, size))
    worth = model.worth(piece)
    into: list[list[tuple[int, int, int]]] = [[] for _ in range(size + 1)]
    for s, k, p, w in sorted(zip(start.tolist(), length.tolist(), piece.tolist(), worth.tolist()), key=lambda e: -e[1]):
        into[s + k].append((s, p, w))
    forward = [0.0] + [-NEVER] * size
    for node in range(1, size + 1):
        forward[node] = max((forward[s] + w for s, _, w in into[node]), default=-NEVER)
    out: list[tuple[float, list[int]]] = []
    # of equal estimates, the one nearest to the beginning goes first: ties do not spread
    queue = [(-forward[size], size, 0, 0.0, None)]
    count = 0
    while queue and len(out) < n:
        estimate, node, _, behind, way = heapq.heappop(queue)
        if node == 0:
            ids: list[int] = []
            while way:
                ids += model.spell(way[0], unit[way[1]])
                way = way[2]
            out.append((-estimate, ids))
            continue
        for s, p, w in into[node]:
            count += 1
            heapq.heappush(queue, (-(forward[s] + w + behind), s, count, behind + w, (p, s, way)))
    return out


def prepared(text: str) -> str:
    return (SPACE + text.replace(" ", SPACE)) if text else ""


# ---------------------------------------------------------------- many units


def solve(model: Pieces, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best score, loss of the second best (NEVER: there is none), number of ids, and all ids, of many strings at once."""
    sizes = np.array([len(u) for u in units])
    chars = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.int64)
    begin = np.cumsum(sizes) - sizes
    unit = np.repeat(np.arange(len(units)), sizes)
    start, length, piece = model.edges(chars, (begin + sizes)[unit])
    worth = model.worth(piece)
    # nodes: one more than characters for each unit
    node = start + unit[start]
    first, last = begin + np.arange(len(units)), begin + sizes + np.arange(len(units))
    place = start - begin[unit[start]]
    order = np.lexsort((length, place))
    node, length, piece, worth, place, owner = node[order], length[order], piece[order], worth[order], place[order], unit[start[order]]
    group = place * 32 + length  # in a group all ends are different, as are all beginnings
    cut = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]]).tolist()
    to = node + length
    n_nodes = len(chars) + len(units)
    forward, by = np.full(n_nodes, -NEVER), np.full(n_nodes, -1)
    forward[first] = 0
    for a, b in zip(cut[:-1], cut[1:]):
        ends, value = to[a:b], forward[node[a:b]] + worth[a:b]
        better = value > forward[ends]
        forward[ends[better]], by[ends[better]] = value[better], np.arange(a, b)[better]
    backward = np.full(n_nodes, -NEVER)
    backward[last] = 0
    for a, b in zip(cut[-2::-1], cut[:0:-1]):
        begins = node[a:b]
        backward[begins] = np.maximum(backward[begins], worth[a:b] + backward[to[a:b]])
    # the best way back, all units a step at a time
    on, steps, at, live = np.zeros(len(node), bool), [], last.copy(), np.arange(len(units))
    while len(live):
        edge = by[at]
        on[edge] = True
        steps.append((live, edge))
        at = node[edge]
        more = at > first[live]
        live, at = live[more], at[more]
    loss = np.full(len(units), NEVER)
    off = np.flatnonzero(~on)
    np.minimum.at(loss, owner[off], forward[last[owner[off]]] - (forward[node[off]] + worth[off] + backward[to[off]]))
    who, edge = (np.concatenate([s[i] for s in steps]) for i in (0, 1))
    order = np.lexsort((node[edge], who))
    who, edge = who[order], edge[order]
    ids, count = piece[edge], np.ones(len(edge), np.int64)
    if (odd := np.flatnonzero(ids < 0)).size:
        char = chars[node[edge[odd]] - who[odd]]
        spelled = [model.spell(-1, chr(c)) for c in char.tolist()]
        count[odd] = [len(x) for x in spelled]
        out = np.repeat(ids, count)
        out[np.repeat(np.isin(np.arange(len(ids)), odd), count)] = [i for x in spelled for i in x]
        ids = out
    return forward[last], loss, np.bincount(who, count, len(units)).astype(np.int64), ids.astype(np.int64)


class Encoder:
    """Encodes slices of texts by their units."""

    def __init__(self, path: str):
        self.model = pieces(path)
        self.searches: dict[tuple[int, int], tuple[tuple[float, ...], tuple[bytes, ...]]] = {}
        self.forget()

    def forget(self) -> None:
        self.keys, self.score, self.loss = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
        self.at, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def learn(self, keys: np.ndarray, units: list[str]) -> None:
        score, loss, n, ids = solve(self.model, units)
        at = len(self.pool) + np.cumsum(n) - n
        self.pool = np.concatenate([self.pool, ids.astype(np.int32)])
        order = np.argsort(joined := np.concatenate([self.keys, keys]), kind="stable")
        self.keys = joined[order]
        self.score, self.loss, self.at, self.n = (np.concatenate(x)[order] for x in ((self.score, score), (self.loss, loss), (self.at, at), (self.n, n)))

    def search(self, key: int, unit: bytes, best: bytes, n: int) -> tuple[tuple[float, ...], tuple[bytes, ...]]:
        """Of the n best segmentations of a unit: what each loses against the best, and its ids; best: the ids of the first."""
        if (key, n) not in self.searches:
            if len(self.searches) > KEPT_SEARCHES:
                self.searches.clear()
            found = n_best(self.model, unit.decode().replace(" ", SPACE), n)
            ways = [np.array(ids, "<u4").tobytes() for _, ids in found]
            # best is one of them, or ties with all of them
            ways = [best, *(w for w in ways if w != best)][: len(found)]
            self.searches[key, n] = tuple(found[0][0] - s for s, _ in found), tuple(ways)
        return self.searches[key, n]

    def __call__(self, texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, list[list[float]]]:
        """All ids, their number for each text, and the scores of each text's n best segmentations."""
        return self.ways(texts, n)[:3]

    def ways(self, texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, list[list[float]], list[list[bytes]]]:
        """As __call__, and the ids of each text's n best segmentations, as bytes of four for each."""
        marked = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(" ", texts, ""))
        data, offsets = C.buffers(marked)
        n_docs = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(n_docs, np.int64), [[0.0] for _ in range(n_docs)], [[b""] for _ in range(n_docs)]
        gap, line = data == 32, data == 10
        begins = np.zeros(len(data), bool)
        begins[1:] = gap[1:] & ~gap[:-1] | line[1:] | line[:-1]
        begins[offsets[:-1][offsets[:-1] < len(data)]] = True
        start = np.flatnonzero(begins)
        stop = np.append(start[1:], len(data))
        doc = np.searchsorted(offsets, start, side="right") - 1
        codes = C.span_hash(C.prefix_hash(data), start, stop)
        keys, first, back = np.unique(codes, return_index=True, return_inverse=True)
        if len(self.keys) > KEPT_UNITS:
            self.forget()
        raw = data.tobytes()
        new = ~np.isin(keys, self.keys, assume_unique=True, kind="sort") if len(self.keys) else np.ones(len(keys), bool)
        if new.any():
            self.learn(keys[new], [raw[a:b].decode().replace(" ", SPACE) for a, b in zip(start[first[new]].tolist(), stop[first[new]].tolist())])
        hit = np.searchsorted(self.keys, keys)[back]
        count = self.n[hit]
        total = np.arange(int(count.sum()))
        ids = self.pool[total + np.repeat(self.at[hit] - (np.cumsum(count) - count), count)]
        best = np.zeros(n_docs + 1, np.int64)
        np.cumsum(np.bincount(doc, minlength=n_docs), out=best[1:])
        score = np.bincount(doc, self.score[hit], n_docs)
        loss, scores, lists = self.loss[hit], [], []
        coded, place = ids.astype("<u4").tobytes(), np.concatenate([[0], 4 * np.cumsum(count)])
        for d, (a, b) in enumerate(zip(best[:-1].tolist(), best[1:].tolist())):
            ways, found = [(0.0, ())], []
            if n > 1 and b > a:
                least = loss[a:b]
                few = np.arange(b - a)
                if b - a >= n:
                    few = np.flatnonzero(least <= np.partition(least, n - 2)[n - 2])
                    few = np.sort(few[np.argsort(least[few], kind="stable")[: n - 1]])
                for i in few[least[few] < NEVER].tolist():
                    u = a + i
                    at, to = int(place[u]), int(place[u + 1])
                    more, other = self.search(int(codes[u]), raw[start[u] : stop[u]], coded[at:to], n)
                    found.append((at, to, other))
                    ways = heapq.nsmallest(n, ((x + y, (*taken, k)) for x, taken in ways for k, y in enumerate(more)))
            scores.append([float(score[d]) - x for x, _ in ways])
            lists.append([])
            for _, taken in ways:
                parts, before = [], int(place[a])
                for (at, to, other), k in zip(found, taken):
                    if k:
                        parts += [coded[before:at], other[k]]
                        before = to
                lists[-1].append(b"".join([*parts, coded[before : int(place[b])]]))
        return ids, np.bincount(doc, count, n_docs).astype(np.int64), scores, lists


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def decode(path: str, ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """The texts of some runs of ids."""
    model = pieces(path)
    size = model.size[ids]
    total = np.arange(int(size.sum()))
    raw = model.blob[total + np.repeat(model.begin[ids] - (np.cumsum(size) - size), size)].tobytes()
    ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(lengths)])].tolist()
    return [raw[a + 1 : b] for a, b in zip(ends[:-1], ends[1:])]  # without the space before the text


SCHEMA = "doc_id long, ids array<int>, scores array<double>, ways array<array<int>>"


def encode(docs: DataFrame, path: str, n: int = N_BEST) -> DataFrame:
    """doc_id, ids of the best segmentation, and the scores and the ids of the n best (fewer where there are fewer)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches, most=1 << 20):
            ids, count, scores, ways = encoder(path).ways(C.flat(batch, "text"), n)
            every = [w for x in ways for w in x]
            inner = pa.ListArray.from_arrays(_ends([len(w) >> 2 for w in every]), pa.array(np.frombuffer(b"".join(every), "<i4")))
            values = [pa.ListArray.from_arrays(_ends(count), pa.array(ids.astype(np.int32))), pa.array(scores, pa.list_(pa.float64())), pa.ListArray.from_arrays(_ends([len(x) for x in ways]), inner)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *values], ["doc_id", "ids", "scores", "ways"])

    return C.texts(docs).mapInArrow(C.freed(run), SCHEMA)


def _ends(sizes) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))


def decoded(coded: DataFrame, path: str) -> DataFrame:
    """doc_id and text for rows of doc_id and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            texts = decode(path, ids, pc.list_value_length(lists).to_numpy(zero_copy_only=False)) if len(ids) else [b""] * batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t.decode() for t in texts], pa.string())], ["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(C.freed(run), "doc_id long, text string")


DIGEST_SCHEMA = (
    "doc_id long, n_pieces long, ids_crc32 long, best_score double, n_found int, scores array<double>, text_crc32 long, round_trip boolean, "
    "ways_crc32 array<long>, ways_round_trip array<boolean>"
)


def digest(docs: DataFrame, path: str, n: int = N_BEST) -> DataFrame:
    """Encodes and decodes each of the n best: counts, checksums and whether each text comes back as it was; those without `ways` are of the best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches, most=1 << 20):
            texts = C.flat(batch, "text")
            _, count, scores, ways = encoder(path).ways(texts, n)
            data, offsets = C.buffers(texts)
            raw, at = data.tobytes(), offsets.tolist()
            crc, same, first = [[zlib.crc32(w) for w in x] for x in ways], [[] for _ in ways], []
            for k in range(max(map(len, ways))):  # one of each text at a time: as much memory as for the best
                some = [d for d, x in enumerate(ways) if k < len(x)]
                ids = np.frombuffer(b"".join([ways[d][k] for d in some]), "<u4").astype(np.int64)
                for d, text in zip(some, decode(path, ids, np.array([len(ways[d][k]) >> 2 for d in some]))):
                    same[d].append(text == raw[at[d] : at[d + 1]])
                    if not k:
                        first.append(zlib.crc32(text))
            values = [
                pa.array(count),
                pa.array([x[0] for x in crc], pa.int64()),
                pa.array([s[0] for s in scores], pa.float64()),
                pa.array([len(s) for s in scores], pa.int32()),
                pa.array(scores, pa.list_(pa.float64())),
                pa.array(first, pa.int64()),
                pa.array([x[0] for x in same]),
                pa.array(crc, pa.list_(pa.int64())),
                pa.array(same, pa.list_(pa.bool_())),
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *values], [x.split()[0] for x in DIGEST_SCHEMA.split(", ")])

    return C.texts(docs).mapInArrow(C.freed(run), DIGEST_SCHEMA)


def op6_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(C.table(spark, sf_dir, "documents"), public("piece_bpe_32k.model"))
