"""N-gram Jaccard join by chosen paths (Christiani, Pagh and Sivertsen 2018).

Texts are sets of shingles of five words; texts of fewer words are one shingle. Equal sets form a class and are joined
through one representative. A sketch holds T minima of a set under random orders: for each coordinate, two sets share
their token (24 bits of it are kept) with the probability of their Jaccard similarity. From the root of each run, FAN coordinates are sampled at
every node, and the node's sets are split by the tokens they have there. Nodes of few sets, and nodes that a split has
not halved, are compared by brute force; the others are split further. A pair whose sketches agree in a share p survives a
run with probability q, the solution of q = 1 - (1 - p * q) ** FAN. The runs repeat until the recall of a pair at the
threshold, taken over all sketches that it may have, is at least the target.

Nodes are compared by whole sketches, with a wide margin, which gives groups of sets that may be linked. A node of more than
NODE_BLOCK sets is compared with one of them first; only those that are unlike it are compared with all.

Links are exact. A group of GROUP_BLOCK sets at most is one task, which compares all its pairs. In a larger group each set is
told by what it lacks of a reference, the tokens that most of some hundred members have, and what it has beyond it; these
differences are short. With c = lacking + threshold * beyond, and o tokens that two differences share, two sets are linked
just if c1 + c2 - (1 + threshold) * o <= (1 - threshold) * size of the reference. So

* where c1 + c2 is small enough they are linked, and these links are counted from sums over the different values of c;
* else one of them is far from the reference (c over half the bound), and they are linked only if they share enough. How
  many tokens of its difference other sets have at all is counted first; where these are too few, a set is settled. Those
  left are compared, difference with difference, block by block: far ones with near ones, and far ones with each other
  where they are the greater part of the group; else they are a group of their own, with a reference of its own.

So a group of any number of near copies of one text costs its rows once and again, not its pairs. A group most of which is
far from any one text still costs pairs of blocks, of differences in place of texts. Only a spanning forest of links is ever
written: copies and links are counted, not listed. The classes are the components of the exact links.

Defined cases: null and blank texts have no shingles and no links, as have rows without an id (their class is null);
rows that repeat an id are documents of their own that share it; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sigloom.llm import common as C
from sigloom.llm.graph import components

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.9999
T, FAN, DEPTH, SMALL = 96, 2, 6, 48
#: A sketch agreement below which sets are taken to be unlike: over four deviations under the threshold.
MARGIN = 0.5625
#: Sets of a block when nodes and groups are dealt out.
NODE_BLOCK, GROUP_BLOCK = 4096, 512
_MULTIPLIERS = C.mix(np.arange(1, T + 1, dtype=np.uint64) * np.uint64(0x51ED270B)) | np.uint64(1)


def survives(share: float, fan: int = FAN) -> float:
    """The probability that a pair that agrees in this share of coordinates meets at the end of a run."""
    q = 1.0
    for _ in range(500):
        q = 1 - (1 - share * q) ** fan
    return q


def expected_recall(runs: int, threshold: float = THRESHOLD, fan: int = FAN) -> float:
    """Recall of a pair at the threshold: all runs read one sketch, so the share that its coordinates agree in is taken over."""
    chance = lambda k: math.comb(T, k) * threshold**k * (1 - threshold) ** (T - k)
    return sum(chance(k) * (1 - (1 - survives(k / T, fan)) ** runs) for k in range(math.ceil(MARGIN * T), T + 1))


def runs_for(recall: float, threshold: float = THRESHOLD, fan: int = FAN) -> int:
    for runs in range(1, 65):
        if expected_recall(runs, threshold, fan) >= recall:
            return runs
    raise ValueError(f"a sketch of {T} coordinates does not give a recall of {recall}")


# ---------------------------------------------------------------- sets and sketches


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ordered by document, and the document of each."""
    start, end, doc = C.words(data, offsets)
    codes = C.span_hash(C.prefix_hash(data), start, end)
    n = len(codes)
    at = np.arange(max(0, n - k + 1))
    at = at[doc[at] == doc[at + k - 1]] if len(at) else at
    tokens, owner = C.window_hash(codes, k)[at] if n >= k else np.zeros(0, np.uint64), doc[at]
    n_words = np.bincount(doc, minlength=len(offsets) - 1)
    brief = np.flatnonzero((n_words > 0) & (n_words < k))
    if len(brief):
        first = np.searchsorted(doc, brief)
        made = np.zeros(len(brief), np.uint64)
        for j in range(k - 1):
            has = n_words[brief] > j
            made[has] = C.mix(made[has] + codes[first[has] + j])
        tokens, owner = np.concatenate([tokens, C.mix(made)]), np.concatenate([owner, brief])
        order = np.argsort(owner, kind="stable")
        tokens, owner = tokens[order], owner[order]
    key = C.mix(tokens ^ C.mix(owner.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    repeats = np.zeros(len(key), bool)
    repeats[order[1:]] = key[order][1:] == key[order][:-1]
    return tokens[~repeats], owner[~repeats]


SKETCH_SCHEMA = "doc_id long, text_hash long, set long, n int, sketch binary"


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in C.slices(batches):
        tokens, owner = shingles(*C.buffers(C.flat(batch, "text")))
        sizes = np.bincount(owner, minlength=batch.num_rows)
        has = np.flatnonzero(sizes)
        first = np.concatenate([[0], np.cumsum(sizes[has])[:-1]]).astype(np.int64)
        sketch = np.zeros((len(has), T), "<u4")
        sums = np.zeros(batch.num_rows, np.uint64)
        if len(has):
            for i, m in enumerate(_MULTIPLIERS):
                sketch[:, i] = np.minimum.reduceat(((tokens * m) >> np.uint64(32)).astype(np.uint32), first)
            sums[has] = C.mix(np.add.reduceat(C.mix(tokens), first) + sizes[has].astype(np.uint64))
        raw: list[bytes | None] = [None] * batch.num_rows
        for row, code in zip(has.tolist(), sketch.view(np.uint8).reshape(-1, T, 4)[:, :, 1:].reshape(-1, 3 * T)):
            raw[row] = code.tobytes()
        empty = sizes == 0
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array(sums.view(np.int64), mask=empty), pa.array(sizes.astype(np.int32)), pa.array(raw, pa.binary())],
            ["doc_id", "text_hash", "set", "n", "sketch"],
        )


def codes_of(sketches: pa.ChunkedArray) -> np.ndarray:
    """Sketches as a matrix, a row for each."""
    parts = np.frombuffer(b"".join(sketches.to_pylist()), np.uint8).reshape(-1, T, 3)
    out = np.zeros((len(parts), T, 4), np.uint8)
    out[:, :, 1:] = parts
    return out.view("<u4").reshape(-1, T)


# ---------------------------------------------------------------- groups that arrive whole


def grouped(work: Callable[[pa.Table], Iterator[pa.RecordBatch]]):
    """For mapInArrow on rows sorted by `g`: hands on tables that hold whole groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column("g").to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(g, g[-1]))  # where the last group begins, which may go on in the next batch
            if held and (cut or held[-1].column("g")[0].as_py() != g[0]):
                yield from work(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = [batch.slice(cut)]
            elif cut:
                yield from work(pa.Table.from_batches([batch.slice(0, cut)]))
                held = [batch.slice(cut)]
            else:
                held.append(batch)
        if held:
            yield from work(pa.Table.from_batches(held))

    return run


def borders(g: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]])


def in_block_pairs(df: DataFrame, key: str, item: str, size: str, block: int) -> DataFrame:
    """Deals the items of each key out to all pairs of its blocks: adds g, the pair, and side, 0 or 1 (2: both blocks are one)."""
    n = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64(F.lit(17), item), F.col("blocks").cast("long")).cast("int")
    dealt = df.withColumn("blocks", n).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    return dealt.withColumn("g", F.xxhash64(key, F.least("own", "other"), F.greatest("own", "other"))).withColumn("side", side).drop("own", "other")


def across(left: DataFrame, right: DataFrame, key: str, n_left: str, n_right: str, block: int) -> DataFrame:
    """Deals two tables out to all pairs of a block of the one and a block of the other: adds g and side, 0 for the left and 1 for the right."""
    n = {0: F.ceil(F.col(n_left) / block).cast("int"), 1: F.ceil(F.col(n_right) / block).cast("int")}
    own = lambda side: F.pmod(F.xxhash64(F.lit(17), "set"), n[side].cast("long")).cast("int")
    other = lambda side: F.explode(F.sequence(F.lit(0), n[1 - side] - 1))
    a = left.withColumn("own", own(0)).withColumn("other", other(0)).withColumn("g", F.xxhash64(F.lit(3), key, "own", "other")).withColumn("side", F.lit(0))
    b = right.withColumn("own", own(1)).withColumn("other", other(1)).withColumn("g", F.xxhash64(F.lit(3), key, "other", "own")).withColumn("side", F.lit(1))
    columns = [c for c in left.columns if c in right.columns] + ["g", "side"]
    return a.select(columns).unionByName(b.select(columns))


# ---------------------------------------------------------------- chosen paths


def chosen_paths(classes: DataFrame, runs: int, seed: int = 7) -> DataFrame:
    """leaf, set, size: the nodes that are to be compared, with their sets; nodes of one set are gone."""
    front = classes.select("set", "sketch", F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run")).select("set", "sketch", F.xxhash64(F.lit(seed), "run").alias("node"), F.lit(1 << 60).alias("up"))
    leaves = None
    for level in range(1, DEPTH + 1):
        at = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(FAN - 1)), lambda j: F.pmod(F.xxhash64("node", j), F.lit(T)).cast("int")))
        kids = front.withColumn("i", F.explode(at)).select("set", "up", F.xxhash64("node", "i", F.substring("sketch", F.col("i") * 3 + 1, F.lit(3))).alias("leaf"))
        sizes = kids.groupBy("leaf").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        found = C.materialise(kids.join(sizes, "leaf"), "nodes")
        done = (F.col("size") <= SMALL) | (2 * F.col("size") > F.col("up")) | F.lit(level == DEPTH)
        now = found.where(done).select("leaf", "set", "size")
        leaves = now if leaves is None else leaves.unionByName(now)
        rest = found.where(~done)
        if rest.isEmpty():
            break
        front = rest.join(classes.select("set", "sketch"), "set").select("set", "sketch", F.col("leaf").alias("node"), F.col("size").alias("up"))
    return leaves


def forest(codes: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Edges that join what agrees in at least so many coordinates.

    One set is compared with all. What it agrees with is joined already and needs no look at each other; all others go
    on, each against all. The first is the one of a few that agrees with most.
    """
    n, edges = len(codes), []
    label = np.arange(n)
    agree = lambda p: np.flatnonzero((codes == codes[p]).sum(1) >= least)
    begin = max(range(0, n, max(1, n // 5)), key=lambda p: len(agree(p)))
    skip = np.zeros(n, bool)
    for p in (begin, *range(n)):
        if skip[p]:
            continue
        hit = agree(p)
        labels, first = np.unique(label[hit], return_index=True)
        for other, at in zip(labels, first):
            if other != label[p]:
                edges.append((p, int(hit[at])))
                label[label == other] = label[p]
        if p == begin:
            skip[hit] = True
    return edges


def _node_edges(table: pa.Table) -> Iterator[pa.RecordBatch]:
    g = table.column("g").to_numpy()
    sets = table.column("set").to_numpy()
    codes = codes_of(table.column("sketch"))
    least = math.ceil(MARGIN * T)
    cut = borders(g)
    size = np.diff(cut)
    left, right = [], []
    for n in np.unique(size[(size > 1) & (size <= 6)]):
        first = cut[:-1][size == n]
        for i in range(n):
            for j in range(i + 1, n):
                a, b = first + i, first + j
                for s in range(0, len(a), 1 << 15):
                    same = (codes[a[s : s + (1 << 15)]] == codes[b[s : s + (1 << 15)]]).sum(1) >= least
                    left.append(a[s : s + (1 << 15)][same])
                    right.append(b[s : s + (1 << 15)][same])
    for at in np.flatnonzero(size > 6):
        found = forest(codes[cut[at] : cut[at + 1]], least)
        if found:
            pair = np.array(found) + cut[at]
            left.append(pair[:, 0])
            right.append(pair[:, 1])
    if left:
        a, b = sets[np.concatenate(left)], sets[np.concatenate(right)]
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _beside_pivot(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Which sets of a block agree with the node's pivot, whose row comes first."""
    g, sets = table.column("g").to_numpy(), table.column("set").to_numpy()
    codes = codes_of(table.column("sketch"))
    cut = borders(g)
    first = np.repeat(cut[:-1], np.diff(cut))
    agrees = (codes == codes[first]).sum(1) >= math.ceil(MARGIN * T)
    yield pa.RecordBatch.from_arrays([table.column("leaf").combine_chunks(), pa.array(sets), pa.array(sets[first]), pa.array(agrees)], ["leaf", "set", "pivot", "agrees"])


def node_edges(leaves: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b: sets that a node holds and whose sketches agree, as a forest for each node."""
    compare = lambda df: df.select("g", "set", "sketch").repartition("g").sortWithinPartitions("g").mapInArrow(C.freed(grouped(_node_edges)), "a long, b long")
    sketched = leaves.join(classes.select("set", "sketch"), "set")
    edges = compare(sketched.where(F.col("size") <= NODE_BLOCK).withColumn("g", F.col("leaf")))
    large = sketched.where(F.col("size") > NODE_BLOCK)
    if leaves.where(F.col("size") > NODE_BLOCK).isEmpty():
        return edges
    blocks = F.ceil(F.col("size") / NODE_BLOCK).cast("int")
    own = F.pmod(F.xxhash64(F.lit(17), "set"), blocks.cast("long")).cast("int")
    heads = large.groupBy("leaf", "size").agg(F.min(F.struct("set", "sketch")).alias("p")).select("leaf", "size", "p.set", "p.sketch", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("own"), F.lit(0).alias("side"))
    rows = large.select("leaf", "size", "set", "sketch", own.alias("own"), F.lit(1).alias("side")).unionByName(heads).withColumn("g", F.xxhash64("leaf", "own"))
    beside = rows.select("g", "side", "leaf", "set", "sketch").repartition("g").sortWithinPartitions("g", "side").mapInArrow(C.freed(grouped(_beside_pivot)), "leaf long, set long, pivot long, agrees boolean")
    beside = C.materialise(beside, "beside-pivots")
    edges = edges.unionByName(beside.where("agrees").select(F.col("set").alias("a"), F.col("pivot").alias("b")))
    # those unlike the pivot, with all of the node
    unlike = beside.where("not agrees").select("leaf", "set").distinct()
    n_unlike = unlike.groupBy("leaf").agg(F.count(F.lit(1)).alias("n_unlike"))
    here = unlike.join(n_unlike, "leaf").join(leaves.select("leaf", "set", "size"), ["leaf", "set"])
    all_ = leaves.where(F.col("size") > NODE_BLOCK).select("leaf", "set", "size").join(n_unlike, "leaf")
    dealt = across(here, all_, "leaf", "n_unlike", "size", NODE_BLOCK)
    return edges.unionByName(compare(dealt.join(classes.select("set", "sketch"), "set")))


# ---------------------------------------------------------------- exact links


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs; each set is sorted and without repeats."""
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    new = np.append(True, tokens[1:] != tokens[:-1])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    column, owner = np.cumsum(np.append(True, np.diff(column[shared]) != 0)) - 1 if shared.any() else column[:0], owner[shared]
    out = np.zeros((n, n), np.float64)
    width = max(256, (1 << 22) // n)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(column, column[at] + width))
        block = np.zeros((n, width), np.float32)
        block[owner[at:to], column[at:to] - column[at]] = 1
        out += block @ block.T
        at = to
    return np.rint(out).astype(np.int64)


LINK_SCHEMA = "set long, links long, root long"


def _exact(threshold: float):
    over, under = round(threshold * 1000), 1000

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        cut = borders(table.column("g").to_numpy())
        ids, copies, side = (table.column(c).to_numpy() for c in ("set", "copies", "side"))
        raw = table.column("tokens")
        rows = []
        for lo, hi in zip(cut[:-1], cut[1:]):
            if hi - lo < 2:
                continue
            sets = [np.frombuffer(raw[i].as_buffer(), np.uint64) for i in range(lo, hi)]
            size = np.array([len(s) for s in sets])
            both = intersections(sets)
            linked = under * both >= over * (size[:, None] + size[None, :] - both)
            np.fill_diagonal(linked, False)
            own = side[lo:hi]
            if own[0] != 2:  # pairs within a block are counted where that block meets itself
                linked &= own[:, None] != own[None, :]
            rows.append((ids[lo:hi], linked @ copies[lo:hi], ids[lo:hi][_roots(linked)]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*rows)], ["set", "links", "root"])

    return grouped(work)


def _roots(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix the first row that it leads to."""
    n = len(linked)
    root, seen = np.arange(n), np.zeros(n, bool)
    for i in range(n):
        if not seen[i]:
            todo = linked[i] & ~seen
            seen[i] = True
            while todo.any():
                seen |= todo
                root[todo] = i
                todo = linked[todo].any(0) & ~seen
    return root


def _reference(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """The tokens that more than half of a group's sample have, and the group's size."""
    cut = borders(table.column("g").to_numpy())
    found = []
    for lo, hi in zip(cut[:-1], cut[1:]):
        tokens, count = np.unique(np.concatenate([np.frombuffer(table.column("tokens")[i].as_buffer(), np.uint64) for i in range(lo, hi)]), return_counts=True)
        found.append(tokens[2 * count > hi - lo].tobytes())
    yield pa.RecordBatch.from_arrays([*(pa.array(table.column(c).to_numpy()[cut[:-1]]) for c in ("g", "size")), pa.array(found, pa.binary())], ["component", "size", "tokens"])


DELTA_SCHEMA = "component long, set long, copies long, cost long, bound long, n int, tokens binary"


def _deltas(threshold: float):
    """Each member's difference from the reference, whose row comes first: its cost, the group's bound, and its tokens."""
    over, under = round(threshold * 1000), 1000

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        cut = borders(table.column("g").to_numpy())
        raw, rows = table.column("tokens"), []
        of, ids, copies = (table.column(c).to_numpy() for c in ("component", "set", "copies"))
        for lo, hi in zip(cut[:-1], cut[1:]):
            reference = np.frombuffer(raw[lo].as_buffer(), np.uint64)
            for i in range(lo + 1, hi):
                own = np.frombuffer(raw[i].as_buffer(), np.uint64)
                delta = np.setxor1d(reference, own, assume_unique=True)
                lacking = (len(delta) + len(reference) - len(own)) // 2
                rows.append((of[i], ids[i], copies[i], under * lacking + over * (len(delta) - lacking), (under - over) * len(reference), len(delta), delta.tobytes()))
        if rows:
            kinds = [pa.int64()] * 5 + [pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], [x.split()[0] for x in DELTA_SCHEMA.split(", ")])

    return grouped(work)


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each token."""
    names = ["component", "set", "is_far"]
    for batch in batches:
        n = batch.column("n").to_numpy(zero_copy_only=False)
        tokens = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), np.int64)
        at = np.repeat(np.arange(batch.num_rows), n)
        yield pa.RecordBatch.from_arrays([pa.array(batch.column(c).to_numpy(zero_copy_only=False)[at]) for c in names] + [pa.array(tokens)], [*names, "token"])


def _unsure(deltas: DataFrame, threshold: float) -> DataFrame:
    """Sets that may have a link beyond the sure ones, by how many tokens of their difference others have too at the most.

    near: a near set that may be linked with a far one; beside: a far set that may be linked with a near one; far: a far
    set that may be linked with another far one. What none of these holds for is settled.
    """
    bonus = 1000 + round(threshold * 1000)
    marked = deltas.withColumn("is_far", 2 * F.col("cost") > F.col("bound"))
    spelled = marked.where("n > 0").select("component", "set", "is_far", "n", "tokens").mapInArrow(C.freed(_spelled), "component long, set long, is_far boolean, token long")
    counts = spelled.groupBy("component", "token").agg(F.count_if("is_far").alias("with_far"), F.count_if(~F.col("is_far")).alias("with_near")).where("with_far > 0 and with_far + with_near > 1")
    shared = spelled.join(counts, ["component", "token"]).groupBy("set").agg(F.count_if(F.col("with_far") > F.col("is_far").cast("int")).alias("by_far"), F.count_if((F.col("with_near") > 0) & F.col("is_far")).alias("by_near"))
    least = marked.groupBy("component").agg(F.min(F.when(F.col("is_far"), F.col("cost"))).alias("least_far"), F.min(F.when(~F.col("is_far"), F.col("cost"))).alias("least_near"))
    may = lambda n, least: F.coalesce(bonus * F.col(n) >= F.col("cost") + F.col(least) - F.col("bound"), F.lit(False))
    told = marked.join(shared, "set").join(least, "component")
    told = told.withColumns({"near": ~F.col("is_far") & may("by_far", "least_far"), "beside": F.col("is_far") & may("by_near", "least_near"), "far": F.col("is_far") & may("by_far", "least_far")})
    return told.where("near or beside or far").select("component", "set", "copies", "cost", "bound", "tokens", "near", "beside", "far")


def _near_far(threshold: float):
    """Links beyond the sure ones, by what differences share: of side 0 with side 1, or of one block with itself (side 2)."""
    bonus = 1000 + round(threshold * 1000)

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        cut = borders(table.column("g").to_numpy())
        ids, copies, side, cost, bound = (table.column(c).to_numpy() for c in ("set", "copies", "side", "cost", "bound"))
        raw, rows = table.column("tokens"), []
        for lo, hi in zip(cut[:-1], cut[1:]):
            own = side[lo:hi]
            if own.min() == own.max() < 2:
                continue
            both = intersections([np.frombuffer(raw[i].as_buffer(), np.uint64) for i in range(lo, hi)])
            c = cost[lo:hi]
            total = c[:, None] + c[None, :]
            linked = (total > bound[lo]) & (total - bonus * both <= bound[lo])
            np.fill_diagonal(linked, False)
            if own[0] != 2:
                linked &= own[:, None] != own[None, :]
            rows.append((ids[lo:hi], linked @ copies[lo:hi], ids[lo:hi][_roots(linked)]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*rows)], ["set", "links", "root"])

    return grouped(work)


def _sure(deltas: DataFrame) -> DataFrame:
    """Links of sets whose costs together are within the bound, from sums over the different costs of a group."""
    values = deltas.groupBy("component", "cost", "bound").agg(F.sum("copies").alias("w"))
    told = values.select("component", F.col("cost").alias("at"), F.lit(0).alias("asks"), "cost", "w")
    asks = values.select("component", (F.col("bound") - F.col("cost")).alias("at"), F.lit(1).alias("asks"), "cost", F.lit(0).cast("long").alias("w"))
    upto = F.sum("w").over(W.partitionBy("component").orderBy("at", "asks").rowsBetween(W.unboundedPreceding, W.currentRow))
    reach = told.unionByName(asks).withColumn("reach", upto).where("asks = 1").select("component", "cost", "reach")
    least = deltas.groupBy("component").agg(F.min(F.struct("cost", "set")).alias("head"))
    m = deltas.join(reach, ["component", "cost"]).join(least, "component")
    links = F.col("reach") - F.when(2 * F.col("cost") <= F.col("bound"), F.col("copies")).otherwise(0)
    root = F.when(F.col("cost") + F.col("head.cost") <= F.col("bound"), F.col("head.set")).otherwise(F.col("set"))
    return m.select("set", links.alias("links"), root.alias("root"))


HELD_SCHEMA = "set long, component long, size int, copies long, tokens binary"
HELD = [x.split()[0] for x in HELD_SCHEMA.split(", ")]


def group_links(held: DataFrame, threshold: float) -> DataFrame:
    """set, links, root: every set's exact links within its group, in one row or more, and a forest of them; held: HELD."""
    send = lambda df, *by: df.repartition("g").sortWithinPartitions("g", *by)
    now, found = held, []
    while True:
        small = F.col("size") <= GROUP_BLOCK
        dealt = in_block_pairs(now.where(small), "component", "set", "size", GROUP_BLOCK).select("g", "set", "side", "copies", "tokens")
        found.append(C.materialise(send(dealt).mapInArrow(C.freed(_exact(threshold)), LINK_SCHEMA), "links"))
        blocks = F.ceil(F.col("size") / GROUP_BLOCK).cast("int")
        large = now.where(~small).withColumn("own", F.pmod(F.xxhash64(F.lit(17), "set"), blocks.cast("long")).cast("int"))
        sample = large.where("own = 0").select(F.col("component").alias("g"), "size", "tokens")
        references = C.materialise(send(sample).mapInArrow(C.freed(grouped(_reference)), "component long, size int, tokens binary"), "references")
        if references.isEmpty():
            return functools.reduce(DataFrame.unionByName, found)
        heads = references.withColumn("own", F.explode(F.sequence(F.lit(0), blocks - 1)))
        none = F.lit(0).cast("long")
        heads = heads.select("component", "own", F.lit(0).alias("side"), none.alias("set"), none.alias("copies"), "tokens")
        rows = large.select("component", "own", F.lit(1).alias("side"), "set", "copies", "tokens").unionByName(heads).withColumn("g", F.xxhash64(F.lit(5), "component", "own"))
        deltas = C.materialise(send(rows.select("g", "side", "component", "set", "copies", "tokens"), "side").mapInArrow(C.freed(_deltas(threshold)), DELTA_SCHEMA), "deltas")
        found.append(C.materialise(_sure(deltas), "links"))
        unsure = C.materialise(_unsure(deltas, threshold), "unsure")
        sizes = unsure.groupBy("component").agg(*[F.count_if(c).cast("int").alias(f"n_{c}") for c in ("near", "beside", "far")])
        sides = across(unsure.where("near").join(sizes, "component"), unsure.where("beside").join(sizes, "component"), "component", "n_near", "n_beside", GROUP_BLOCK)
        found.append(C.materialise(send(sides.select("g", "set", "side", "copies", "cost", "bound", "tokens")).mapInArrow(C.freed(_near_far(threshold)), LINK_SCHEMA), "links"))
        # the far ones among each other: a group of their own where they are the lesser part, else difference with difference
        far = unsure.where("far").join(sizes, "component").join(references.select("component", "size"), "component").where("n_far > 1")
        many = 2 * F.col("n_far") > F.col("size")
        dealt = in_block_pairs(far.where(many).select("component", "set", "copies", "cost", "bound", "tokens", "n_far"), "component", "set", "n_far", GROUP_BLOCK)
        found.append(C.materialise(send(dealt.select("g", "set", "side", "copies", "cost", "bound", "tokens")).mapInArrow(C.freed(_near_far(threshold)), LINK_SCHEMA), "links"))
        rest = large.drop("size").join(far.where(~many).select("set", F.col("n_far").alias("size")), "set")
        now = C.materialise(rest.select(*HELD), "members")
        if now.isEmpty():
            return functools.reduce(DataFrame.unionByName, found)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in C.slices(batches):
        tokens, owner = shingles(*C.buffers(C.flat(batch, "text")))
        order = np.lexsort((tokens, owner))
        tokens = tokens[order]
        ends = np.cumsum(np.bincount(owner, minlength=batch.num_rows)) * 8
        raw, begin = tokens.tobytes(), np.concatenate([[0], ends[:-1]])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in HELD[:-1]), pa.array([raw[a:b] for a, b in zip(begin, ends)], pa.binary())], HELD)


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id (the smallest doc_id that links lead to) and n_links (other documents at the threshold or above)."""
    base = C.texts(docs).withColumn("text_hash", F.xxhash64("text"))
    sketched = C.materialise(base.mapInArrow(C.freed(_sketches), SKETCH_SCHEMA), "sketches")
    with_set = sketched.where("doc_id is not null and set is not null")
    classes = C.materialise(
        with_set.groupBy("set").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.count(F.lit(1)).alias("copies"), F.min("sketch").alias("sketch")), "classes"
    )
    leaves = chosen_paths(classes, runs_for(recall, threshold))
    edges = node_edges(leaves, classes)
    groups = components(edges).withColumnRenamed("node", "set")

    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).cast("int").alias("size"))
    members = C.materialise(groups.join(sizes, "component").join(classes.select("set", "first", "copies"), "set"), "members")
    wanted = members.select("set", "component", "size", "copies", F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash"))
    # the texts move once, whatever the number of sets that are wanted
    tokens = base.join(wanted.hint("merge"), ["doc_id", "text_hash"]).select("set", "component", "size", "copies", "text").mapInArrow(C.freed(_tokens), HELD_SCHEMA)
    links = group_links(C.materialise(tokens.dropDuplicates(["set"]), "tokens"), threshold)

    joined = components(links.select(F.col("set").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("set").agg(F.sum("links").alias("links"))
    of_set = (
        classes.select("set", "copies", F.col("first.doc_id").alias("first_id"))
        .join(counts, "set", "left")
        .join(joined.withColumnRenamed("node", "set"), "set", "left")
        .withColumn("component", F.coalesce("component", "set"))
    )
    heads = of_set.groupBy("component").agg(F.min("first_id").alias("class_id"))
    named = of_set.join(heads, "component").select("set", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    linked = with_set.select("doc_id", "set").join(named, "set").select("doc_id", "class_id", "n_links")
    alone = sketched.where("doc_id is null or set is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return linked.unionByName(alone)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.finished(spark, lambda: jaccard_join(C.table(spark, sf_dir, "documents")), "jaccard-join")


OP2_SQL = """
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * common >= 4 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(v, r) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.v)
SELECT t.doc_id, coalesce((SELECT min(r) FROM reach WHERE v = t.doc_id), t.doc_id) AS class_id, (SELECT count(*) FROM e WHERE a = t.doc_id) AS n_links FROM t"""
