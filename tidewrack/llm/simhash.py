"""SimHash near-duplicate removal by segment-popcount embedding.

Each document has a 128-bit SimHash of all its words and pairs of neighbouring
words, weighted by the root of their counts. The fingerprint is cut into 64
segments of two bits, and the counts of set bits per segment embed it in a grid
{0, 1, 2}^64. Flipping one bit moves one count by one, so the Manhattan
distance of two embeddings never exceeds the Hamming distance.

The range join is exact. Of two points within ``most`` bits, the lower half of
the fingerprint is within ``h = most // 2``, or the upper one within ``most - h
- 1``. A half is cut into parts whose limits add up to its own less their
number, plus one: were all of them exceeded, so would be the half's. A part of
limit ``t`` is cut into ``t + r`` blocks, of which at least ``r`` agree, in
counts and in bits. So there is a grid for each part and each choice of ``r``
of its blocks, whose cells are the values of those blocks: every pair meets in
one of them. Points of a cell are compared by the half that the grid doesn't
look at, then by both. ``r`` grows with the number of points, weighing rows
against comparisons; the result doesn't depend on it. A small cell gives each
of its pairs once, in the first grid where they meet; a larger one gives a
forest that connects what its pairs connect, and leaves out those that the
largest group connects already, so a cell full of copies costs a few passes and
a star of edges.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidewrack.llm import _text as X
from tidewrack.llm._graph import components
from tidewrack.llm._rows import fresh, key, narrow
from tidewrack.llm._scratch import cut

#: Greatest Hamming distance of a near copy, of 128 bits.
DISTANCE = 20
#: Weights of a word and of a pair of words that stand once.
WORD, PAIR = 16, 8
#: Chance that a bit of two unlike texts agrees, a little over a half as common words and languages lean.
AGREE = 0.55
#: Comparisons that cost as much as a row that is shuffled, by measurement.
ROW = 800
#: Points of a cell whose pairs are listed; larger cells are compared in blocks of this many rows.
SMALL = 64
#: Points that such a block is compared with at once: what a processor's cache holds.
TILE = 4096

_EVEN = 0x5555555555555555
_SPREAD = np.array([int.from_bytes(bytes(v >> b & 1 for b in range(8)), "little") for v in range(256)], np.uint64)


def _votes(features: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per row and bit, how many of the row's 64-bit features have it set; rows must not be empty."""
    many = np.diff(first)
    blocks = (many + 254) // 255
    at = np.cumsum(blocks) - blocks
    begin = np.repeat(first[:-1], blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(at, blocks))
    lanes = _SPREAD[features.view(np.uint8).reshape(-1, 8)]
    return np.add.reduceat(np.add.reduceat(lanes, begin, axis=0).view(np.uint8).reshape(-1, 64), at, axis=0, dtype=np.int64)


def _counted(features: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different features of each row, their rows and counts."""
    # a slice has fewer than 2**21 rows with words, so 43 bits are left to tell a row's features apart
    joint = row.astype(np.uint64) << np.uint64(43) | features >> np.uint64(21)
    order = np.argsort(joint)
    features, row, joint = features[order], row[order], joint[order]
    new = np.ones(len(features), bool)
    new[1:] = joint[1:] != joint[:-1]
    at = np.flatnonzero(new)
    return features[at], row[at], np.diff(np.append(at, len(features)))


def simhash(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have words, and their fingerprints as (rows, 2) ``uint64``."""
    start, end, first = X.word_spans(data, offsets)
    words = X.span_hashes(data, start, end)
    rows = np.flatnonzero(np.diff(first))
    row = np.repeat(np.arange(len(rows)), np.diff(first)[rows])
    if not len(rows):
        return rows, np.zeros((0, 2), np.uint64)
    votes, total = np.zeros((len(rows), 128), np.int64), np.zeros(len(rows), np.int64)
    near = row[1:] == row[:-1]
    pairs = X.mix(words[:-1] * np.uint64(3) + words[1:])[near]
    for features, of, unit in ((words, row, WORD), (pairs, row[1:][near], PAIR)):
        if not len(features):
            continue
        features, of, count = _counted(features, of)
        to, at = np.unique(of, return_index=True)
        at = np.append(at, len(of))
        weight = np.rint(unit * np.sqrt(count)).astype(np.int64)
        total[to] += np.add.reduceat(weight, at[:-1])
        more = np.flatnonzero(weight > unit)
        owner = of[more]
        begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(more) else more
        for half in (0, 1):
            hashes = X.mix(features + np.uint64(half + 1))
            votes[to, 64 * half : 64 * half + 64] += unit * _votes(hashes, at)
            if len(more):
                bits = np.unpackbits(hashes[more].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)
                bits *= (weight[more] - unit).astype(np.int32)[:, None]
                votes[owner[begin], 64 * half : 64 * half + 64] += np.add.reduceat(bits, begin, axis=0)
    return rows, np.packbits(2 * votes > total[:, None], axis=1, bitorder="little").view(np.uint64)


_PRINTS = T.StructType([T.StructField(n, T.LongType()) for n in ("k1", "k2", "lo", "hi")])


def _print_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = X.buffers(batch.column("text"))
        for a, b in X.pieces(offsets):
            rows, prints = simhash(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            take = pa.array(rows + a)
            prints = np.ascontiguousarray(prints.T).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column("k1").take(take), batch.column("k2").take(take), pa.array(prints[0]), pa.array(prints[1])], ["id", "k1", "k2", "lo", "hi"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns ``id``, ``k1``, ``k2`` (row key) and ``lo``, ``hi`` (fingerprint); rows without words have none."""
    rows = narrow(docs, id_col, text_col)
    k1, k2 = key(rows["id"], rows["text"])
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), *_PRINTS.fields])
    return rows.select("id", k1.alias("k1"), k2.alias("k2"), "text").mapInArrow(_print_batches, schema)


def grids(points: int, most: int = DISTANCE) -> int:
    """Blocks that make a cell: those of the least cost, of rows and of comparisons. Pairs are found with any number."""

    def cost(r: int) -> float:
        masks, chosen = blocks(most, r)
        bits = np.bitwise_count(masks).tolist()
        return sum(ROW + points / 2 * AGREE ** sum(bits[b] for b in c) for c in chosen)

    r = 1
    while r < 6 and cost(r + 1) < cost(r):
        r += 1
    return r


@cache
def _parts(most: int, r: int) -> list[tuple[int, int]]:
    """Limit and bits of each part of a half: as many parts as measured best, bits in proportion to what blocks they hold."""
    half = most // 2
    many = min(4 if r < 3 else 3, half + 1)
    left = half - many + 1
    limits = [left // many + (k < left % many) for k in range(many)]
    weight = np.cumsum([0, *(t + r for t in limits)])
    ends = np.rint(64 * weight / weight[-1]).astype(int).tolist()
    return [(t, b - a) for t, a, b in zip(limits, ends, ends[1:])]


@cache
def blocks(most: int, r: int) -> tuple[np.ndarray, list[tuple[int, ...]]]:
    """Masks of the blocks of a half, part by part, and the choices of ``r`` of a part's."""
    masks, chosen, begin = [], [], 0
    for t, size in _parts(most, r):
        ends = [begin + k * size // (t + r) for k in range(t + r + 1)]
        chosen += combinations(range(len(masks), len(masks) + t + r), r)
        masks += [(1 << b) - (1 << a) for a, b in zip(ends, ends[1:])]
        begin += size
    return np.array(masks, np.uint64), chosen


def _spare(most: int, half: int) -> bool:
    """Whether a half does without the choices that hold its first block: its limit, and so that of its first part, is less by one."""
    return half == 1 and most - most // 2 - 1 < most // 2


def _first_grid(x: np.ndarray, y: np.ndarray, most: int, r: int) -> np.ndarray:
    """Number of the first grid that pairs share, by the differing bits ``x`` and ``y`` of their halves."""
    masks, chosen = blocks(most, r)
    number = {sum(1 << b for b in c): k for k, c in enumerate(chosen)}
    sizes = [t + r for t, _ in _parts(most, r)]
    out = np.full(len(x), -1, np.int64)
    for k in (1, 0):
        v = (x, y)[k]
        equal = np.zeros(len(v), np.int64)
        for b, m in enumerate(masks):
            if b or not _spare(most, k):
                equal |= ((v & m) == 0).astype(np.int64) << b
        for p in reversed(range(len(sizes))):
            begin = sum(sizes[:p])
            low, left = np.zeros(len(v), np.int64), equal & ((1 << begin + sizes[p]) - (1 << begin))
            for _ in range(r):
                bit = left & -left
                low, left = low | bit, left ^ bit
            enough = np.bitwise_count(low) == r
            keys, inverse = np.unique(low[enough], return_inverse=True)
            out[enough] = np.array([number[c] + k * len(chosen) for c in keys.tolist()], np.int64)[inverse]
    return out


def _near(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Rows whose fingerprints (n, 2) are within ``most`` bits of each other."""
    even = np.uint64(_EVEN)
    one = np.uint64(1)
    x = (a - (a >> one & even)) ^ (b - (b >> one & even))
    odd = x & even
    manhattan = np.bitwise_count(odd).sum(1) + 2 * np.bitwise_count((x >> one & even) & ~odd).sum(1, dtype=np.int64)
    good = manhattan <= most
    good[good] = np.bitwise_count(a[good] ^ b[good]).sum(1) <= most
    return good


def _forest(prints: np.ndarray, half: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of one cell that connect exactly the points that its near pairs connect; ``half``: the one to compare first."""
    m = len(prints)
    other = np.ascontiguousarray(prints[:, half])
    label = np.arange(m)
    tails, heads = [], []

    def join(i: int, near: np.ndarray) -> None:
        near = near[label[near] != label[i]]
        if len(near):
            labels, at = np.unique(label[near], return_index=True)
            tails.append(np.full(len(at), i))
            heads.append(near[at])
            known = np.zeros(m, bool)
            known[labels] = True
            label[known[label]] = label[i]

    free = np.ones(m, bool)
    while free.any():  # leaders, as long as each of them brings many
        i = int(free.argmax())
        near = np.flatnonzero(np.bitwise_count(other ^ other[i]) <= most)
        near = near[_near(np.broadcast_to(prints[i], (len(near), 2)), prints[near], most)]
        brought = int(free[near].sum())
        free[near] = False
        join(i, near)
        if 8 * brought < m:
            break
    most_points = np.bincount(label, minlength=m)
    giant = int(most_points.argmax())
    inside = label == giant if most_points[giant] > 1 else np.zeros(m, bool)
    order = np.concatenate([np.flatnonzero(~inside), np.flatnonzero(inside)])
    rows = int((~inside).sum())
    x, y = other[order], prints[order, 1 - half]
    for lo in range(0, rows, SMALL):
        hi = min(lo + SMALL, rows)
        for left in range(lo + 1, m, TILE):
            right = min(m, left + TILE)
            a, b = np.divmod(np.flatnonzero(np.bitwise_count(x[lo:hi, None] ^ x[None, left:right]) <= most), right - left)
            a, b = a + lo, b + left
            good = np.bitwise_count(x[a] ^ x[b]) + np.bitwise_count(y[a] ^ y[b]) <= most
            a, b = order[a[good]], order[b[good]]
            good = label[a] != label[b]
            a, b = a[good], b[good]
            good = _near(prints[a], prints[b], most)
            a, b = a[good], b[good]
            cuts = np.flatnonzero(np.diff(a)) + 1
            for i, near in zip(a[np.append(0, cuts)].tolist() if len(a) else [], np.split(b, cuts)):
                join(i, near)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *tails]), np.concatenate([none, *heads])


def link(cell: np.ndarray, prints: np.ndarray, most: int, r: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of points sorted by cell, see the module; the upper bits of a cell are its grid's number."""
    size = len(cell)
    begin = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if size else np.zeros(0, np.int64)
    many = np.diff(np.append(begin, size))
    grid = cell >> _SHIFT
    per_half = len(blocks(most, r)[1])
    tails, heads = [], []
    for b, m in zip(begin[many > SMALL].tolist(), many[many > SMALL].tolist()):
        x, y = _forest(prints[b : b + m], 1 if grid[b] < per_half else 0, most)
        tails.append(x + b)
        heads.append(y + b)
    small = (many > 1) & (many <= SMALL)
    begin, many = begin[small], many[small]
    point = np.arange(many.sum()) + np.repeat(begin - (np.cumsum(many) - many), many)
    after = np.repeat(begin + many, many) - 1 - point
    total = np.concatenate([[0], np.cumsum(after)])
    lo = 0
    while lo < len(point):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + (1 << 20), "right")) - 1)
        n = after[lo:hi]
        a = np.repeat(point[lo:hi], n)
        b = a + 1 + np.arange(len(a)) - np.repeat(total[lo:hi] - total[lo], n)
        good = np.bitwise_count(prints[a, 1] ^ prints[b, 1]) <= most
        a, b = a[good], b[good]
        good = _near(prints[a], prints[b], most)
        a, b = a[good], b[good]
        apart = prints[a] ^ prints[b]
        once = _first_grid(apart[:, 0], apart[:, 1], most, r) == grid[a]
        tails.append(a[once])
        heads.append(b[once])
        lo = hi
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *tails]), np.concatenate([none, *heads])


#: Bits of a cell below the number of its grid.
_SHIFT = 48


def _link_batches(batches: Iterator[pa.RecordBatch], most: int, r: int) -> Iterator[pa.RecordBatch]:
    def edges(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        cell, prints = (np.concatenate(x) for x in zip(*parts))
        a, b = link(cell, prints, most, r)
        pair = np.concatenate([prints[a], prints[b]], axis=1)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).view(np.int64)) for c in pair.T], ["a_lo", "a_hi", "b_lo", "b_hi"])

    kept: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cell = batch.column("cell").to_numpy()
        prints = np.stack([batch.column(c).to_numpy().view(np.uint64) for c in ("lo", "hi")], axis=1)
        last = int(np.searchsorted(cell, cell[-1]))
        if last or (kept and kept[-1][0][-1] != cell[0]):
            kept.append((cell[:last], prints[:last]))
            yield edges(kept)
            kept = []
        kept.append((cell[last:], prints[last:]))
    if kept:
        yield edges(kept)


def near_pairs(prints: DataFrame, most: int = DISTANCE, r: int | None = None) -> DataFrame:
    """Edges between distinct fingerprints (``a_lo a_hi b_lo b_hi``), all within ``most`` bits.

    They connect exactly the fingerprints that all such pairs connect.
    """
    points = cut(prints.select("lo", "hi").distinct())
    if r is None:
        r = grids(points.count(), most)
    masks, chosen = blocks(most, r)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    every = [(half * len(chosen) + t, half, signed(sum(int(masks[b]) for b in c))) for half in (0, 1) for t, c in enumerate(chosen) if 0 not in c or not _spare(most, half)]
    every = F.array(*[F.struct(F.lit(t).cast("long").alias("t"), F.lit(m if half == 0 else 0).cast("long").alias("lo"), F.lit(m if half == 1 else 0).cast("long").alias("hi")) for t, half, m in every])
    cell = F.xxhash64("g.t", F.col("lo").bitwiseAND(F.col("g.lo")), F.col("hi").bitwiseAND(F.col("g.hi")))
    cell = cell.bitwiseAND(F.lit((1 << _SHIFT) - 1)) + F.shiftleft("g.t", _SHIFT)
    # few bytes become many rows: tasks aren't counted by the bytes that AQE would merge them by
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = points.repartition(tasks, "lo", "hi").select(F.explode(every).alias("g"), "lo", "hi").select(cell.alias("cell"), "lo", "hi")
    rows = rows.repartition("cell").sortWithinPartitions("cell", "lo", "hi")
    return rows.mapInArrow(lambda b: _link_batches(b, most, r), "a_lo long, a_hi long, b_lo long, b_hi long").distinct()


def _grouped(docs: DataFrame, id_col: str, text_col: str, most: int, r: int | None) -> DataFrame:
    """Fingerprinted rows in groups of two or more: ``id k1 k2 rank keeper``."""
    prints = cut(fingerprints(docs, id_col, text_col))
    pairs = near_pairs(prints, most, r)
    labels = components(pairs.select(F.xxhash64("a_lo", "a_hi").alias("a"), F.xxhash64("b_lo", "b_hi").alias("b")))
    rows = prints.withColumn("node", F.xxhash64("lo", "hi")).join(labels, "node", "left").withColumn("group", F.coalesce("label", "node"))
    near = Window.partitionBy("group").orderBy(F.col("id").asc_nulls_last(), "k1", "k2")
    rows = rows.select("id", "k1", "k2", "group").withColumn("rank", F.row_number().over(near))
    every = Window.partitionBy("group").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("keeper", F.first("id").over(every))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = DISTANCE, r: int | None = None) -> DataFrame:
    """Rows to remove: ``doc_id`` and ``keeper_id``, the row of its group that stays.

    A group is what a chain of pairs within ``most`` bits connects, and no such
    pair is missed; its least id stays (a null id only where there is no other). Repeated rows are a
    group of their own, of which one stays. Texts that are null, empty or only
    white space have no fingerprint and are in no group. An empty table gives
    no rows. Extra columns are ignored, whatever their names.
    """
    return _grouped(docs, id_col, text_col, most, r).where("rank > 1").select(F.col("id").alias("doc_id"), F.col("keeper").alias("keeper_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = DISTANCE, r: int | None = None) -> DataFrame:
    """``docs`` without the rows that :func:`near_duplicates` names; same columns.

    Of rows that agree in id and text, as many go as are to be removed.
    """
    gone = _grouped(docs, id_col, text_col, most, r).groupBy("k1", "k2").agg(F.count(F.when(F.col("rank") > 1, 1)).alias("gone"), F.count("*").alias("all"))
    gone = gone.where("gone > 0")
    a, b, n, r = fresh(docs, "k1", "k2", "gone", "turn")
    k1, k2 = key(docs[id_col], docs[text_col].cast("string"))
    keyed = docs.withColumns({a: k1, b: k2})
    rows = keyed.join(gone.select(F.col("k1").alias(a), F.col("k2").alias(b), F.col("gone").alias(n)), [a, b], "left")
    rows = rows.withColumn(r, F.row_number().over(Window.partitionBy(a, b).orderBy(F.lit(0))))
    return rows.where(F.col(n).isNull() | (F.col(r) > F.col(n))).select(*docs.columns)
