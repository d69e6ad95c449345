"""Sampled segmentations by forward filtering and backward sampling.

The vocabulary is that of a SentencePiece model, read from its file, and the
lattice is the whole one: all of its pieces, wherever they match. A text is cut
into units between two bytes that no piece has side by side, so no piece could
cross a cut. For every different unit the lattice is built once, forward sums
give the probability of each piece at each end, and every occurrence then draws
its pieces backwards from its end. All draws come from a hash of the row's key
and the place in the text, so a row's sample depends on nothing else.

A piece's weight is ``exp(sharpness * score)`` where the model's scores are log
probabilities. The scores of a BPE model are ranks, and its pieces weigh
``(rank + 3) ** -sharpness``. Characters that no piece covers become byte
pieces, so does the mark that stands for a space; decoding is therefore lossless.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewrack.llm import _text as X

#: Exponent of the weights: greater is nearer to the best segmentation.
SHARPNESS = 1.0
SEED = 0
#: Bytes of different units whose lattices a worker keeps.
KEPT_BYTES = 1 << 20
#: Bytes of units whose lattices are built at a time.
ADDED_BYTES = 1 << 17
_MARK = "▁".encode()


class Vocabulary:
    """Pieces of a model as byte strings, and a hash table of them for numpy."""

    def __init__(self, path: str, sharpness: float = SHARPNESS):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = model.get_piece_size()
        order = sorted((i for i in range(count) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))), key=lambda i: (-model.get_score(i), i))
        usual = set(order)
        self.byte = np.full(256, -1, np.int64)
        self.text: dict[int, bytes] = {}
        found: dict[bytes, int] = {}
        for i in range(count):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                b = int(piece[3:5], 16)
                self.byte[b] = i
                self.text[i] = bytes([b])
            elif i in usual:
                raw = piece.encode().replace(_MARK, b" ")
                found[raw] = i
                self.text[i] = raw
        if (self.byte < 0).any():
            raise ValueError("the model has no byte pieces, so it can't encode every text")
        self.weight = np.zeros(count)  # logarithms
        scores = np.array([model.get_score(i) for i in order])
        ranks = bool((scores == np.rint(scores)).all())
        self.weight[order] = -sharpness * np.log(np.arange(len(order)) + 3.0) if ranks else sharpness * scores
        self.weight[self.byte] = -sharpness * np.log(count + 3.0) if ranks else sharpness * (scores.min() - 10.0)
        #: Bytes that stand side by side within a piece.
        self.inner = np.zeros((256, 256), bool)
        for piece in found:
            raw = np.frombuffer(piece, np.uint8)
            self.inner[raw[:-1], raw[1:]] = True
        self.inner[:, 0x80:0xC0] = True  # a character is never cut
        self.longest = max(map(len, found))
        self.single = {p for p in found if len(p.decode()) == 1}
        self.pieces = found
        flat = np.frombuffer(b"".join(found), np.uint8)
        ends = np.cumsum([len(p) for p in found])
        hashes = X.span_hashes(flat, ends - [len(p) for p in found], ends, X.PLAIN)
        ids = np.array(list(found.values()), np.int64)
        self.bits = 18
        self.table = np.full(1 << self.bits, -1, np.int64)  # open addressing, by linear probing
        self.keys = np.zeros(1 << self.bits, np.uint64)
        for h, i in zip(hashes.tolist(), ids.tolist()):
            at = h >> (64 - self.bits)
            while self.table[at] >= 0:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.table[at], self.keys[at] = i, h
        self.lengths = np.unique(ends - np.concatenate([[0], ends[:-1]]))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece of each hash, -1 where there is none."""
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.full(len(hashes), -1, np.int64)
        left = np.arange(len(hashes))
        while len(left):
            piece = self.table[at[left]]
            here = (self.keys[at[left]] == hashes[left]) & (piece >= 0)
            out[left[here]] = piece[here]
            left = left[(piece >= 0) & ~here]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str, sharpness: float = SHARPNESS) -> Vocabulary:
    """The vocabulary of a model file; kept by each worker."""
    return Vocabulary(path, sharpness)


class Lattices:
    """Backward tables of units: a state is a place in a unit, its choices are the pieces that end there."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)  # of units, ascending
        self.last = np.zeros(0, np.int64)  # each unit's final state
        self.begin = np.zeros(1, np.int32)  # each state's first choice
        self.chance = np.zeros(0, np.float32)  # cumulated probability of a state's choices
        self.back = np.zeros(0, np.int32)  # state that the choice comes from, -1 at the unit's begin
        self.piece = np.zeros(0, np.int32)
        self.bytes = 0

    def states(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Final state of each unit; lattices of new ones are built."""
        if self.bytes > KEPT_BYTES:
            self.clear()
        different, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, different)
        known = np.zeros(len(different), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == different[inside]
        if not known.all():
            new = first[~known]
            sizes = np.concatenate([[0], np.cumsum(end[new] - start[new])])
            for lo, hi in X.pieces(sizes, ADDED_BYTES):
                self._add(data, start[new[lo:hi]], end[new[lo:hi]], different[~known][lo:hi])
            at = np.searchsorted(self.hashes, different)
        return self.last[at][inverse]

    def _add(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> None:
        size = end - start
        off = np.concatenate([[0], np.cumsum(size)])
        index = np.arange(off[-1]) + np.repeat(start - off[:-1], size)
        flat = data[index]
        unit = np.repeat(np.arange(len(size)), size)
        stop = np.repeat(off[1:], size)
        here = np.arange(len(flat))
        froms, tos, ids = [], [], []
        covered = np.zeros(len(flat), bool)
        lead = (flat & 0xC0) != 0x80
        wide = np.where(flat < 0x80, 1, np.where(flat < 0xE0, 2, np.where(flat < 0xF0, 3, 4)))
        for n in self.vocab.lengths.tolist():
            at = np.flatnonzero(lead & (here + n <= stop))
            if not len(at):
                continue
            piece = self.vocab.find(X.span_hashes(flat, at, at + n, X.PLAIN))
            good = piece >= 0
            at, piece = at[good], piece[good]
            froms.append(at)
            tos.append(at + n)
            ids.append(piece)
            one = wide[at] == n
            covered[at[one]] = True
        # characters without a piece of their own are bytes
        char = np.cumsum(lead) - 1
        bare = ~covered[np.flatnonzero(lead)][char] if len(flat) else covered
        at = np.flatnonzero(bare)
        froms.append(at)
        tos.append(at + 1)
        ids.append(self.vocab.byte[flat[at]])
        a, b, p = np.concatenate(froms), np.concatenate(tos), np.concatenate(ids)
        depth = b - off[unit[b - 1]]
        order = np.lexsort((p, a, depth))
        a, b, p, depth = a[order], b[order], p[order], depth[order]
        # forward sums, place by place; each place's are scaled by the greatest so far in its unit
        log = np.full(len(flat) + 1, -np.inf)  # by end position; a unit's begin counts as 0
        fresh = np.zeros(len(flat) + 1, bool)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(depth)) + 1, [len(a)]]) if len(a) else np.zeros(1, np.int64)
        fresh[off[:-1]] = True
        weight = self.vocab.weight[p]
        share = np.empty(len(a))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            x = np.where(fresh[a[lo:hi]], 0.0, log[a[lo:hi]]) + weight[lo:hi]
            by = np.argsort(b[lo:hi], kind="stable")
            x, to = x[by], b[lo:hi][by]
            begin = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            most = np.maximum.reduceat(x, begin)
            many = np.diff(np.append(begin, len(x)))
            e = np.exp(x - np.repeat(most, many))
            total = np.add.reduceat(e, begin)
            ends = to[begin]
            inner = ends < off[unit[ends - 1] + 1]
            log[ends[inner]] = (most + np.log(total))[inner]
            share[lo + by] = e / np.repeat(total, many)
        # choices by end; states are numbered by byte, after those that are there
        base = len(self.begin) - 1
        order = np.lexsort((a, b))
        a, b, p, share = a[order], b[order], p[order], share[order]
        count = np.bincount(b - 1, minlength=len(flat))
        begin = np.concatenate([[0], np.cumsum(count)])
        total = np.cumsum(share)
        before = np.concatenate([[0.0], total])[begin[:-1]]
        state = b - 1
        cumulated = np.minimum(total - before[state], 1.0)
        cumulated[begin[1:][count > 0] - 1] = 1.0
        self.back = np.concatenate([self.back, np.where(a == off[unit[b - 1]], -1, base + a - 1).astype(np.int32)])
        self.piece = np.concatenate([self.piece, p.astype(np.int32)])
        self.chance = np.concatenate([self.chance, cumulated.astype(np.float32)])
        self.begin = np.concatenate([self.begin, (self.begin[-1] + begin[1:]).astype(np.int32)])
        self.hashes = np.concatenate([self.hashes, hashes])
        self.last = np.concatenate([self.last, base + off[1:] - 1])
        order = np.argsort(self.hashes)
        self.hashes, self.last = self.hashes[order], self.last[order]
        self.bytes += len(flat)

    def draw(self, final: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of each unit, in order, and each unit's first; ``seeds``: one number a unit."""
        unit = np.arange(len(final))
        state, steps, owners = final, [], []
        n = 0
        while len(unit):
            n += 1
            turn = np.uint64(n * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            point = (X.mix(seeds[unit] + turn) >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
            choice = self.begin[state]
            left = np.flatnonzero(self.chance[choice] <= point)
            stop = self.begin[state + 1] - 1
            left = left[choice[left] < stop[left]]
            while len(left):
                choice[left] += 1
                left = left[(self.chance[choice[left]] <= point[left]) & (choice[left] < stop[left])]
            steps.append(self.piece[choice])
            owners.append(unit)
            state = self.back[choice]
            on = state >= 0
            unit, state = unit[on], state[on]
        many = np.zeros(len(final), np.int64)
        for o in owners:
            many[o] += 1
        first = np.concatenate([[0], np.cumsum(many)])
        out = np.empty(first[-1], np.int32)
        for k, (o, s) in enumerate(zip(owners, steps)):
            out[first[o + 1] - 1 - k] = s
        return out, first


_kept: dict[tuple[str, float], Lattices] = {}


def encode_rows(data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, lattices: Lattices) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all rows and each row's first; ``keys``: one number a row, its seed."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    cut = np.zeros(n, bool)
    cut[1:] = ~lattices.vocab.inner[data[:-1], data[1:]]
    cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    start = np.flatnonzero(cut)
    end = np.append(start[1:], n)
    final = lattices.states(data, start, end, X.span_hashes(data, start, end, X.PLAIN))
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    seeds = X.mix(keys[row] + X.mix((start - offsets[row]).astype(np.uint64) + np.uint64(1)))
    ids, at = lattices.draw(final, seeds)
    return ids, at[first]


def _lattices(path: str, sharpness: float) -> Lattices:
    if (path, sharpness) not in _kept:
        _kept[path, sharpness] = Lattices(vocabulary(path, sharpness))
    return _kept[path, sharpness]


def _encode_batches(batches: Iterator[pa.RecordBatch], path: str, sharpness: float) -> Iterator[pa.RecordBatch]:
    lattices = _lattices(path, sharpness)
    for batch in batches:
        data, offsets = X.buffers(batch.column("text"))
        keys = batch.column("seed").to_numpy().view(np.uint64)
        null = batch.column("text").is_null().to_numpy(zero_copy_only=False)
        for lo, hi in X.pieces(offsets):
            ids, first = encode_rows(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], keys[lo:hi], lattices)
            pieces = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids), mask=pa.array(null[lo:hi]))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pieces, pa.array(np.diff(first))], ["doc_id", "pieces", "n_pieces"])


def sample_encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, sharpness: float = SHARPNESS) -> DataFrame:
    """A sampled segmentation of each row: ``doc_id``, ``pieces`` (ids) and ``n_pieces``.

    The sample is a function of the row's id, ``seed`` and the text, on any
    cluster. Null texts have null pieces and none counted, empty ones an empty
    list; rows with one id and text have one segmentation, and null ids share a
    seed. Characters outside the vocabulary are bytes; texts may be of any length.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(F.lit(seed), docs[id_col].isNull(), docs[id_col]).alias("seed"), docs[text_col].cast("string").alias("text"))
    kind = T.StructField("doc_id", rows.schema["doc_id"].dataType)
    schema = T.StructType([kind, T.StructField("pieces", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType())])
    return rows.mapInArrow(lambda b: _encode_batches(b, model_path, sharpness), schema)


def _decode_batches(batches: Iterator[pa.RecordBatch], path: str, index: int) -> Iterator[pa.RecordBatch]:
    vocab = vocabulary(path)
    size = len(vocab.weight)
    raw = [vocab.text.get(i, b"") for i in range(size)]
    length = np.array([len(x) for x in raw])
    offset = np.concatenate([[0], np.cumsum(length)])
    flat = np.frombuffer(b"".join(raw), np.uint8)
    for batch in batches:
        lists = batch.column(index)
        ids = lists.flatten().to_numpy().astype(np.int64)
        many = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
        to = np.concatenate([[0], np.cumsum(length[ids])])
        data = flat[np.arange(to[-1]) + np.repeat(offset[ids] - to[:-1], length[ids])]
        ends = to[np.concatenate([[0], np.cumsum(many)])]
        text = pa.Array.from_buffers(pa.string(), len(lists), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
        if lists.null_count:
            text = pc.if_else(lists.is_null(), pa.scalar(None, pa.string()), text)
        yield pa.RecordBatch.from_arrays([*[c for k, c in enumerate(batch.columns) if k != index], text], [*[n for k, n in enumerate(batch.schema.names) if k != index], "text"])


def decode(encoded: DataFrame, model_path: str, pieces_col: str = "pieces") -> DataFrame:
    """``encoded`` with ``text`` instead of ``pieces``: exactly the text that was encoded.

    Null pieces give null, an empty list the empty text. A column called
    ``text`` beside the pieces would clash and is refused.
    """
    rest = [f for f in encoded.schema.fields if f.name != pieces_col]
    if any(f.name.lower() == "text" for f in rest):
        raise ValueError("the table already has a column called text")
    index = encoded.columns.index(pieces_col)
    return encoded.mapInArrow(lambda b: _decode_batches(b, model_path, index), T.StructType([*rest, T.StructField("text", T.StringType())]))
