"""Toxic passages as maximum-scoring segments of token log-odds.

Tokens of a bounded sample of labelled documents, each counted once a document,
give log-odds with a Dirichlet prior in proportion to the pooled counts; a
token is evidence where they are large and significant, and where it stands in
many contexts: the words of one toxic text aren't evidence because it was
copied. In a text, evidence scores its log-odds and any
other token a small loss; a linear scan finds all maximal segments. Under the
clean documents' token frequencies, a segment's score has an extreme-value
tail exp(-lambda S), which calibrates segments and, over its length, a document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.llm import _text as X
from tidewrack.llm._scratch import cut

#: Labelled rows of each class that the model is fitted on: the bound of the training sample.
SAMPLE = 40_000
#: Weight of the prior against the counts; least log-odds and least z of evidence.
PRIOR, LEAST_ODDS, LEAST_Z = 0.02, 1.0, 2.0
#: Least share of a token's toxic documents in which its neighbours differ, and least number of such contexts.
LEAST_SPREAD, LEAST_CONTEXTS = 0.3, 3
#: What a token that is no evidence costs.
LOSS = 0.1
#: Greatest expected number of chance segments as good, over one text.
SIGNIFICANCE = 0.01

_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


@dataclass(frozen=True)
class Model:
    """Hashes of evidence, ascending, their scores, and the tail's lambda."""

    tokens: np.ndarray
    scores: np.ndarray
    rate: float


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, byte start and byte end of each run of letters and digits, and each row's first."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, np.zeros(len(offsets), np.int64)
    solid = _LETTER[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:], after[:-1] = ~solid[:-1], ~solid[1:]
    start = np.flatnonzero(solid & (before | edge[:-1]))
    end = np.flatnonzero(solid & (after | edge[1:])) + 1
    return X.span_hashes(data, start, end), start, end, np.searchsorted(start, offsets)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic = batch.column("toxic").to_numpy().astype(bool)
        data, offsets = X.buffers(batch.column("text"))
        found = []
        for lo, hi in X.pieces(offsets):
            h, _, _, first = tokens(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            row = np.repeat(np.arange(lo, hi), np.diff(first))
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            found.append((h[new], toxic[row[new]]))
        if not found:
            continue
        h, of = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
        token, inverse = np.unique(h, return_inverse=True)
        count = lambda m: np.bincount(inverse[m], minlength=len(token))
        yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(count(of)), pa.array(count(~of))], ["token", "y", "n"])


def _context_batches(batches: Iterator[pa.RecordBatch], wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Token and context of each place in a toxic text where one of ``wanted`` stands."""
    for batch in batches:
        data, offsets = X.buffers(batch.column("text"))
        for lo, hi in X.pieces(offsets):
            h, _, _, _ = tokens(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            if not len(h):
                continue
            at = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h)
            side = np.concatenate([[np.uint64(0)], h, [np.uint64(0)]])
            pair = np.unique(np.stack([h[at], X.mix(side[at] + np.uint64(3) * side[at + 2])], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pair[:, k]).view(np.int64)) for k in (0, 1)], ["token", "context"])


def _rate(scores: np.ndarray, chance: np.ndarray) -> float:
    """lambda > 0 with E exp(lambda s) = 1 under the chances of clean text, by bisection."""
    rest = max(1e-12, 1 - chance.sum())
    excess = lambda x: float(chance @ np.exp(x * scores) + rest * np.exp(-x * LOSS) - 1)
    if not len(scores) or float(chance @ scores) - rest * LOSS >= 0:
        return 0.0
    lo, hi = 0.0, 1.0
    while excess(hi) < 0 and hi * scores.max() < 600:
        lo, hi = hi, 2 * hi
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if excess(mid) < 0 else (lo, mid)
    return lo


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on at most about ``sample`` labelled rows of each class, chosen by a hash of their ids.

    Rows with a null id or text, or a label that is neither 0 nor 1, don't
    count; of several labels of an id the greatest counts; without both classes
    the model has no evidence. The sample's ids are broadcast: the bound limits them.
    """
    known = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0)
    part = F.when(F.col("toxic") == 1, min(1.0, sample / sizes[1])).otherwise(min(1.0, sample / sizes[0]))
    known = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < part * float(1 << 30))
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).where("text is not null").join(F.broadcast(known), "id").select("text", "toxic")
    counts = cut(rows.mapInArrow(_count_batches, "token long, y long, n long").groupBy("token").agg(F.sum("y").alias("y"), F.sum("n").alias("n")).where("y + n > 1"))
    total = counts.agg(F.sum("y").alias("y"), F.sum("n").alias("n")).first()
    if not total["y"] or not total["n"]:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0)
    y_all, n_all = float(total["y"]), float(total["n"])
    a = (F.col("y") + F.col("n")) * PRIOR
    a_all = (y_all + n_all) * PRIOR
    odds = F.log((F.col("y") + a) / (y_all + a_all - F.col("y") - a)) - F.log((F.col("n") + a) / (n_all + a_all - F.col("n") - a))
    z = odds / F.sqrt(1 / (F.col("y") + a) + 1 / (F.col("n") + a))
    good = (F.col("odds") >= LEAST_ODDS) & (F.col("z") >= LEAST_Z)
    found = counts.select("token", "y", odds.alias("odds"), z.alias("z"), ((F.col("n") + a) / (n_all + a_all)).alias("chance")).where(good).toArrow()
    token = found.column("token").to_numpy().view(np.uint64)
    order = np.argsort(token)
    token, y, scores, chance = token[order], *(found.column(c).to_numpy()[order] for c in ("y", "odds", "chance"))
    if not len(token):
        return Model(token, scores, 0.0)
    places = rows.where("toxic = 1").select("text").mapInArrow(lambda b: _context_batches(b, token), "token long, context long")
    seen = places.distinct().groupBy("token").count().toArrow()
    contexts = np.zeros(len(token), np.int64)
    contexts[np.searchsorted(token, seen.column("token").to_numpy().view(np.uint64))] = seen.column("count").to_numpy()
    good = contexts >= np.maximum(LEAST_CONTEXTS, LEAST_SPREAD * y)
    token, scores, chance = token[good], scores[good], chance[good]
    return Model(token, scores, _rate(scores, chance))


def maximal_segments(at: np.ndarray, gain: np.ndarray, loss: float = LOSS) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (Ruzzo and Tompa), as first token, last token and score.

    ``at``: positions of the positive tokens, ascending, and ``gain`` their
    scores; each other token scores ``-loss``. Linear in ``len(at)``.
    """
    out: list[list[float]] = []  # first, last, sum before the first, sum up to the last
    total, previous = 0.0, -1
    for p, g in zip(at.tolist(), gain.tolist()):
        total -= loss * (p - previous - 1)
        left, total, previous = total, total + g, p
        item = [p, p, left, total]
        while out:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= item[2]:
                j -= 1
            if j < 0 or out[j][3] >= item[3]:
                break
            item = [out[j][0], item[1], out[j][2], item[3]]
            del out[j:]
        out.append(item)
    return [(int(a), int(b), r - l) for a, b, l, r in out]


def passages(data: np.ndarray, offsets: np.ndarray, model: Model, significance: float = SIGNIFICANCE) -> list[tuple]:
    """Significant segments of all rows: row, first token, last token, byte start, byte end, score, expectation."""
    if not len(model.tokens) or not model.rate or not len(data):
        return []
    h, start, end, first = tokens(data, offsets)
    if not len(h):
        return []
    place = np.minimum(np.searchsorted(model.tokens, h), len(model.tokens) - 1)
    hit = np.flatnonzero(model.tokens[place] == h)
    row = np.searchsorted(first, hit, "right") - 1
    cuts = np.flatnonzero(np.diff(row)) + 1
    out = []
    for group in np.split(np.arange(len(hit)), cuts) if len(hit) else []:
        r = int(row[group[0]])
        n = int(first[r + 1] - first[r])
        for a, b, s in maximal_segments(hit[group] - first[r], model.scores[place[hit[group]]]):
            expected = n * float(np.exp(-model.rate * s))
            if expected <= significance:
                f = int(first[r])
                out.append((r, a, b, int(start[f + a] - offsets[r]), int(end[f + b] - offsets[r]), s, expected))
    return out


def document_p(expected: list[float]) -> float:
    """P value of a document from its passages' expectations, by their sum statistic (Karlin and Altschul, 1993)."""
    r, t = len(expected), -sum(math.log(max(e, 1e-300)) for e in expected)
    least = -math.expm1(-min(expected))
    if r == 1 or t <= 0:
        return least
    return min(least, math.exp(min(0.0, -t + (r - 1) * math.log(t) - math.lgamma(r + 1) - math.lgamma(r))))


_COLUMNS = "passage long, first_token long, last_token long, byte_start long, byte_end long, score double, expected double, p_value double"


def _find_batches(batches: Iterator[pa.RecordBatch], shared, significance: float) -> Iterator[pa.RecordBatch]:
    model: Model = shared.value
    names = ["doc_id", *[c.split()[0] for c in _COLUMNS.split(", ")]]
    for batch in batches:
        data, offsets = X.buffers(batch.column("text"))
        for lo, hi in X.pieces(offsets):
            found = passages(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], model, significance)
            if not found:
                continue
            row = np.array([f[0] for f in found])
            begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            many = np.diff(np.append(begin, len(row)))
            number = np.arange(len(row)) - np.repeat(begin, many) + 1
            whole = np.repeat([document_p([f[6] for f in found[b : b + m]]) for b, m in zip(begin, many)], many)
            columns = [pa.array(np.array([f[k] for f in found])) for k in range(1, 5)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + lo)), pa.array(number), *columns, pa.array(np.round([f[5] for f in found], 6)), pa.array(np.array([f[6] for f in found])), pa.array(whole)], names)


def toxic_passages(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", significance: float = SIGNIFICANCE, model: Model | None = None) -> DataFrame:
    """Every significant toxic passage of every document, numbered in its text.

    Columns: ``doc_id``; ``passage``, ``first_token``, ``last_token``,
    ``byte_start``, ``byte_end``; ``score``; ``expected``, how many chance
    segments of this score a clean text of the length would have; ``p_value``
    of the document, from all its passages together. A document without a row
    has no significant passage; so have null and empty texts. Repeated rows are
    each reported. Without labels of both classes there are no rows.
    """
    model = model or train(docs, labels, id_col, text_col, label_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda b: _find_batches(b, shared, significance), f"doc_id {kind}, {_COLUMNS}")
