"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of a bounded sample of labelled rows; the result is a
matrix of log probabilities, buckets x languages, whose size the parameters
bound, and the languages' shares as prior. It is broadcast, and each batch of texts is scored by gathering its
n-grams' rows and summing them per text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.llm import _text as X
from tidewrack.llm._rows import fresh, key

#: Rows of each language that the model is fitted on, about: the bound of the training sample.
SAMPLE = 20_000
#: Languages of a model, at most; of more the most frequent are learned.
LANGUAGES = 256
BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
#: Least lead of the best language, in nats per n-gram, to accept it.
MARGIN = 0.02


@dataclass(frozen=True)
class Model:
    """Languages in order, the log-probability matrix (buckets, languages), and the languages' log shares of the labelled rows."""

    languages: tuple[str, ...]
    table: np.ndarray
    prior: np.ndarray


def _letters() -> np.ndarray:
    """Code points below 0x500 to lower case; anything but a letter to a space."""
    return np.array([ord(c.lower()[0]) if c.isalpha() else 32 for c in map(chr, range(0x500))], np.uint32)


_FOLD = _letters()


def grams(column: pa.Array, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of rows ``lo`` to ``hi``, and the row (from 0) of each.

    Letters are folded to lower case, everything else is a space, and an n-gram
    has at least one letter and no two spaces in a row.
    """
    texts = [t or "" for t in column.slice(lo, hi - lo).to_pylist()]
    many = np.fromiter(map(len, texts), np.int64, len(texts))
    # each text follows and is followed by a space, wherever in the batch it stands
    flat = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "replace"), np.uint32)
    small = flat < 0x500
    points = np.where(small, _FOLD[np.where(small, flat, 0)], np.where(flat < 0x2000, flat, np.where(flat < 0x2E80, 32, flat)))
    row = np.concatenate([[-1], np.repeat(np.arange(len(texts)), many + 1)])[: len(points)]
    space = points == 32
    keep = np.ones(len(points), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    points, row, space = points[keep].astype(np.uint64), row[keep], space[keep]
    buckets, rows = [], []
    key = np.zeros(len(points), np.uint64)
    alike, blank = np.ones(len(points), bool), np.ones(len(points), bool)
    for n in range(1, max(ORDERS) + 1):
        size = max(0, len(points) - n + 1)
        key = key[:size] * np.uint64(0x110000) + points[n - 1 : n - 1 + size]
        alike = alike[:size] & (row[:size] == row[n - 1 : n - 1 + size])
        blank = blank[:size] & space[n - 1 : n - 1 + size]
        if n in ORDERS:
            good = alike & ~blank
            hashed = (key[good] + np.uint64(n << 61)) * np.uint64(0x9E3779B97F4A7C15)
            buckets.append((hashed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64))
            rows.append(row[:size][good])
    return np.concatenate(buckets), np.concatenate(rows)


def _count_batches(batches: Iterator[pa.RecordBatch], languages: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    index = {name: i for i, name in enumerate(languages)}
    total = np.zeros(len(languages) * BUCKETS, np.int64)
    for batch in batches:
        label = np.array([index.get(x, -1) for x in batch.column("label").to_pylist()], np.int64)
        _, offsets = X.buffers(batch.column("text"))
        for lo, hi in X.pieces(offsets):
            bucket, row = grams(batch.column("text"), lo, hi)
            of = label[lo:hi][row]
            total += np.bincount(of[of >= 0] * BUCKETS + bucket[of >= 0], minlength=len(total))
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some // BUCKETS), pa.array(some % BUCKETS), pa.array(total[some])], ["language", "bucket", "n"])


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample: int = SAMPLE) -> Model | None:
    """Fit on at most about ``sample`` labelled rows of each language, chosen by a hash of id and text; None without any.

    Rows with a null label or text don't count, and of rows alike in the sample
    one is learned, so that the bound holds whatever repeats, null ids too. A
    language with no more rows than ``sample`` is learned whole; one whose rows
    have no n-gram is left out, and so are all but the :data:`LANGUAGES` most
    frequent labels (ties: first in the alphabet).
    """
    rows = labelled.select(labelled[id_col].alias("id"), labelled[text_col].cast("string").alias("text"), labelled[label_col].cast("string").alias("label")).where("label is not null and text is not null")
    known = rows.groupBy("label").count().orderBy(F.col("count").desc(), "label").limit(LANGUAGES).collect()
    if not known:
        return None
    shares = {r["label"]: r["count"] for r in known}
    languages = tuple(sorted(shares))
    k1, k2 = key(F.col("id"), F.col("text"))
    part = F.create_map(*[x for r in known for x in (F.lit(r["label"]), F.lit(int((1 << 30) * min(1.0, sample / r["count"]))))])[F.col("label")]
    rows = rows.withColumns({"k1": k1, "k2": k2}).where(F.pmod("k1", F.lit(1 << 30)) < part)
    rows = rows.groupBy("k1", "k2", "label").agg(F.first("text").alias("text"))
    counts = rows.select("text", "label").mapInArrow(lambda b: _count_batches(b, languages), "language long, bucket long, n long")
    table = np.full((BUCKETS, len(languages)), SMOOTHING)
    for r in counts.groupBy("language", "bucket").agg(F.sum("n").alias("n")).toArrow().to_batches():  # at most BUCKETS rows a language
        np.add.at(table, (r.column("bucket").to_numpy(), r.column("language").to_numpy()), r.column("n").to_numpy())
    some = table.sum(0) > SMOOTHING * BUCKETS
    if not some.any():
        return None
    languages, table = tuple(x for x, good in zip(languages, some) if good), table[:, some]
    prior = np.log(np.array([shares[x] for x in languages]) / sum(shares[x] for x in languages))
    return Model(languages, (np.log(table) - np.log(table.sum(0))).astype(np.float32), prior)


def score(column: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language (-1: no n-gram), its lead per n-gram over the next, and n-grams, by row."""
    best, lead, many = (np.zeros(len(column), t) for t in (np.int64, np.float64, np.int64))
    _, offsets = X.buffers(column)
    for lo, hi in X.pieces(offsets):
        bucket, row = grams(column, lo, hi)
        sums = np.stack([np.bincount(row, model.table[:, k][bucket], hi - lo) for k in range(len(model.languages))], axis=1) + model.prior
        many[lo:hi] = np.bincount(row, minlength=hi - lo)
        order = np.sort(sums, axis=1)
        best[lo:hi] = np.where(many[lo:hi] > 0, sums.argmax(1), -1)
        second = order[:, -2] if sums.shape[1] > 1 else order[:, -1] - many[lo:hi]
        lead[lo:hi] = (order[:, -1] - second) / np.maximum(many[lo:hi], 1)
    return best, lead, many


def _score_batches(batches: Iterator[pa.RecordBatch], shared, margin: float) -> Iterator[pa.RecordBatch]:
    model: Model = shared.value
    names = np.array([*model.languages, "und"], object)
    for batch in batches:
        best, lead, many = score(batch.column("text"), model)
        sure = (best >= 0) & (lead >= margin)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string()), pa.array(np.round(lead, 6)), pa.array(many), pa.array(sure)], ["doc_id", "lang", "margin", "n_grams", "accepted"])


def identify(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", margin: float = MARGIN) -> DataFrame:
    """Language of each row: ``doc_id``, ``lang``, ``margin``, ``n_grams``, ``accepted``.

    Without a model one is trained on the labelled rows of ``docs``. A text
    that is null, empty or without letters is ``und`` and not accepted; so is
    everything if no row is labelled. Ties go to the language first in the
    alphabet and have no margin. Repeated rows are scored alike.
    """
    model = model or train(docs, id_col, text_col, label_col) or Model((), np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    if not model.languages:
        return rows.select("doc_id", F.lit("und").alias("lang"), F.lit(0.0).alias("margin"), F.lit(0).cast("long").alias("n_grams"), F.lit(False).alias("accepted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda b: _score_batches(b, shared, margin), f"doc_id {kind}, lang string, margin double, n_grams long, accepted boolean")


def _filter_batches(batches: Iterator[pa.RecordBatch], shared, margin: float, text: int, wanted: frozenset | None) -> Iterator[pa.RecordBatch]:
    model: Model = shared.value
    good = np.array([wanted is None or x in wanted for x in model.languages] + [False], bool)
    for batch in batches:
        best, lead, _ = score(batch.column(text).cast(pa.string()), model)
        yield batch.filter(pa.array(good[best] & (lead >= margin)))


def keep_identified(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", margin: float = MARGIN, wanted: list[str] | None = None) -> DataFrame:
    """``docs`` whose language is accepted (and ``wanted``, where given); same columns.

    Cases as in :func:`identify`: rows that are ``und`` go.
    """
    model = model or train(docs, id_col, text_col, label_col)
    if model is None:
        return docs.where(F.lit(False))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = docs.columns.index(text_col)
    names = fresh(docs.select(), *[f"c{i}" for i in range(len(docs.columns))])
    out = docs.toDF(*names).mapInArrow(lambda b: _filter_batches(b, shared, margin, text, None if wanted is None else frozenset(wanted)), docs.toDF(*names).schema)
    return out.toDF(*docs.columns)
