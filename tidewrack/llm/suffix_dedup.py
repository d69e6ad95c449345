"""Removal of repeated passages by longest-previous-factor arrays.

A window of ``WINDOW`` words goes if it stands earlier in the corpus, in order
of ids and positions: exactly the positions whose longest previous factor is at
least that long. One suffix array of a corpus fits no machine, so the suffixes
are first parted into cells that can't share a window:

* each window's minimiser is the least hash of the runs of ``GRAM`` words in
  it; equal windows have equal minimisers. A cell is a run of windows of one
  text with one minimiser. Only cells are shuffled, about one for 18 words.
* Of cells that agree word for word the first stays and the rest are copies as
  a whole; they are added up before they move, and a minimiser that has one
  cell, which doesn't repeat itself, is done.
* The rest, one cell for each content, brings its words. Blocks of whole
  minimisers get a suffix array by prefix doubling, to a depth above the
  window; previous and next smaller positions in suffix order give each
  suffix's longest previous factor.
* A minimiser with more than ``CONTENTS`` different contents, such as a phrase
  that very many texts hold in different surroundings, is too much for one
  suffix array. Its windows are compared by a hash of 64 bits instead, which
  finds the same ones and needs no task that holds them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidewrack.llm import _text as X
from tidewrack.llm._rows import key, narrow
from tidewrack.llm._scratch import cut

#: Words of the shortest passage that counts as repeated.
WINDOW = 50
#: Words of a minimiser.
GRAM = 16
#: Words that one suffix array is built over, or one minimiser's where it has more.
BLOCK = 1 << 19
#: Different contents of a minimiser that one suffix array takes.
CONTENTS = 4096


def _slide(x: np.ndarray, width: int, of) -> np.ndarray:
    """Minimum or maximum over ``width`` items from each on; shorter at the end by ``width - 1``."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = of(x[:-step], x[step:])
        have += step
    return x


def _grams(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of ``width`` items from each on."""
    out, have = words, 1
    while have < width:
        step = min(have, width - have)
        out = X.mix(out[: len(out) - step] * np.uint64(0x9E3779B97F4A7C15) + out[step:] + np.uint64(have + step))
        have += step
    return out


def cells(words: np.ndarray, first: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Cells of all rows: row, minimiser, content hash, first window, windows, and whether it may repeat itself."""
    none = np.zeros(0, np.int64)
    if len(words) < window:
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none, none.astype(bool)
    wide = window - gram + 1
    grams = _grams(words, gram)
    least = _slide(grams, wide, np.minimum)
    row = np.searchsorted(first, np.arange(len(least)), "right") - 1
    inside = np.arange(len(least)) + window <= first[row + 1]
    # places of minimisers: a run of words is one if it is the least of some window of its row
    masked = np.where(inside, least, np.uint64(0))
    reach = _slide(np.concatenate([np.zeros(wide - 1, np.uint64), masked, np.zeros(wide - 1, np.uint64)]), wide, np.maximum)
    at = np.flatnonzero((grams == reach[: len(grams)]) & (grams > 0))
    of = np.stack([(np.searchsorted(first, at, "right") - 1).astype(np.uint64), grams[at]], axis=1)
    order = np.lexsort((of[:, 1], of[:, 0]))
    of = of[order]
    twice = of[1:][(of[1:] == of[:-1]).all(1)]
    new = inside.copy()
    new[1:] &= (least[1:] != least[:-1]) | (row[1:] != row[:-1]) | ~inside[:-1]
    begin = np.flatnonzero(new)
    if not len(begin):
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none, none.astype(bool)
    count = np.add.reduceat(inside.astype(np.int64), begin)
    power, inverse = X._tables(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * power[: len(words)], out=total[1:])
    content = X.mix((total[begin + count + window - 1] - total[begin]) * inverse[begin] + count.astype(np.uint64))
    loops = np.zeros(len(begin), bool)
    if len(twice):
        known = X.mix(twice[:, 1] + X.mix(twice[:, 0] + np.uint64(1)))
        loops = np.isin(X.mix(least[begin] + X.mix(row[begin].astype(np.uint64) + np.uint64(1))), known)
    return row[begin], least[begin], content, begin - first[row[begin]], count, loops


def _cell_batches(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = X.buffers(batch.column("text"))
        for lo, hi in X.pieces(offsets):
            d, o = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            start, end, first = X.word_spans(d, o)
            row, least, content, at, count, loops = cells(X.span_hashes(d, start, end, X.PLAIN), first, window, gram)
            take = pa.array(row + lo)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(take) for c in ("id", "k1", "k2")), pa.array(least.view(np.int64)), pa.array(content.view(np.int64)), pa.array(at.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(loops)],
                ["id", "k1", "k2", "cell", "content", "at", "many", "loops"],
            )


def _content_batches(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The words of each wanted cell, as 32-bit hashes."""
    for batch in batches:
        data, offsets = X.buffers(batch.column("text"))
        wanted = batch.column("cells")
        bounds, flat = wanted.offsets.to_numpy(), wanted.flatten()
        cell, at, many = (flat.field(k).to_numpy() for k in range(3))
        base = bounds[0]
        for lo, hi in X.pieces(offsets):
            d, o = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            start, end, first = X.word_spans(d, o)
            words = X.span_hashes(d, start, end, X.PLAIN).astype(np.uint32)
            a, b = bounds[lo] - base, bounds[hi] - base
            row = np.repeat(np.arange(hi - lo), np.diff(bounds[lo : hi + 1]))
            begin, size = first[row] + at[a:b], many[a:b].astype(np.int64) + window - 1
            to = np.concatenate([[0], np.cumsum(size)])
            index = np.arange(to[-1]) + np.repeat(begin - to[:-1], size)
            text = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((4 * to).astype(np.int32)), pa.py_buffer(words[index])])
            take = pa.array(row + lo)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("id", "k1", "k2")), pa.array(cell[a:b]), pa.array(at[a:b]), pa.array(many[a:b]), text], ["id", "k1", "k2", "cell", "at", "many", "words"])


def suffix_levels(text: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array by the first ``depth`` items at least, ties by position, and the ranks by 1, 2, 4 ... items."""
    _, rank = np.unique(text, return_inverse=True)
    levels, have = [rank.astype(np.int64)], 1
    while True:
        rank = levels[-1]
        following = np.zeros(len(rank), np.int64)
        following[: max(0, len(rank) - have)] = rank[have:] + 1
        joint = rank * (len(rank) + 2) + following
        order = np.argsort(joint, kind="stable")
        ranked = joint[order]
        new = np.zeros(len(rank), np.int64)
        new[order[1:]] = np.cumsum(ranked[1:] != ranked[:-1])
        have *= 2
        levels.append(new)
        if have >= depth:
            return order, levels


def nearest_smaller(x: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller item before each, -1 if none, by pointer jumping."""
    back = np.arange(-1, len(x) - 1)
    open_ = np.flatnonzero((back >= 0) & (x[back] > x)) if len(x) else back
    while len(open_):
        back[open_] = back[back[open_]]
        at = back[open_]
        open_ = open_[(at >= 0) & (x[at] > x[open_])]
    return back


def common_prefix(a: np.ndarray, b: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Items that the suffixes at ``a`` and ``b`` share, up to twice the deepest level; 0 where ``b`` is -1."""
    n = len(levels[0])
    a, b, out = a.copy(), np.where(b < 0, n, b), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        fits = (a < n) & (b < n)
        same = fits.copy()
        same[fits] = levels[k][a[fits]] == levels[k][b[fits]]
        out[same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    return out


def longest_previous_factors(text: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """For each position, the longest factor from it that also begins earlier; exact below ``depth``, else at least it."""
    if not len(text):
        return np.zeros(0, np.int64)
    order, levels = suffix_levels(text, depth)
    before = nearest_smaller(order)
    after = len(order) - 1 - nearest_smaller(order[::-1])[::-1]
    previous = np.where(before >= 0, order[before], -1)
    following = np.where(after < len(order), order[np.minimum(after, len(order) - 1)], -1)
    out = np.empty(len(text), np.int64)
    out[order] = np.maximum(common_prefix(order, previous, levels), common_prefix(order, following, levels))
    return out


def covered(words: list[np.ndarray], windows: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that stand earlier, in contents in order: content, first window, windows."""
    size = np.array([len(w) for w in words], np.int64)
    start = np.cumsum(size + 1) - size - 1
    text = np.empty(int((size + 1).sum()), np.int64)
    index = np.arange(size.sum()) + np.repeat(np.arange(len(size)), size)
    text[index] = np.concatenate(words)
    text[start + size] = -1 - np.arange(len(size))  # ends that are equal to nothing
    hit = longest_previous_factors(text, window) >= window
    place = np.arange(windows.sum()) + np.repeat(start - (np.cumsum(windows) - windows), windows)
    of = np.repeat(np.arange(len(size)), windows)
    hit = hit[place]
    new = hit.copy()
    new[1:] &= ~hit[:-1] | (of[1:] != of[:-1])
    begin = np.flatnonzero(new)
    if not len(begin):
        return (np.zeros(0, np.int64),) * 3
    return of[begin], place[begin] - start[of[begin]], np.add.reduceat(hit.astype(np.int64), begin)


def _factor_batches(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    def done(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        data, offsets = X.buffers(table.column("words"))
        flat = np.frombuffer(data.tobytes(), np.uint32)
        words = [flat[a:b] for a, b in zip(offsets[:-1] // 4, offsets[1:] // 4)]
        of, at, many = covered(words, table.column("many").to_numpy().astype(np.int64), window)
        take = pa.array(of)
        at = at + table.column("at").to_numpy()[of]
        columns = [table.column(c).take(take).combine_chunks() for c in ("id", "k1", "k2")]
        return pa.RecordBatch.from_arrays([*columns, pa.array(at.astype(np.int32)), pa.array(many.astype(np.int32))], ["id", "k1", "k2", "at", "many"])

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lo = 0
        while lo < batch.num_rows:
            cell = batch.column("cell").to_numpy()
            many = batch.column("many").to_numpy().astype(np.int64) + window
            room = int(np.searchsorted(np.cumsum(many[lo:]), BLOCK - size, "right"))
            hi = min(batch.num_rows, lo + max(room, 1))
            # a block ends with a minimiser
            while hi < batch.num_rows and cell[hi] == cell[hi - 1]:
                hi += 1
            if held and size >= BLOCK and held[-1].column("cell")[-1].as_py() != cell[lo]:
                yield done(held)
                held, size = [], 0
            held.append(batch.slice(lo, hi - lo))
            size += int(many[lo:hi].sum())
            if size >= BLOCK and hi < batch.num_rows:
                yield done(held)
                held, size = [], 0
            lo = hi
    if held:
        yield done(held)


def _window_batches(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Hash and place of each window of each content."""
    for batch in batches:
        data, offsets = X.buffers(batch.column("words"))
        words = np.frombuffer(data.tobytes(), np.uint32).astype(np.uint64)
        if not len(words):
            continue
        first = offsets // 4
        many = batch.column("many").to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(many)), many)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        hashes = _grams(words, window)[first[row] + nth]
        take = pa.array(row)
        at = batch.column("at").to_numpy()[row] + nth
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("id", "k1", "k2")), pa.array(at.astype(np.int32)), pa.array(hashes.view(np.int64))], ["id", "k1", "k2", "at", "hash"])


def _order() -> list:
    return [F.col("id").isNull(), F.col("id"), F.col("k1"), F.col("k2"), F.col("at")]


def _place() -> Column:
    """Where a window stands, in the order of the corpus."""
    return F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2", "at")


def _covers(docs: DataFrame, id_col: str, text_col: str, window: int, gram: int, contents: int) -> DataFrame:
    """Repeated windows: ``id k1 k2``, ``turn`` among rows alike, and runs ``at``, ``many``."""
    rows = narrow(docs, id_col, text_col)
    k1, k2 = key(rows["id"], rows["text"])
    rows = rows.select("id", k1.alias("k1"), k2.alias("k2"), "text")
    kind = T.StructField("id", rows.schema["id"].dataType)
    fields = lambda s: T.StructType([kind, *T._parse_datatype_string(s).fields])
    every = rows.mapInArrow(lambda b: _cell_batches(b, window, gram), fields("k1 long, k2 long, cell long, content long, at int, many int, loops boolean"))
    # equal contents are added up before they move, so that a passage that very many texts hold is no hot group
    groups = cut(every.groupBy("cell", "content").agg(F.min(_place()).alias("first"), F.count("*").alias("n"), F.max("loops").alias("loops")))
    sizes = cut(groups.groupBy("cell").agg(F.count("*").alias("contents"), F.max(F.col("loops") | (F.col("n") > 1)).alias("alone")).where("contents > 1 or alone").drop("alone"))
    large = not sizes.where(F.col("contents") > contents).isEmpty()
    groups = groups.join(sizes, "cell").where("n > 1 or contents > 1 or loops").select("cell", "content", "first", (F.col("contents") > contents).alias("large"))
    every = every.drop("loops").join(groups, ["cell", "content"]).withColumn("whole", _place() != F.col("first"))
    # rows alike bring each cell as often as they are
    every = every.groupBy("id", "k1", "k2", "cell", "at", "many", "large", "whole").agg(F.count("*").alias("rows"))
    every = cut(every)
    n = F.col("rows").cast("int")
    copies = every.select("id", "k1", "k2", "at", "many", F.explode(F.when(F.col("whole"), F.sequence(F.lit(1), n)).when(n > 1, F.sequence(F.lit(2), n))).alias("turn"))

    def contents_of(wanted: DataFrame) -> DataFrame:
        wanted = wanted.groupBy("k1", "k2").agg(F.collect_set(F.struct("cell", "at", "many")).alias("cells"))
        # rows alike bring their contents once: the first of them is no copy of the others
        once = Window.partitionBy("k1", "k2").orderBy(F.lit(0))
        held = rows.join(wanted, ["k1", "k2"]).withColumn("nth", F.row_number().over(once)).where("nth = 1").drop("nth")
        return held.mapInArrow(lambda b: _content_batches(b, window), fields("k1 long, k2 long, cell long, at int, many int, words binary"))

    found = contents_of(every.where("not whole and not large"))
    found = found.repartition("cell").sortWithinPartitions("cell", *_order())
    found = found.mapInArrow(lambda b: _factor_batches(b, window), fields("k1 long, k2 long, at int, many int"))
    out = copies.select("id", "k1", "k2", "turn", "at", "many").unionByName(found.withColumn("turn", F.lit(1)))
    if large:
        windows = cut(contents_of(every.where("not whole and large")).mapInArrow(lambda b: _window_batches(b, window), fields("k1 long, k2 long, at int, hash long")))
        first = windows.groupBy("hash").agg(F.min(_place()).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        again = windows.join(first, "hash").where(_place() != F.col("first"))
        out = out.unionByName(again.select("id", "k1", "k2", F.lit(1).alias("turn"), "at", F.lit(1).alias("many")))
    return out


def _spans(covers: DataFrame, window: int, by: list[str]) -> DataFrame:
    """Unions of the windows' words: ``first_word`` and ``n_words`` of each span."""
    near = Window.partitionBy(*by).orderBy("at", "end")
    runs = covers.withColumn("end", F.col("at") + F.col("many") + F.lit(window - 1))
    reach = F.max("end").over(near.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("new", F.when(F.col("at") <= reach, 0).otherwise(1)).withColumn("span", F.sum("new").over(near.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*by, "span").agg(F.first("id").alias("id"), F.min("at").alias("first_word"), (F.max("end") - F.min("at")).alias("n_words")).drop("span")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, contents: int = CONTENTS) -> DataFrame:
    """Spans that repeat earlier text: ``doc_id``, ``first_word`` (from 0) and ``n_words``.

    Words are runs without white space, compared as they stand. The first
    occurrence of every passage is in no span, where it isn't itself part of a
    repeated one; a span is a union of windows of ``window`` words, so copies
    that overlap themselves leave their first period. Order is by id (null ids
    last), then by a hash of the row, then by position. Of rows alike in id and
    text all but one are spans as a whole. Texts that are null, empty or of
    fewer words have none; an empty table gives no rows.
    """
    spans = _spans(_covers(docs, id_col, text_col, window, gram, contents), window, ["k1", "k2", "turn"])
    return spans.select(F.col("id").alias("doc_id"), F.col("first_word").cast("long"), F.col("n_words").cast("long"))


def _cut_batches(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The column ``text`` without its spans; rows that lose every word go."""
    for batch in batches:
        column = batch.column(text).to_pylist()
        out, keep = [], np.ones(batch.num_rows, bool)
        for i, (value, turn, spans) in enumerate(zip(column, batch.column("__tw_turn").to_pylist(), batch.column("__tw_spans").to_pylist())):
            mine = sorted((s["a"], s["n"]) for s in spans or () if s["turn"] == turn)
            if mine:
                data = np.frombuffer(value.encode(), np.uint8)
                start, end, _ = X.word_spans(data, np.array([0, len(data)]))
                start = np.append(start, len(data))
                parts, at = [], 0
                for a, n in mine:
                    parts.append(data[at : start[a]])
                    at = start[a + n]
                parts.append(data[at:])
                value = np.concatenate(parts).tobytes().decode()
                if mine[-1][0] + mine[-1][1] == len(start) - 1:
                    value = value.rstrip(" \t\n\f\r")
                keep[i] = bool(value.strip(" \t\n\f\r"))
            out.append(value)
        index = batch.schema.get_field_index(text)
        columns = [pa.array(out, pa.string()) if k == index else c for k, c in enumerate(batch.columns) if batch.schema.field(k).name not in ("__tw_turn", "__tw_spans")]
        names = [n for n in batch.schema.names if n not in ("__tw_turn", "__tw_spans")]
        yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep))


def drop_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", window: int = WINDOW, gram: int = GRAM, contents: int = CONTENTS) -> DataFrame:
    """``docs`` without the spans of :func:`repeated_spans`; same columns.

    A span goes with the white space after it. Rows that lose all their words
    go; rows that had none stay as they are. ``chars_col`` is counted anew.
    """
    covers = _spans(_covers(docs, id_col, text_col, window, gram, contents), window, ["k1", "k2", "turn"])
    spans = covers.groupBy("k1", "k2").agg(F.collect_list(F.struct("turn", F.col("first_word").alias("a"), F.col("n_words").alias("n"))).alias("__tw_spans"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    flat = docs.toDF(*names)
    text = names[docs.columns.index(text_col)]
    flat = flat.withColumn(text, F.col(text).cast("string"))
    k1, k2 = key(flat[names[docs.columns.index(id_col)]], flat[text])
    rows = flat.withColumns({"k1": k1, "k2": k2}).join(spans, ["k1", "k2"], "left")
    rows = rows.withColumn("__tw_turn", F.row_number().over(Window.partitionBy("k1", "k2").orderBy(F.lit(0))))
    out = rows.select(*names, "__tw_turn", "__tw_spans").mapInArrow(lambda b: _cut_batches(b, text), flat.schema).toDF(*docs.columns)
    if chars_col in docs.columns:
        out = out.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType))
    return out


SQL = f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(text, '[^ \\t\\n\\f\\r]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM words)
), covered AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM windows) WHERE n > 1
), parted AS (
  SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span
  FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {WINDOW} THEN 0 ELSE 1 END AS new FROM covered)
)
SELECT doc_id, min(i) - 1 AS first_word, max(i) - min(i) + {WINDOW} AS n_words FROM parted GROUP BY doc_id, span
"""
