"""Content-defined chunking and containment of documents.

A gear hash rolls over the bytes; a chunk ends where the hash's leading bits
are zero, under a strict mask before the normal size and a loose one after it,
and is then drawn out to the end of its word. The hash sees eight bytes only
and chunks are a few words long, so an edit spoils little more than the words
it stands in. Letter case and the kind of white space don't count. Chunks are
known by a digest, and containment is the share of a text's length that lies
in shared chunks.
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

#: Chunk sizes in bytes: least, normal and greatest.
LEAST, NORMAL, MOST = 16, 32, 96
#: Leading bits that must be zero: before and from the normal size.
STRICT, LOOSE = 5, 3
#: Bytes up to a cut that decide on it.
REACH = 8

#: Bytes as they count: Latin letters in lower case, all white space as spaces.
FOLDED = X.LOWER.copy()
FOLDED[X.SPACE] = FOLDED[32]

_GEAR = (np.random.default_rng(1).integers(0, 1 << REACH, 256, dtype=np.uint32) << np.uint32(32 - REACH))[FOLDED.astype(np.int64) - 1]


def gear(data: np.ndarray) -> np.ndarray:
    """Gear hash at each byte, of the ``REACH`` bytes up to it: h = (h << 1) + gear[byte], by doubling."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        if len(h) > k:
            h[k:] += h[:-k] << np.uint32(k)  # the right side is computed first, from the old values
    return h


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all chunks, ascending, and the row of each; an empty row has none.

    Cuts are never within the first ``LEAST`` >= ``REACH`` bytes of a chunk, so no
    hash that decides reaches over the row's begin.
    """
    h = gear(data)
    loose = np.flatnonzero(h < np.uint32(1 << (32 - LOOSE))) + 1
    strict = h[loose - 1] < np.uint32(1 << (32 - STRICT))
    loose, strict = loose.tolist(), strict.tolist()
    ends: list[int] = []
    rows: list[int] = []
    k, m = 0, len(loose)
    for row, (begin, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        at = begin
        while at < end:
            least, normal, most = at + LEAST, at + NORMAL, min(at + MOST, end)
            while k < m and loose[k] < least:
                k += 1
            j = k
            while j < m and loose[j] < most and not (strict[j] or loose[j] >= normal):
                j += 1
            at = loose[j] if j < m and loose[j] < most else most
            k = j
            ends.append(at)
            rows.append(row)
    return np.array(ends, np.int64), np.array(rows, np.int64)


def word_chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and row of each chunk, its end drawn out to that of its word, at most ``MOST`` bytes further.

    A chunk that lies within the word of the one before it is part of that.
    """
    end, row = chunks(data, offsets)
    if not len(end):
        return end, end, row
    space = np.append(np.flatnonzero(X.SPACE[data]), len(data))
    word = space[np.searchsorted(space, end - 1)]
    word = np.where((word < end) | (word > end + MOST), end, word)
    end = np.maximum.accumulate(np.minimum(word, offsets[row + 1]))
    last = np.append(end[1:] != end[:-1], True)
    end, row = end[last], row[last]
    return np.append(0, end[:-1]), end, row


#: Low bits of a digest that hold its chunk's size: at most ``2 * MOST`` bytes.
SIZE_BITS = 8
#: One document of so many is looked at to find hot digests, and the share of them that makes a digest hot.
SAMPLED, HOT_SHARE = 64, 0.002
#: Hot digests at most: there can't be many more, as a document has few chunks; any others go the usual way.
HOT_MOST = 100_000
#: One row of so many, by its id, is searched for the document that holds most of it.
EVERY = 50
#: Rows of a digest up to which documents meet pair by pair.
FEW = 64
#: Blocks of documents in which all others meet: so many, and one more for each ``BLOCK`` rows.
LEAST_BLOCKS, BLOCK = 8, 1 << 20
#: Matches in a block that are added up at once, or those of one document.
MATCHES = 1 << 21


def _chunk_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    low = np.uint64((1 << SIZE_BITS) - 1)
    for batch in batches:
        data, offsets = X.buffers(batch.column("text"))
        for lo, hi in X.pieces(offsets):
            d, o = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            begin, end, row = word_chunks(d, o)
            digest = X.span_hashes(d, begin, end, FOLDED) & ~low | (end - begin).astype(np.uint64)
            own = pa.array(row + lo)
            rest = batch.schema.names[2:]
            yield pa.RecordBatch.from_arrays([batch.column("k1").take(own), pa.array(digest.view(np.int64)), *(batch.column(c).take(own) for c in rest)], ["k1", "digest", *rest])


def _size_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = X.buffers(batch.column("text"))
        many = np.zeros(batch.num_rows, np.int64)
        for lo, hi in X.pieces(offsets):
            _, _, row = word_chunks(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            many[lo:hi] = np.bincount(row, minlength=hi - lo)
        some = pa.array(np.flatnonzero(many))
        size = pa.array(np.diff(offsets))
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(some) for c in ("id", "k1", "k2")), pa.array(many).take(some), size.take(some)], ["id", "k1", "k2", "n_chunks", "n_bytes"])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = narrow(docs, id_col, text_col)
    k1, k2 = key(rows["id"], rows["text"])
    return rows.select("id", k1.alias("k1"), k2.alias("k2"), "text")


def chunk_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks of each row, with their repeats: ``k1`` (row key) and ``digest``, whose low bits are the size in bytes."""
    return _rows(docs, id_col, text_col).select("k1", "text").mapInArrow(_chunk_batches, "k1 long, digest long")


def chunk_size(digest: Column) -> Column:
    return digest.bitwiseAND(F.lit((1 << SIZE_BITS) - 1))


def _hot(sets: DataFrame, sampled: int) -> DataFrame:
    """Digests that a good share of the documents hold, by a sample of them; they only choose the way, results don't depend on them."""
    some = cut(sets.where(F.pmod("k1", F.lit(sampled)) == 0))
    many = some.agg(F.count_distinct("k1").alias("n")).first()["n"]
    found = some.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") >= max(8, HOT_SHARE * many))
    return found.orderBy(F.col("n").desc(), "digest").limit(HOT_MOST).select("digest")


def _asked(rows: DataFrame, every: int) -> Column:
    """Whether a row is searched for: its id is divisible by ``every``, or its key where ids are no numbers."""
    number = isinstance(rows.schema["id"].dataType, T.NumericType)
    return F.coalesce((F.col("id") if number else F.col("k1")) % every == 0, F.lit(False))


def _starts(sorted_: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])[: len(sorted_)])


def _most(asked: np.ndarray, size: np.ndarray, holder: np.ndarray) -> list[np.ndarray]:
    """Of each that is asked (ascending), the least holder of those of most bytes."""
    if not len(asked):
        return [asked, holder, size]
    at = _starts(asked)
    most = np.maximum.reduceat(size, at)
    first = size == np.repeat(most, np.diff(np.append(at, len(asked))))
    asked, holder = asked[first], holder[first]
    at = _starts(asked)
    return [asked[at], np.minimum.reduceat(holder, at), most]


def _block_best(block: pa.Table) -> pa.Table:
    """The best holders among a block's documents: ``k1``, ``holder`` and ``size``, one or two rows of each that is asked.

    The block's rows have ``one``, ``two`` and ``size``: a document and a digest
    it holds (0), one that is asked and its digest (-1), or one that is asked and
    its holder, by so many bytes in chunks that few hold. What is asked meets
    the different sets of digests here; no pair leaves the block but the best.
    """
    one, two, size = (block.column(c).to_numpy() for c in ("one", "two", "size"))
    digests, column = np.unique(two[size == 0], return_inverse=True)
    docs, row = np.unique(one[size == 0], return_inverse=True)
    row, column = np.divmod(np.unique(row * max(1, len(digests)) + column), max(1, len(digests)))
    mixed = digests.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    sets = np.add.reduceat(mixed[column], _starts(row)) if len(row) else mixed
    _, low, kind = np.unique(sets, return_index=True, return_inverse=True)  # documents ascend, so the first has the least key
    by_kind = np.argsort(kind, kind="stable")
    at = np.searchsorted(kind[by_kind], np.arange(len(low)))
    several = np.diff(np.append(at, len(docs))) > 1
    second = np.where(several, by_kind[np.minimum(at + 1, max(0, len(docs) - 1))], -1) if len(docs) else at
    own = low[kind[row]] == row  # one document's digests for each set
    row, column = kind[row[own]], column[own]
    by_digest = np.argsort(column, kind="stable")
    row, begin = row[by_digest], np.searchsorted(column[by_digest], np.arange(len(digests) + 1))

    asks, digest = one[size == -1], two[size == -1]
    place = np.searchsorted(digests, digest)
    here = np.append(digests, 0)[place] == digest
    here &= place < len(digests)
    asks, digest, place = asks[here], digest[here], place[here]
    order = np.argsort(asks, kind="stable")
    asks, digest, place = asks[order], digest[order] & ((1 << SIZE_BITS) - 1), place[order]
    met_by = begin[place + 1] - begin[place]
    asked, holder, held = one[size > 0], two[size > 0], size[size > 0]
    order = np.lexsort((holder, asked))
    asked, holder, held = asked[order], holder[order], held[order]
    if len(asked):
        at = np.flatnonzero(np.append(True, (asked[1:] != asked[:-1]) | (holder[1:] != holder[:-1])))
        asked, holder, held = asked[at], holder[at], np.add.reduceat(held, at)
    where = np.minimum(np.searchsorted(docs, holder), max(0, len(docs) - 1))
    of = np.where(docs[where] == holder, kind[where], -1) if len(docs) else np.full(len(holder), -1)

    out = []
    who = _starts(asks)
    done = np.append(0, np.cumsum(met_by))[np.append(who, len(asks))]
    i = 0
    while i < len(who):
        j = max(i + 1, int(np.searchsorted(done, done[i] + MATCHES, side="right")) - 1)
        lo, hi = who[i], who[j] if j < len(who) else len(asks)
        many = met_by[lo:hi]
        at = np.arange(many.sum()) + np.repeat(begin[place[lo:hi]] - np.append(0, np.cumsum(many)[:-1]), many)
        number = np.repeat(np.cumsum(np.append(False, asks[lo + 1 : hi] != asks[lo : hi - 1])), many)
        met = np.sort((number * len(low) + row[at]) << SIZE_BITS | np.repeat(digest[lo:hi], many))
        at = _starts(met >> SIZE_BITS)
        total = np.add.reduceat(met & ((1 << SIZE_BITS) - 1), at)
        met = met[at] >> SIZE_BITS
        number, to = np.divmod(met, len(low))
        by = asks[who[i:j]]
        best = low[to]
        best = np.where(docs[best] == by[number], second[to], best)
        is_one = best >= 0
        out.append(_most(by[number[is_one]], total[is_one], docs[best[is_one]]))
        lo, hi = np.searchsorted(asked, by[0]), np.searchsorted(asked, by[-1], side="right")
        wanted = np.searchsorted(by, asked[lo:hi])
        wanted = np.where((of[lo:hi] >= 0) & (by[wanted] == asked[lo:hi]), wanted * len(low) + of[lo:hi], -1)
        at = np.minimum(np.searchsorted(met, wanted), len(met) - 1)
        held[lo:hi] += np.where(met[at] == wanted, total[at], 0)
        i = j
    out.append(_most(asked, held, holder))
    return pa.table([np.concatenate(c) for c in zip(*out)], names=["k1", "holder", "size"])


def _holders(cold: DataFrame, warm: DataFrame) -> DataFrame:
    """The document that holds most of each that is ``asked``: ``k1``, ``holder`` and ``holder_bytes``, exactly.

    Both tables are chunks (``k1 digest asked``), ``cold`` with ``n``, the rows of
    each digest. Where these are few, documents meet pair by pair. Of all other
    digests, and the hot ones of ``warm``, what is asked is brought to every
    block of documents and met there (see ``_block_best``), so that pairs never
    move: their number grows with the square of the documents.
    """
    few = cold.where(F.col("n") <= FEW).repartition("digest").groupBy("digest", "k1").agg((F.count("*") * chunk_size(F.col("digest"))).alias("size"), F.max("asked").alias("asked"))
    few = few.groupBy("digest").agg(F.collect_list(F.struct("k1", "size", "asked")).alias("all"))  # where it was brought to: nothing moves again
    pairs = few.select(F.explode(F.filter("all", lambda x: x["asked"])).alias("mine"), "all").select("mine", F.explode("all").alias("other")).where("mine.k1 <> other.k1")
    pairs = pairs.select(F.col("mine.k1").alias("one"), F.col("other.k1").alias("two"), F.col("mine.size").alias("size"))
    often = cold.where(F.col("n") > FEW).select("k1", "digest", "asked").union(warm.select("k1", "digest", "asked"))
    rows = often.count() + (cold.where((F.col("n") <= FEW) & F.col("asked")).agg(F.sum("n")).first()[0] or 0)
    blocks = LEAST_BLOCKS + rows // BLOCK
    named = often.select(F.col("k1").alias("one"), F.col("digest").alias("two"), "asked")
    of = lambda k: F.pmod(F.col(k), F.lit(blocks)).cast("int").alias("block")
    met = pairs.select(of("two"), "one", "two", "size")
    met = met.union(named.select(of("one"), "one", "two", F.lit(0).cast("long").alias("size")))
    met = met.union(named.where("asked").select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "one", "two", F.lit(-1).cast("long").alias("size")))
    met = met.groupBy("block").applyInArrow(_block_best, "k1 long, holder long, size long")
    best = F.min(F.struct((-F.col("size")).alias("minus"), "holder"))
    return met.groupBy("k1").agg(best.alias("best")).select("k1", F.col("best.holder").alias("holder"), (-F.col("best.minus")).alias("holder_bytes"))


def containment(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sampled: int = SAMPLED, every: int = EVERY) -> DataFrame:
    """How much of each document lies in others: one row for each that has text.

    Columns: ``doc_id``; ``n_chunks``; ``n_bytes``; ``shared_bytes``, in chunks
    that another document has too; ``containment``, their share;
    ``source_id``, the document that stands for the most of these bytes (ties to
    the least row key; null if nothing is shared, or if its own id is null); and
    ``source_bytes``, how many. Another document stands for a chunk by the least
    row key of its holders, or by the greatest where the least is its own. Rows
    whose id is divisible by ``every`` (or whose key is, where ids are no
    numbers) are searched for among all rows: ``holder_id`` is the document that
    holds the most bytes of such a row, of all that share any chunk (ties to the
    least row key), and ``holder_bytes`` how many; null for other rows. Ids may
    be of any type.

    A digest's holders are documents, so a chunk that only one text repeats
    isn't shared. Repeated rows share everything and are one document here:
    each such row is reported, with all its bytes shared. Null and empty texts
    have no row; an empty table gives no rows; extra columns are ignored. What
    moves is in proportion to the chunks, but for those of rows that are
    searched for which more than ``FEW`` rows hold: these go to every block of
    documents. Comparing them there grows with the square of the documents.
    Digests that very many documents hold are added up before they move and
    never meet in one task.
    """
    rows = _rows(docs, id_col, text_col)
    sets = rows.select("k1", "text", _asked(rows, every).alias("asked")).mapInArrow(_chunk_batches, "k1 long, digest long, asked boolean")
    hot = F.broadcast(cut(_hot(sets, sampled)))  # at most HOT_MOST numbers
    named = lambda low, high: F.when(F.col(low) != F.col("k1"), F.col(low)).otherwise(F.col(high))
    same = Window.partitionBy("digest")
    cold = sets.join(hot, "digest", "left_anti").withColumns({"low": F.min("k1").over(same), "high": F.max("k1").over(same), "n": F.when(F.max("asked").over(same), F.count("*").over(same)).otherwise(0).cast("int")})
    shared = lambda t, *more: t.where("low <> high").select("k1", named("low", "high").alias("source"), chunk_size(F.col("digest")).cast("int").alias("size"), *more)
    cold = cut(shared(cold, F.when(F.col("n") > 0, F.col("digest")).alias("digest"), "asked", "n"))  # digests that nothing asked holds aren't written
    warm = cut(sets.join(hot, "digest"))
    holders = _holders(cold.where("n > 0").select("k1", "digest", "asked", "n"), warm)
    ends = cut(warm.groupBy("digest").agg(F.min("k1").alias("low"), F.max("k1").alias("high")))
    warm = warm.join(F.broadcast(ends), "digest")
    by = cold.select("k1", "source", "size").union(shared(warm)).groupBy("k1", "source").agg(F.sum("size").alias("size"))
    best = F.min(F.struct((-F.col("size")).alias("minus"), F.col("source").alias("source")))
    by = by.groupBy("k1").agg(F.sum("size").alias("shared_bytes"), best.alias("best"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), *(T.StructField(n, T.LongType()) for n in ("k1", "k2", "n_chunks", "n_bytes"))])
    whole = rows.mapInArrow(_size_batches, schema)
    # rows alike all bring their chunks, so sums are divided by their number
    whole = cut(whole.groupBy("k1").agg(F.first("id").alias("id"), F.first("n_chunks").alias("n_chunks"), F.first("n_bytes").alias("n_bytes"), F.count("*").alias("rows")))
    names = whole.select(F.col("k1").alias("holder"), F.col("id").alias("holder_id"))
    out = whole.join(cut(holders.join(names, "holder")), "k1", "left").join(by, "k1", "left").select("*", F.col("best.source").alias("source"), (-F.col("best.minus")).alias("source_bytes")).drop("best")
    out = out.join(whole.select(F.col("k1").alias("source"), F.col("id").alias("source_id")), "source", "left")
    alone = F.coalesce(F.expr("shared_bytes div rows"), F.lit(0).cast("long"))
    out = out.withColumn("shared_bytes", F.when(F.col("rows") > 1, F.col("n_bytes")).otherwise(alone))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    return out.select(
        F.col("id").alias("doc_id"), "n_chunks", "n_bytes", "shared_bytes", F.round(F.col("shared_bytes") / F.col("n_bytes"), 6).alias("containment"), "source_id",
        F.coalesce(F.expr("source_bytes div rows"), F.lit(0).cast("long")).alias("source_bytes"),
        "holder_id", F.when(_asked(whole, every), F.coalesce(F.expr("holder_bytes div rows"), F.lit(0).cast("long"))).alias("holder_bytes"),
    )
