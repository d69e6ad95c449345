"""Contiguous shards of equal byte size, cut from global prefix sums.

Ids are cut into ranges at approximate quantiles; the total of each range gives
the offset at which it begins; within a range a running sum places each row.
Only ids and sizes are shuffled, once, and never in one partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewrack.llm._scratch import cut

SHARDS = 16
#: Ranges that the prefix sums are taken over, at least; more where the session shuffles into more partitions.
RANGES = 256
#: Bounds that one step of the search for a range tells apart.
STEP = 64


def _bounds(rows: DataFrame, ranges: int) -> list:
    """Ids that part the table into ranges of about equal counts; at most ``ranges`` of them."""
    points = [i / ranges for i in range(1, ranges)]
    got = rows.agg(F.percentile_approx("rank", points, 10000).alias("p")).first()["p"]
    return sorted(set(got or []))


def _range(rank: Column, bounds: list) -> Column:
    """Number of bounds that are at most ``rank``, -1 for null: first every ``STEP``-th bound is searched, then those behind it."""
    coarse = bounds[STEP - 1 :: STEP]

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        middle = (lo + hi) // 2
        return F.when(rank < coarse[middle], search(lo, middle)).otherwise(search(middle + 1, hi))

    if not bounds:
        return F.when(rank.isNull(), -1).otherwise(0)
    fine = F.array(*[F.array(*[F.lit(b).cast("long") for b in bounds[k : k + STEP]]) for k in range(0, len(bounds), STEP)])
    chunk = search(0, len(coarse))
    within = F.size(F.filter(F.coalesce(F.get(fine, chunk), F.array().cast("array<bigint>")), lambda b: b <= rank))
    return F.when(rank.isNull(), -1).otherwise(chunk * STEP + within)


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Each row's shard: ``doc_id``, ``n_bytes``, ``byte_start`` and ``shard_id``.

    Rows are ordered by id, null ids first; ties by size. ``byte_start`` is the
    size of all rows before; a row belongs to the shard that holds its first
    byte: shard k begins at byte k * total / shards. A null text has no bytes.
    Tied rows of equal size are interchangeable. A row larger than the target
    leaves following shards empty. With no bytes at all everything is in shard
    0, and an empty table gives no rows. The id may be any integer type.
    """
    sized = cut(docs.select(docs[id_col].alias("doc_id"), F.coalesce(F.octet_length(docs[text_col].cast("string")), F.lit(0)).cast("long").alias("n_bytes")))
    ranked = sized.withColumn("rank", F.col("doc_id").cast("long"))
    bounds = _bounds(ranked, ranges or max(RANGES, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    ranked = ranked.withColumn("range", _range(F.col("rank"), bounds))
    totals = ranked.groupBy("range").agg(F.sum("n_bytes").alias("bytes")).orderBy("range").collect()  # a row for each range
    offsets, at = [], 0
    for row in totals:
        offsets.append((row["range"], at))
        at += row["bytes"]
    start = F.create_map(*[F.lit(x).cast(t) for r, o in offsets for x, t in ((r, "int"), (o, "long"))]) if offsets else F.create_map(F.lit(0), F.lit(0).cast("long"))
    near = Window.partitionBy("range").orderBy(F.col("rank").asc_nulls_first(), "n_bytes").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.element_at(start, F.col("range")) + F.coalesce(F.sum("n_bytes").over(near), F.lit(0).cast("long"))
    total = F.lit(max(at, 1)).cast("decimal(38,0)")
    number = F.least(F.floor(F.col("byte_start").cast("decimal(20,0)") * shards / total), F.lit(shards - 1)).cast("int")
    return ranked.select("doc_id", "n_bytes", begin.alias("byte_start")).withColumn("shard_id", number)


SQL = f"""
WITH sized AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes FROM documents
), placed AS (
  SELECT doc_id, n_bytes,
    CAST(coalesce(sum(n_bytes) OVER (ORDER BY doc_id NULLS FIRST, n_bytes ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_start,
    sum(n_bytes) OVER () AS total
  FROM sized
)
SELECT doc_id, n_bytes, byte_start, CAST(least(byte_start * {SHARDS} // greatest(total, 1), {SHARDS - 1}) AS INTEGER) AS shard_id FROM placed
"""
