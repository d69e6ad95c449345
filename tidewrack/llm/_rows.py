"""Row identity that tolerates null and repeated ids.

A row is known by its id and text, hashed to 128 bits: rows that agree in both
are interchangeable, so decisions about them need only a count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, K2 = "__tw_k1", "__tw_k2"


def narrow(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id`` and ``text`` alone: other columns can't clash with an operator's own."""
    return df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"))


def key(id_col: Column, text_col: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes that stand for the row."""
    return F.xxhash64(id_col.isNull(), id_col, text_col), F.xxhash64(text_col, F.lit(1), id_col)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out
