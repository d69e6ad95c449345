"""Connected components by repeated contraction towards the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.llm._scratch import cut


def components(edges: DataFrame) -> DataFrame:
    """Label of each node of ``edges`` (columns ``a`` and ``b``): columns ``node`` and ``label``.

    Nodes of one component share a label. Each round maps every node to the
    least of itself and its neighbours and contracts the edges; a path of n
    nodes takes about log n rounds. No edges: no rows.
    """
    edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while True:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select(F.col("b"), F.col("a")))
        step = cut(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")))
        if labels is None:
            labels = step
        else:
            moved = step.select(F.col("node").alias("label"), F.col("label").alias("to"))
            labels = cut(labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")))
        left = step.select(F.col("node").alias("a"), F.col("label").alias("x"))
        right = step.select(F.col("node").alias("b"), F.col("label").alias("y"))
        edges = edges.join(left, "a").join(right, "b").where("x <> y")
        edges = cut(edges.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if edges.isEmpty():
            return labels
