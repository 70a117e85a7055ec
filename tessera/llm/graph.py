"""Connected components of an edge table, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable from each node of edges (a, b).

    Every round each node points to its smallest neighbour, pointers are followed to their roots by
    doubling, and the edges are contracted to roots; the number of nodes at least halves, so there
    are logarithmically many rounds.  All steps are joins and partial minima; a hub is a skewed join
    key that adaptive execution splits.  An empty edge table gives an empty result.
    """
    left = stash(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not left.isEmpty():
        both = left.union(left.select("b", "a")).toDF("node", "to")
        parent = stash(both.groupBy("node").agg(F.least(F.min("to"), F.col("node")).alias("label")), "parent")
        while True:
            up = parent.select(F.col("node").alias("label"), F.col("label").alias("over"))
            jumped = parent.join(up, "label").select("node", F.col("over").alias("label"), (F.col("over") != F.col("label")).alias("moved"))
            jumped = stash(jumped, "parent")
            parent = jumped.drop("moved")
            if jumped.where("moved").isEmpty():
                break
        labels = parent if labels is None else stash(labels.join(parent.toDF("label", "over"), "label", "left").select("node", F.coalesce("over", "label").alias("label")), "labels")
        a, b = parent.toDF("a", "ra"), parent.toDF("b", "rb")
        left = stash(left.join(a, "a").join(b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    return labels if labels is not None else left.toDF("node", "label")
