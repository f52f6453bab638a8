"""Connected components of a stored edge table, by hooking to the smallest neighbour and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node reachable, for all nodes that have an edge.

    ``edges`` has two bigint columns ``a`` and ``b``.  In each round every node points to its
    smallest neighbour if that is smaller, pointers are followed to their ends, and edges are
    rewritten between the ends.  Pointers only lead to smaller nodes, so there is no cycle.
    Rounds are few: the number of roots at least halves.  Every step reads stored tables, so that
    adaptive execution can split the rows of a node with many edges.
    """
    edges = materialise(_ordered(edges.select("a", "b")), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
            edges.select(F.col("b").alias("node"), F.col("a").alias("other"))
        )
        ends = materialise(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("end")), "ends")
        while True:
            onward = ends.select(F.col("node").alias("end"), F.col("end").alias("next"))
            step = ends.join(onward, "end").select("node", F.col("next").alias("end"), (F.col("next") != F.col("end")).alias("moved"))
            step = materialise(step, "ends")
            ends = step.select("node", "end")
            if step.where("moved").isEmpty():
                break
        if labels is None:
            labels = ends.select("node", F.col("end").alias("component"))
        else:
            moved = ends.select(F.col("node").alias("component"), "end")
            labels = materialise(
                labels.join(moved, "component", "left").select("node", F.coalesce("end", "component").alias("component")), "labels"
            )
        edges = edges.join(ends.select(F.col("node").alias("a"), F.col("end").alias("x")), "a").join(
            ends.select(F.col("node").alias("b"), F.col("end").alias("y")), "b"
        )
        edges = materialise(_ordered(edges.select(F.col("x").alias("a"), F.col("y").alias("b"))), "edges")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
