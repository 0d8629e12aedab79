"""Connected components of a table of links, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, written


def components(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes in ``links`` (a, b).

    In each round every node goes to its least neighbour or stays, and links
    are drawn between where their ends went, until none is left; the number
    of rounds grows as the logarithm of the nodes.  All tables stay
    distributed and each round's are written.  ``component`` is one of the
    component's nodes.  An empty table gives an empty one.
    """
    edges = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("next")).union(edges.select("b", "a"))
        went = written(both.groupBy("node").agg(F.least(F.col("node"), F.min("next")).alias("goal")), "went")
        if labels is None:
            new = went.withColumnRenamed("goal", "component")
        else:
            moved = went.withColumnRenamed("node", "component")
            new = labels.join(moved, "component", "left").select("node", F.coalesce("goal", "component").alias("component"))
        new = written(new, "labels")
        ends = edges.join(went.select(F.col("node").alias("a"), F.col("goal").alias("to_a")), "a")
        ends = ends.join(went.select(F.col("node").alias("b"), F.col("goal").alias("to_b")), "b")
        rest = ends.where("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct()
        rest = written(rest, "edges")
        for table in (edges, went, labels):
            if table is not None:
                dropped(table)
        edges, labels = rest, new
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
