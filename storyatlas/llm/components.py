"""Connected components by contraction, with tables in the shared folder between steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import store


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) -> node, root: the smallest node that each node reaches.

    Every step points each node at its smallest neighbour or itself, follows the
    pointers to their ends, and contracts the graph to those ends; the number of
    steps grows with the logarithm of the longest path.  NULLs and loops are dropped.
    """
    edges = store(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    found = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = store(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")), "pointers")
        while True:
            ends = point.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
            further = point.join(ends, F.col("root") == F.col("_n")).select("node", "root", F.col("_r"))
            further = store(further, "jumps")
            moved = not further.where("_r <> root").isEmpty()
            point = further.select("node", F.col("_r").alias("root"))
            if not moved:
                break
        if found is None:
            found = point
        else:
            ends = point.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
            found = store(found.join(ends, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root")), "found")
        ends = point.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        left = edges.join(ends, F.col("a") == F.col("_n")).select(F.col("_r").alias("x"), "b")
        left = left.join(ends, F.col("b") == F.col("_n")).select("x", F.col("_r").alias("y")).where("x <> y")
        edges = store(left.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found
