"""Connected components of a large edge list by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecrest.llm.common import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b), root being one node of its component.

    Each round points every node to its smallest neighbour, follows the pointers once more, and
    replaces edges by edges between the nodes pointed to, until none is left. Rounds grow with the
    logarithm of the longest path. Every table is written to shared storage, so each join reads
    two scans whose large partitions adaptive execution can split. An empty edge list gives no rows;
    edges with a null end or equal ends are ignored.
    """
    edges = stored(edges.where("a <> b").select("a", "b").distinct(), "edges")
    found = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min("b").alias("near"))
        first = stored(near.select(F.col("a").alias("node"), F.least("a", "near").alias("up")), "pointers")
        second = first.select(F.col("node").alias("up"), F.col("up").alias("root"))
        pointers = stored(first.join(second, "up").select("node", "root"), "pointers")
        moved = edges.join(pointers.toDF("a", "x"), "a").join(pointers.toDF("b", "y"), "b")
        edges = stored(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if found is None:
            found = pointers
        else:
            step = pointers.toDF("root", "next")
            found = stored(found.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
    if found is None:
        found = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found
