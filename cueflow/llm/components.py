"""Connected components of a graph that is too large for one machine.

Alternating large-star and small-star rounds: every node points its larger (then its smaller)
neighbours to the smallest node that it knows, until nothing changes. Each round is two joins and
is written to the shared folder, so a lost executor costs that round only. The number of rounds
grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueflow.session import settle


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """`edges` (a, b) with a > b; each node's edges moved to the smallest node near it."""
    if large:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    met = near.join(least, "a")
    if large:
        moved = met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
    return moved.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b long): root is the component's smallest node.

    Loops and repeated edges are ignored, and so are edges with a null end.
    """
    current = settle(
        edges.filter("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not current.isEmpty():
        moved = settle(_star(settle(_star(current, True), "large-star"), False), "small-star")
        same = moved.join(current, ["a", "b"], "left_anti").isEmpty() and current.join(
            moved, ["a", "b"], "left_anti").isEmpty()
        current = moved
        if same:
            break
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
