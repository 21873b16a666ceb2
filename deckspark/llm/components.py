"""Connected components of a graph given as edges between 64-bit pairs or other ordered keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deckspark.llm.common import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); root is one node of the component.

    Each round points every node at its least neighbour, follows the pointers twice, and contracts the
    edges to the nodes that remain. Minima combine before they are shuffled, so a hub costs one row
    per task. Nodes should be in random order, as hashes are; rounds are then logarithmic. Every round is
    cut in the shared folder. Nothing is collected but the number of edges left.
    """
    rest = cut(edges.select("a", "b").filter("a <> b").distinct())
    roots = None
    while not rest.isEmpty():
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(
            both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root"))
        )
        for _ in range(2):
            step = least.select(F.col("node").alias("root"), F.col("root").alias("_next"))
            least = least.join(step, "root", "left").select("node", F.coalesce("_next", "root").alias("root"))
        least = cut(least)
        for end in ("a", "b"):
            names = least.select(F.col("node").alias(end), F.col("root").alias("_root"))
            rest = rest.join(names, end).drop(end).withColumnRenamed("_root", end)
        rest = cut(rest.filter("a <> b").distinct())
        if roots is None:
            roots = least
        else:
            step = least.select(F.col("node").alias("root"), F.col("root").alias("_next"))
            roots = cut(roots.join(step, "root", "left").select("node", F.coalesce("_next", "root").alias("root")))
    if roots is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    return roots
