"""Connected components of a graph given by its edges, as joins and aggregates only.

Each round alternates two steps until all edges lead to a root: every node's larger neighbours are linked to the smallest
node it sees, then every node and its smaller neighbours are linked to the smallest of them. The edges never grow in
number, the rounds grow with the logarithm of the longest path, and each is cut off by a checkpoint in the shared folder.
Minima are combined before their shuffle, so a hub with many neighbours costs one row per task there; the join that
follows can be split at hot keys by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import checkpointed


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over (u, v) with u > v: link the larger (large) or smaller neighbours of each node to its smallest one."""
    down = edges.select(F.col("v").alias("n"), F.col("u").alias("o"))
    up = edges.select(F.col("u").alias("n"), F.col("v").alias("o"))
    least = (up.unionByName(down) if large else up).groupBy("n").agg(F.least(F.col("n"), F.min("o")).alias("m"))
    # Of the edges as they are kept, the larger neighbours of a node are those above it.
    linked = (down if large else up).join(least, "n").select(F.col("o").alias("u"), F.col("m").alias("v"))
    if not large:
        linked = linked.unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v")))
    return linked.filter("u <> v").distinct()


def stars(edges: DataFrame) -> bool:
    """Whether every node is either a root or has one edge, to a root. As roots are the smaller ends, nothing changes then."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    return ends.groupBy("n").agg(F.sum("below").alias("below"), F.max("above").alias("above")).filter("below + above > 1").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with an edge to another; root is the smallest node that it reaches.

    Nulls and loops are left out; an empty table gives an empty one. Nodes may be of any orderable type.
    """
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    edges = checkpointed(edges)
    while not stars(edges):
        edges = checkpointed(star(star(edges, True), False))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
