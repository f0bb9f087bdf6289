"""Connected components of an undirected graph held as a DataFrame of edges.

In each round every node goes up to its smallest neighbour if that is smaller, and
from there once more; the edges are then those between the nodes arrived at, without
loops and repeats. So the graph shrinks from round to round, a path by half at
least, until no edge is left. The smallest node of a component never moves. All
steps are joins and partial aggregations; the driver asks only whether an edge is
left. Each round's tables are written to the shared folder and those of the round before
deleted, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node reachable.

    Null ends are left out; loops and repeated edges do no harm; no edges give no rows.
    """
    ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    left = written(edges.filter("a IS NOT NULL AND b IS NOT NULL").select(*ordered).distinct(), "edges")
    nodes = left.select(F.col("a").alias("node")).union(left.select(F.col("b").alias("node"))).distinct()
    labels = written(nodes.select("node", F.col("node").alias("root")), "labels")
    while not left.filter("a <> b").isEmpty():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("up")), "up")
        once_more = up.select(F.col("a").alias("up"), F.col("up").alias("top"))
        moves = written(up.join(once_more, "up").select(F.col("a").alias("old"), "top"), "moves")
        moved = labels.join(moves, labels["root"] == moves["old"], "left").select("node", F.coalesce("top", "root").alias("root"))
        on_a, on_b = (moves.select(F.col("old").alias(c), F.col("top").alias(f"top_{c}")) for c in "ab")
        shorter = left.filter("a <> b").join(on_a, "a").join(on_b, "b").select(F.col("top_a").alias("a"), F.col("top_b").alias("b")).filter("a <> b").select(*ordered).distinct()
        before = labels, left
        labels, left = written(moved, "labels"), written(shorter, "edges")
        discard(up, moves, *before)
    discard(left)
    return labels
