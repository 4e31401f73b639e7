"""Connected components of an undirected graph as iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reweave.llm.common import written


def components(edges: DataFrame, most_edges: int) -> DataFrame:
    """node and root, the smallest node it can reach, for every node of `edges` (columns a and b, not null).

    `most_edges` is a bound of the number of edges.

    Each round takes the least label among neighbours and then that label's own label, so that chains halve; labels
    are written between rounds, by as many tasks as the number of edges asks for. Self-loops are allowed; no edges give
    no rows.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "edges", 2 * most_edges)
    most = both.count()  # there are at most as many nodes
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root"))
    labels = written(labels, "labels", most)
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("least"))
        new = near.join(labels, near["a"] == labels["node"]).select(
            "node", F.least("root", "least").alias("root"), F.col("root").alias("old")
        )
        new = written(new, "labels", most)
        up = new.select(F.col("node").alias("up"), F.col("root").alias("up_root"))
        jumped = new.join(up, new["root"] == up["up"]).select("node", "old", F.least("root", "up_root").alias("root"))
        jumped = written(jumped, "labels", most)
        labels = jumped.select("node", "root")
        if jumped.filter("root <> old").isEmpty():
            return labels


def joined(roots: DataFrame, links: DataFrame, most_links: int) -> DataFrame:
    """`roots` (node, root; as `components` gives it) after further `links` (a, b): only the roots that they join are settled
    anew. Nodes that `roots` lacks are their own roots."""
    ends = links.select("a", "b")
    for end in ("a", "b"):
        known = roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
        ends = ends.join(known, end, "left").withColumn(f"root_{end}", F.coalesce(f"root_{end}", end))
    moved = components(ends.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")), most_links)
    old = moved.select(F.col("node").alias("root"), F.col("root").alias("new"))
    old = roots.join(old, "root", "left").select("node", F.coalesce("new", "root").alias("root"))
    return written(old.unionByName(moved.join(roots, "node", "left_anti")), "labels", roots.count() + 2 * most_links)
