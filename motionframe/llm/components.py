"""Connected components of an edge table, by alternating star operations in Spark.

A large-star step hangs every larger neighbour of a node on the node's smallest neighbour, a small-star step every
smaller one; each is an aggregation and a join, so nothing gathers in one place.  The steps repeat until only
stars are left, which takes a number of rounds logarithmic in the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionframe.llm import workspace


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` (a, b): for each a its neighbours b, hung on the smallest node among a and its neighbours."""
    if large:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    smallest = near.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    hung = near.join(smallest, "a")
    if large:
        moved = hung.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        moved = hung.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(smallest.select("a", F.col("low").alias("b")))
    return moved.filter("a != b").distinct()


def _is_star(edges: DataFrame) -> bool:
    """Whether every node hangs on one node that hangs on none; stars are whole components, as no step cuts one."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("end"))
    ups = ends.groupBy("end.node").agg(F.sum("end.up").alias("ups"), F.min("end.up").alias("least"))
    return ups.filter("ups > 1 OR (ups > 0 AND least = 0)").isEmpty()


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """node, component (the smallest node reachable) of every node of ``edges`` (a, b); nulls and loops are ignored."""
    now = edges.select("a", "b").filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    for _ in range(most_rounds):
        now = workspace.cut(_star(_star(now, True), False))
        if _is_star(now):
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """node, component of the nodes of ``labels`` (node, component) and ``links`` (a, b): components that a link joins are one.

    Only the links between components are gone through again, not what is known of each.
    """
    if labels is None:
        return components(links)
    known = {side: workspace.sized(labels.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}"))) for side in "ab"}
    between = links.select("a", "b").join(known["a"], "a", "left").join(known["b"], "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    joined = components(between)
    moved = labels.join(workspace.sized(joined.select(F.col("node").alias("component"), F.col("component").alias("to"))), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    # a node without a label was its own component
    fresh = joined.join(known["a"].select(F.col("a").alias("node")), "node", "left_anti").select("node", "component")
    return workspace.cut(moved.unionByName(fresh))
