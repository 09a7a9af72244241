"""Connected components of an undirected graph given as a DataFrame of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import durable, release


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every end of ``links(a, b)``: the smallest node reachable.

    In each round every node's smallest smaller neighbour is found by a partial aggregate; the node
    keeps that one, and its other links go over to it.  Once no node has two, the links
    are a forest; its nodes then take their parent's parent until all parents are roots.
    Links never become more, so equal ones are dropped before the first round and after the last, not in each.
    No group is ever gathered: a hub with many links costs one row of the aggregate a task, and
    the lookups are merge joins that AQE can split (not broadcast ones: dozens of
    small broadcasts would pile up in the driver).  Rounds are cut by checkpoints; nothing
    is collected.  A null end or a loop drops the link.  An empty input gives an empty result.
    """
    spark = links.sparkSession
    larger, smaller = F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")
    edges = links.where("a is not null and b is not null and a <> b").select(larger, smaller)
    for turn in range(max_rounds):
        ends = edges if turn else edges.distinct()
        ends = ends.join(edges.groupBy("a").agg(F.min("b").alias("least")).hint("merge"), "a")
        extra = F.col("b") > F.col("least")
        found = durable(ends.select(F.when(extra, F.col("b")).otherwise(F.col("a")).alias("a"), F.col("least").alias("b"), extra.alias("extra")))
        edges = found.select("a", "b")
        if found.where("extra").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    edges = edges.distinct()
    for _ in range(max_rounds):
        upper = edges.select(F.col("a").alias("b"), F.col("b").alias("top"))
        found = durable(edges.join(upper.hint("merge"), "b", "left").select("a", F.coalesce("top", "b").alias("b"), F.col("top").isNotNull().alias("rose")))
        edges = found.select("a", "b")
        if found.where("rose").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    release(spark)
    return edges.union(edges.select("b", "b").distinct()).toDF("node", "component")


def bridges(groups: DataFrame, links: DataFrame) -> DataFrame:
    """The pairs (a, b) of different components in ``groups (node, component)`` between which ``links (a, b)`` run."""
    side = lambda x: groups.select(F.col("node").alias(x), F.col("component").alias("c" + x)).hint("merge")
    between = links.select("a", "b").join(side("a"), "a").join(side("b"), "b").where("ca <> cb")
    return between.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()


def merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """``groups (node, component)`` after ``links (a, b)`` between nodes have joined components.

    Only the components that links touch are solved again.
    """
    between = durable(bridges(groups, links))
    if between.isEmpty():
        return groups
    solved = connected_components(between).toDF("component", "joined")
    return durable(groups.join(solved.hint("merge"), "component", "left").select("node", F.coalesce("joined", "component").alias("component")))
