"""Connected components of a distributed edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import cut_lineage


def connected_components(edges: DataFrame, *, rounds: int = 60) -> DataFrame:
    """(node, component) for each node of ``edges(a, b)``; component is the smallest node reachable.

    Every node ends as the leaf of a star around its component's smallest node.  Each round writes
    its edges and each node's smallest neighbour to the checkpoint folder, so that a hub's rows reach
    the join in shuffled parts of their own, which Spark may split; only a row count and a checksum
    reach the driver.  Self loops and rows with a null are left out, so a node without other edges
    has no row.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current, before = cut_lineage(pairs), None
    for _ in range(rounds):
        seen = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not seen.n or seen == before:
            break
        before = seen
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = cut_lineage(both.join(nearest, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        lowest = cut_lineage(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(lowest, "u").select(F.greatest("v", "m").alias("a"), F.least("v", "m").alias("b")).where("a <> b")
        small = small.unionByName(lowest.select(F.col("u").alias("a"), F.col("m").alias("b")))
        current = cut_lineage(small.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
    else:
        raise RuntimeError("the components did not settle")
    # In a settled star each leaf has one edge, to the smallest node, which has none to a smaller one.
    leaves = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(leaves.select(F.col("component").alias("node"), "component").distinct())


def named_components(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component, joined): each component named by the smallest ``rep`` of its ``nodes(node, rep)``."""
    names = found.join(nodes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("name"))
    return found.join(names, "component").select("node", F.col("name").alias("component"), F.lit(True).alias("joined"))
