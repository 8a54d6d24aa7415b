"""Connected components of a link table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limpid.session import stage


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the undirected ``links`` (a, b); component = smallest node.

    Alternating large-star and small-star steps (Kiveris et al., "Connected components in MapReduce
    and beyond", 2014): the number of rounds grows with the logarithm of the longest chain, and the
    number of links never grows. Neighbour lists are never gathered: a minimum is aggregated and
    joined back, so a node with many neighbours is partially aggregated and its join can be split.
    Each round is written to the shared folder. Rows with a null end and self-links add nothing.
    """
    edges = stage(links.where("a < b").select(F.col("b").alias("a"), F.col("a").alias("b"))
                  .union(links.where("a > b").select("a", "b")).distinct(), "links")
    before = _state(edges)
    if before[0] == 0:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(max_rounds):
        edges = stage(_small_star(_large_star(edges)), "links")
        after = _state(edges)
        if after == before:
            nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return nodes.union(nodes.select(F.col("component"), "component").distinct())
        before = after
    raise RuntimeError(f"components not settled after {max_rounds} rounds")


def _state(edges: DataFrame) -> tuple[int, int]:
    """Number and order-free checksum of the links."""
    row = edges.agg(F.count("a"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour (or itself)."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
    return (both.where("b > a").join(least, "a")
            .select(F.col("b").alias("a"), F.col("least").alias("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them (all links point downwards)."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    joined = edges.join(least, "a")
    return (joined.where("b > least").select(F.col("b").alias("a"), F.col("least").alias("b"))
            .union(least.select("a", F.col("least").alias("b"))).distinct())
