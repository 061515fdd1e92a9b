"""Connected components of a graph of links, by alternating stars, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.session import Workspace


def _least_neighbour(both: DataFrame) -> DataFrame:
    """(u, least): the smallest of u and its neighbours."""
    return both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("least"))


def components(links: DataFrame, work: Workspace, name: str = "components") -> DataFrame:
    """(node, component) for every node of ``links`` (u, v); the component is its smallest node.

    Large stars connect what is larger than a node, small stars what is smaller, with its smallest neighbour; both keep the
    components. Repeated until every node hangs on its smallest: a number of rounds that grows with the logarithm of the
    longest chain. No neighbourhood is gathered: only minima by node are, and joins by node split where a node is hot.
    """
    edges = work.write(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")
    state, i = None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.where("v > u").join(_least_neighbour(both), "u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        large = large.where("u <> v").distinct()
        i += 1
        large = work.write(large, f"{name}-{i}-large")
        # In a small star only smaller neighbours count, and they are the second column.
        least = large.groupBy("u").agg(F.min("v").alias("least"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(least.select("u", F.col("least").alias("v")))
        edges = work.write(small.where("u <> v").distinct(), f"{name}-{i}-small")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return work.write(stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), f"{name}-done")
