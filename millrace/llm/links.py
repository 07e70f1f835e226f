"""Connected components of a link table, by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import Scratch


def _least(edges: DataFrame, key: str, other: str) -> DataFrame:
    return edges.groupBy(F.col(key).alias("u")).agg(F.min(other).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of the node and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = _least(both, "u", "v").select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the least of them. Each edge has its larger end in a."""
    least = _least(edges, "a", "b")
    moved = edges.join(least, edges["a"] == least["u"]).select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return moved.filter("a <> b").distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component): the least node that each node of an edge can reach; nodes that are the least of theirs are left out.

    edges has integer columns a and b. Each round is written to the shared folder, and the one before it is deleted.
    No node's neighbours are gathered: a node with very many links costs partial minima and a join that Spark can split.
    An empty table gives an empty one; null ends and self links are dropped, repeated links count once.
    """
    now = scratch.put(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    seen, k = None, 0
    while True:
        n, xor = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if not n or (n, xor) == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen, k = (n, xor), k + 1
        now = scratch.put(_small_star(_large_star(now)), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
