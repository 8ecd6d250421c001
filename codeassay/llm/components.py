"""Connected components by alternating stars; edges stay distributed and hot nodes are not gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.session import cut_lineage


def _least_neighbour(directed: DataFrame) -> DataFrame:
    """For each u the least of its neighbours and itself; combined before the shuffle."""
    return directed.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the least of its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least_neighbour(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours and itself to the least of them; edges come with u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    smaller = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
    return smaller.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes with an edge; a component is named by its least node.

    ``edges`` has columns ``u`` and ``v`` of one ordered type; direction, loops
    and repeats do not matter, nulls are left out.  Rounds go on until an exact
    digest of the edges stays the same; each ends in a reliable checkpoint.  An
    empty table gives an empty result.
    """
    edges = edges.filter("u is not null and v is not null and u <> v")
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, seen = cut_lineage(edges), None
    while True:
        digest = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if tuple(digest) == seen or not digest["n"]:
            break
        seen = tuple(digest)
        edges = cut_lineage(_small_star(_large_star(edges)))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
