"""connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cortexgrid.plans import drop, materialize


def _hook(edges: DataFrame) -> DataFrame:
    """Per node the smallest of itself and its listed neighbours, joined back to the listing."""
    least = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _hook(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    hooked = _hook(down)
    ends = hooked.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return ends.where("u != v")


def components_of_edges(edges: DataFrame) -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node reachable.

    edges has two bigint columns u and v. Null ends, loops and repeats are ignored; no edges give no rows.
    Each round ends in a written table, so that the plan stays short and a lost executor costs one round.
    """
    now = materialize(edges.select("u", "v").where("u is not null and v is not null and u != v").distinct(), "edges")
    seen = None
    while True:
        before, now = now, materialize(_small_star(_large_star(now)).distinct(), "star")
        drop(before)
        sign = now.agg(F.count(F.lit(1)), F.sum(F.col("u") % 1000003), F.sum(F.xxhash64("u", "v") % 1000000007)).first()
        if sign == seen or sign[0] == 0:
            break
        seen = sign
    ends = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    tops = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return ends.unionByName(tops)


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) for every row of nodes; a node without edges is its own component."""
    found = components_of_edges(edges)
    return nodes.select("node").distinct().join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
