"""Region adjacency graphs. Nodes have node and center_*, edges u < v and merge_score."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cortexgrid.operators.blocks import BLOCK, Block, map_arrays
from cortexgrid.operators.components import components_of_edges, connected_components
from cortexgrid.operators.features import shifted
from cortexgrid.operators.grid import AXES, KEY
from cortexgrid.plans import drop, materialize


#: Decimal places of a mean score, and what an affinity of 1 counts as in its sum of whole numbers.
DIGITS, WHOLE = 9, 10**9
#: Bins of an edge's histogram, and the share of contacts below its quantile.
BINS, QUANTILE = 256, 0.25


def fragment_nodes(df: DataFrame, resolution: Sequence[int] = (1, 1, 1), offset: Sequence[int] = (0, 0, 0), label: str = "label") -> DataFrame:
    """mean coordinate of each fragment, in world units."""
    return df.where(F.col(label) > 0).groupBy(F.col(label).alias("node")).agg(*((F.avg(a) * r + o).alias(f"center_{a}") for a, r, o in zip(AXES, resolution, offset)))


def half_neighbourhood(connectivity: int = 2) -> list[tuple[int, int, int]]:
    """The half of the offsets with at most connectivity non-zero parts that come before the voxel itself."""
    near = [(z, y, x) for z in (-1, 0, 1) for y in (-1, 0, 1) for x in (-1, 0, 1)]
    return [o for o in near if o < (0, 0, 0) and sum(map(abs, o)) <= connectivity]


def rag_edges(df: DataFrame, connectivity: int = 2, label: str = "label", block: Sequence[int] = BLOCK) -> DataFrame:
    """(u, v) of labels above 0 that touch. A block gives each of its pairs once."""
    offsets = half_neighbourhood(connectivity)

    def touching(b: Block) -> dict[str, pa.Array]:
        own, pairs = b.at(b.values[label]), []
        for o in offsets:
            near = b.at(b.values[label], o)
            met = (own > 0) & (near > 0) & (own != near)
            pairs.append(np.stack((np.minimum(own[met], near[met]), np.maximum(own[met], near[met])), axis=1))
        found = np.unique(np.concatenate(pairs), axis=0).astype(np.int64)
        return {"u": pa.array(found[:, 0]), "v": pa.array(found[:, 1])}

    return map_arrays(df, [label], touching, "u long, v long", offsets, block).select("u", "v").distinct()


def contact_bins(df: DataFrame, affs: DataFrame, label: str = "label", block: Sequence[int] = BLOCK) -> DataFrame:
    """(u, v, bin, n, whole): contacts across faces between labels above 0, by their affinity's bin, and the sum of their
    affinities in WHOLE parts. Each block sums its own contacts; a face's affinity is that of its later voxel.
    """
    faces = [(-1, 0, 0), (0, -1, 0), (0, 0, -1)]
    # without affinities a voxel isn't the later one of a contact, but it is a neighbour
    both = df.select(*KEY, label).join(affs.select(*KEY, "affs"), KEY, "left").withColumn("known", F.col("affs").isNotNull().cast("int"))
    both = both.withColumn("affs", F.coalesce("affs", F.array_repeat(F.lit(0.0), 3)))

    def summed(b: Block) -> dict[str, pa.Array]:
        own, known, rows = b.at(b.values[label]), b.at(b.values["known"]) > 0, []
        for k, o in enumerate(faces):
            near = b.at(b.values[label], o)
            met = known & (own > 0) & (near > 0) & (own != near)
            a = b.at(b.values["affs"])[k][met]
            rows.append((np.minimum(own[met], near[met]), np.maximum(own[met], near[met]), np.minimum(np.floor(a * (BINS - 1)), BINS - 1), np.rint(a * WHOLE)))
        u, v, bins, whole = (np.concatenate(x).astype(np.int64) for x in zip(*rows))
        found, at, n = np.unique(np.stack((u, v, bins)), axis=1, return_inverse=True, return_counts=True)
        total = np.zeros(found.shape[1], np.int64)
        np.add.at(total, at.ravel(), whole)
        return {"u": pa.array(found[0]), "v": pa.array(found[1]), "bin": pa.array(found[2]), "n": pa.array(n.astype(np.int64)), "whole": pa.array(total)}

    made = map_arrays(both, [label, "affs", "known"], summed, "u long, v long, bin long, n long, whole long", faces, block)
    return made.groupBy("u", "v", "bin").agg(F.sum("n").alias("n"), F.sum("whole").alias("whole"))


def score_bins(bins: DataFrame, how: str = "mean") -> DataFrame:
    """F13 on contact_bins' sums; the same as score_edges on contacts."""
    if how == "mean":
        n, whole = F.sum("n"), F.sum("whole")
        return bins.groupBy("u", "v").agg(n.alias("contacts"), F.round(1 - whole / (n * WHOLE), DIGITS).alias("merge_score"))
    return quantile_scores(bins)


def contacts(df: DataFrame, affs: DataFrame, label: str = "label") -> DataFrame:
    """(u, v, a): the affinity across every face between two labels above 0."""
    faces = [(-1, 0, 0), (0, -1, 0), (0, 0, -1)]
    long = shifted(df.select(*KEY, label), faces, [label])
    met = long.where((F.col(label) > 0) & (F.col(f"{label}_o") > 0) & (F.col(label) != F.col(f"{label}_o")))
    return met.join(affs, KEY).select(F.least(label, f"{label}_o").alias("u"), F.greatest(label, f"{label}_o").alias("v"), F.get("affs", F.col("o")).alias("a"))


def edge_histograms(met: DataFrame) -> DataFrame:
    """(u, v, bin, n): contacts of each edge by their affinity's bin; histograms of boundaries that fall together add up."""
    return met.groupBy("u", "v", F.least(F.floor(F.col("a") * (BINS - 1)), F.lit(BINS - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def quantile_scores(bins: DataFrame, *more: Column) -> DataFrame:
    """(u, v, contacts, merge_score): 1 - the first bin that QUANTILE of the contacts reach; more: further aggregates."""
    by = Window.partitionBy("u", "v")
    upto = bins.withColumn("upto", F.sum("n").over(by.orderBy("bin"))).withColumn("all", F.sum("n").over(by))
    first = F.min(F.when(F.col("upto") >= QUANTILE * F.col("all"), F.col("bin")))
    return upto.groupBy("u", "v").agg(F.max("all").alias("contacts"), (1 - first / float(BINS - 1)).alias("merge_score"), *more)


def score_edges(met: DataFrame, how: str = "mean") -> DataFrame:
    """(u, v, contacts, merge_score): 1 - mean affinity, or 1 - the 25th percentile over 256 bins.

    Means come from sums of whole numbers and are rounded to DIGITS places once, here, so that they are the same in
    whatever order contacts were summed and an edge at a threshold is below it.
    """
    if how == "mean":
        whole, n = F.sum(F.round(F.col("a") * WHOLE).cast("bigint")), F.count(F.lit(1))
        return met.groupBy("u", "v").agg(n.alias("contacts"), F.round(1 - whole / (n * WHOLE), DIGITS).alias("merge_score"))
    return quantile_scores(edge_histograms(met))


def edge_centers(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with the mean of their ends' centres."""
    a, b = (nodes.select(F.col("node").alias(e), *(F.col(f"center_{x}").alias(f"_{e}{x}") for x in AXES)) for e in "uv")
    return edges.join(a, "u").join(b, "v").select(*edges.columns, *(((F.col(f"_u{x}") + F.col(f"_v{x}")) / 2).alias(f"center_{x}") for x in AXES))


def init_rag(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes with labels = [node], edges with merge_score (null if missing) and agglomerated 0."""
    n = nodes if "labels" in nodes.columns else nodes.withColumn("labels", F.array("node"))
    e = edges if "merge_score" in edges.columns else edges.withColumn("merge_score", F.lit(None).cast("double"))
    old = F.col("agglomerated") if "agglomerated" in edges.columns else F.lit(None)
    return n, e.withColumn("agglomerated", F.coalesce(old, F.lit(0)))


def set_edge_attribute(edges: DataFrame, name: str, value) -> DataFrame:
    """one value for all edges."""
    return edges.withColumn(name, F.lit(value))


def rag_slice(df: DataFrame, begin: Sequence[float], shape: Sequence[float]) -> DataFrame:
    """F16: nodes or edges whose centre lies in a box."""
    out = df
    for a, b, n in zip(AXES, begin, shape):
        out = out.where((F.col(f"center_{a}") >= b) & (F.col(f"center_{a}") < b + n))
    return out


def _joined(nodes: DataFrame, edges: DataFrame, threshold: float) -> DataFrame:
    return connected_components(nodes, edges.where(F.col("merge_score") <= threshold).select("u", "v"))


def segment(nodes: DataFrame, edges: DataFrame, threshold: float) -> DataFrame:
    """(node, segment): components of edges scored at most threshold, numbered 1..n by their smallest node."""
    found = materialize(_joined(nodes, edges, threshold), "components")
    return found.join(dense_ids(found.select("component")), "component").select("node", F.col("_id").alias("segment"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with _id 1..n in an order: ranges are counted first, so no task sorts them all."""
    own = materialize(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ids")
    counts = own.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return own.withColumn("_r", rank).join(offsets, "_part").select(*rows.columns, (F.col("_r") + F.col("_before")).cast("bigint").alias("_id"))


def dense_ids(ids: DataFrame) -> DataFrame:
    """Distinct ids (one or more columns) with _id 1..n in their order."""
    return numbered(ids.distinct(), *ids.columns)


def contract(nodes: DataFrame, edges: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with one node for each component, its labels merged; edges between components start anew.

    A component's node is its smallest one; isolated nodes stay.
    """
    labelled = nodes if "labels" in nodes.columns else nodes.withColumn("labels", F.array("node"))
    part = materialize(_joined(nodes, edges, threshold), "components")
    merged = labelled.join(part, "node").groupBy(F.col("component").alias("node")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("labels")))).alias("labels"))
    a, b = (part.select(F.col("node").alias(e), F.col("component").alias(f"c{e}")) for e in "uv")
    between = edges.select("u", "v").join(a, "u").join(b, "v").where("cu != cv").select(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v")).distinct()
    return merged, between.withColumn("merge_score", F.lit(None).cast("double")).withColumn("agglomerated", F.lit(0))


def relabel(df: DataFrame, mapping: DataFrame, label: str = "label") -> DataFrame:
    """labels replaced by mapping (old, new); others stay. The mapping grows with the labels, so Catalyst sizes the join."""
    m = mapping.select(F.col("old").alias(label), F.col("new").alias("_new"))
    return df.join(m, label, "left").withColumn(label, F.coalesce("_new", label)).select(*df.columns)


def compact_ids(df: DataFrame, label: str = "label") -> DataFrame:
    """labels above 0 become 1..n in their order; the others, background above all, stay out of the join."""
    on = F.coalesce(F.col(label) > 0, F.lit(False))
    ids = dense_ids(df.where(on).select(label))
    new = df.where(on).join(ids, label).withColumn(label, F.col("_id")).select(*df.columns)
    return new.unionByName(df.where(~on))


def _agglomerated(nodes: DataFrame, edges: DataFrame, score: Callable[[DataFrame], DataFrame], merged: Callable[[DataFrame], DataFrame], threshold: float) -> DataFrame:
    """(node, segment) after best-first merging of edges up to threshold.

    edges have u, v and tie, a struct that is greater for any edge put together from others. score gives (u, v, score,
    tie) of each edge, merged puts rows together that have the same u and v. In rounds, every edge that is the best of
    both its ends by (score, tie) is merged. An edge put together is no better than the better of its parts, in this
    order without ties, so that gives the tree of merging the best edge of all again and again (reducibility).
    """
    place, e = materialize(nodes.select("node", F.col("node").alias("segment")), "place"), materialize(edges, "edges")
    while True:
        best_first = F.struct("score", "tie", "u", "v").alias("best")
        ends = score(e).where(F.col("score") <= threshold).select(F.explode(F.array("u", "v")).alias("end"), best_first)
        best = ends.groupBy("end").agg(F.min("best").alias("best"))
        mutual = best.groupBy("best.u", "best.v").agg(F.count(F.lit(1)).alias("k")).where("k = 2")
        move = materialize(mutual.select(F.col("v").alias("old"), F.col("u").alias("new")), "move")
        if move.isEmpty():
            drop(e, move)
            return place
        old_place, old_edges = place, e
        place = materialize(place.join(move, F.col("segment") == F.col("old"), "left").select("node", F.coalesce("new", "segment").alias("segment")), "place")
        a, b = (move.select(F.col("old").alias(x), F.col("new").alias(f"n{x}")) for x in "uv")
        ends_of = e.join(a, "u", "left").join(b, "v", "left").withColumn("p", F.coalesce("nu", "u")).withColumn("q", F.coalesce("nv", "v")).where("p != q")
        moved = ends_of.withColumn("u", F.least("p", "q")).withColumn("v", F.greatest("p", "q")).select(*e.columns)
        e = materialize(merged(moved), "edges")
        drop(old_place, old_edges, move)


def agglomerate(nodes: DataFrame, edges: DataFrame, threshold: float) -> DataFrame:
    """(node, segment): edges (u, v, contacts, merge_score = 1 - mean) merged best first up to threshold.

    Boundaries that fall together get the contact-weighted mean; ties go by the largest (u, v) that a boundary is made of.
    segment is the smallest node of each.
    """
    e = edges.where("merge_score is not null").select("u", "v", F.struct("u", "v").alias("tie"), F.col("contacts").cast("double").alias("n"), (F.col("merge_score") * F.col("contacts")).alias("s"))
    score = lambda e: e.withColumn("score", F.round(F.col("s") / F.col("n"), DIGITS))
    return _agglomerated(nodes, e, score, lambda e: e.groupBy("u", "v").agg(F.max("tie").alias("tie"), F.sum("n").alias("n"), F.sum("s").alias("s")), threshold)


def agglomerate_quantile(nodes: DataFrame, bins: DataFrame, threshold: float) -> DataFrame:
    """F21 with histograms: (node, segment); an edge's score is 1 - the QUANTILE of its contacts' affinities over BINS bins.

    bins is edge_histograms' (u, v, bin, n). Histograms of boundaries that fall together are added, bin by bin, and scored
    again; ties, which bins make common, go by the largest (u, v) that a boundary is made of.
    """
    e = bins.select("u", "v", "bin", "n", F.struct("u", "v").alias("tie"))
    score = lambda e: quantile_scores(e, F.max("tie").alias("tie")).withColumnRenamed("merge_score", "score")
    return _agglomerated(nodes, e, score, lambda e: e.groupBy("u", "v", "bin").agg(F.sum("n").alias("n"), F.max("tie").alias("tie")), threshold)


#: Thresholds of a sweep.
THRESHOLDS = (0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75)


def threshold_name(t: float) -> str:
    """segmentation_ and the rounded threshold without its dot."""
    return "segmentation_" + str(round(t, 2)).replace(".", "")


def spanning_forest(edges: DataFrame, threshold: float | None = None) -> DataFrame:
    """(u, v, merge_score): a minimum spanning forest of the scored edges (up to threshold), by Boruvka's rounds.

    In each round every component takes its best edge to another one, by (merge_score, u, v), and components along these
    join; edges within a component go. Components at any threshold are those of the forest's edges up to it.
    """
    scored = edges.where("merge_score is not null and u != v")
    if threshold is not None:
        scored = scored.where(F.col("merge_score") <= threshold)
    rest = materialize(scored.select("u", "v", "merge_score", F.col("u").alias("p"), F.col("v").alias("q")), "rest")
    forest: list[DataFrame] = []
    while not rest.isEmpty():
        order = F.struct("merge_score", "u", "v", "p", "q")
        best = rest.select(F.explode(F.array("p", "q")).alias("end"), order.alias("e")).groupBy("end").agg(F.min("e").alias("e"))
        forest.append(materialize(best.select("e.*").distinct(), "forest"))
        part = components_of_edges(forest[-1].select(F.col("p").alias("u"), F.col("q").alias("v")))
        a, b = (part.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "pq")
        # a component without a best edge has no edge left, so every end is found
        going = rest.join(a, "p").join(b, "q").where("cp != cq").select("u", "v", "merge_score", F.col("cp").alias("p"), F.col("cq").alias("q"))
        old, rest = rest, materialize(going, "rest")
        drop(old)
    drop(rest)
    if not forest:
        return edges.select("u", "v", "merge_score").limit(0)
    whole = materialize(reduce(DataFrame.unionByName, (f.select("u", "v", "merge_score") for f in forest)), "whole")
    drop(*forest)
    return whole


def cut_forest(nodes: DataFrame, forest: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """(t, node, segment): components of the forest's edges up to each threshold, segment their smallest node.

    All thresholds are cut in one run, over the pairs of a threshold's number and a node's.
    """
    levels = sorted(thresholds)
    ids = materialize(dense_ids(nodes.select("node")), "ids")
    number = F.array(*map(F.lit, levels))
    upto = F.filter(F.sequence(F.lit(0), F.lit(len(levels) - 1)), lambda k: F.col("merge_score") <= F.get(number, k))
    a, b = (ids.select(F.col("node").alias(x), F.col("_id").alias(f"i{x}")) for x in "uv")
    own = forest.join(a, "u").join(b, "v").select("iu", "iv", F.explode(upto).alias("k"))
    at = lambda i: F.col(i) * len(levels) + F.col("k")
    found = components_of_edges(own.select(at("iu").alias("u"), at("iv").alias("v")))
    every = ids.select("node", "_id", F.explode(F.sequence(F.lit(0), F.lit(len(levels) - 1))).alias("k")).withColumn("at", at("_id"))
    placed = every.join(found.withColumnRenamed("node", "at"), "at", "left")
    # numbers rise with nodes, so the least number of a component is its smallest node's
    least = placed.select("node", "k", F.floor((F.coalesce("component", "at") - F.col("k")) / len(levels)).cast("bigint").alias("i"))
    first = ids.select(F.col("_id").alias("i"), F.col("node").alias("segment"))
    return least.join(first, "i").select(F.get(number, F.col("k")).alias("t"), "node", "segment")


def sweep(nodes: DataFrame, edges: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """(name, node, segment) at each threshold, segment the smallest node of each component.

    The edges are read once, for a spanning forest; its cuts are the segmentations.
    """
    cuts = cut_forest(nodes, spanning_forest(edges, max(thresholds)), thresholds)
    name = F.element_at(F.create_map(*(x for t in thresholds for x in (F.lit(float(t)), F.lit(threshold_name(t))))), F.col("t"))
    return cuts.select(name.alias("name"), "node", "segment")


def write_rag(nodes: DataFrame, edges: DataFrame, path: str, begin: Sequence[float], shape: Sequence[float], block: Sequence[float], mode: str = "append") -> None:
    """nodes and edges of a box, partitioned by the block of their centre.

    Rows are dealt by block in pieces of the advisory size, so that what a task sorts and writes doesn't grow with the graph.
    """
    for name, df in (("nodes", nodes), ("edges", edges)):
        own = rag_slice(df, begin, shape)
        for a, n in zip(AXES, block):
            own = own.withColumn(f"block_{a}", F.floor(F.col(f"center_{a}") / n).cast("int"))
        own.hint("rebalance", *(f"block_{a}" for a in AXES)).write.mode(mode).partitionBy(*(f"block_{a}" for a in AXES)).parquet(f"{path}/{name}")


def read_rag(spark: SparkSession, path: str, begin: Sequence[float], shape: Sequence[float], block: Sequence[float]) -> tuple[DataFrame, DataFrame]:
    """F16 on what F23 wrote: (nodes, edges) whose centre lies in a box; only the partitions of the box's blocks are read."""
    out = []
    for name in ("nodes", "edges"):
        df = spark.read.parquet(f"{path}/{name}")
        for a, b, n, size in zip(AXES, begin, shape, block):
            df = df.where(F.col(f"block_{a}").between(math.floor(b / size), math.ceil((b + n) / size) - 1))
        out.append(rag_slice(df, begin, shape).drop(*(f"block_{a}" for a in AXES)))
    return out[0], out[1]
