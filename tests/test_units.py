"""Operators by unit (section, pair, data set), and the block store, against plain loops."""

import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cortexgrid.operators import graph as H
from cortexgrid.operators import grid as B
from cortexgrid.operators import resample as D
from cortexgrid.operators import sections as S


def plain_match(source, target):
    """One array to another: quantiles with the last index where they are flat."""
    hist = np.bincount(np.minimum(target, 254), minlength=255).astype(float)
    hist[0] = max(0, 2 * hist[1] - hist[2])
    if not hist.sum():
        return [0] * len(source)
    goal = np.cumsum(hist) / hist.sum()
    values, counts = np.unique(source, return_counts=True)
    counts = counts.astype(float)
    if values[0] == 0:
        counts[0] = max(0, 2 * counts[1] - counts[2]) if list(values[:3]) == [0, 1, 2] else float(len(values) == 1)
    q = np.cumsum(counts) / counts.sum()
    out = {}
    for v, x in zip(values.tolist(), q.tolist()):
        below = np.flatnonzero(goal <= x)
        if v == 0 or not len(below):
            out[v] = 0
        else:
            i = below[-1]
            out[v] = int(i) if i == 254 or goal[i + 1] == goal[i] else int(np.floor(i + (x - goal[i]) / (goal[i + 1] - goal[i])))
    return [out[v] for v in source.tolist()]


def test_matching_all_pairs_in_one_plan(spark):
    rng = np.random.default_rng(1)
    arrays = {
        "noise": rng.integers(0, 256, 400), "dark": rng.integers(0, 30, 300), "steps": np.repeat([0, 1, 2, 200], [50, 40, 30, 20]),
        "flat": np.full(60, 7), "empty": np.zeros(10, np.int64), "bright": rng.integers(180, 256, 200),
    }
    rows = [(name, i, int(v)) for name, a in arrays.items() for i, v in enumerate(a)]
    df = spark.createDataFrame(rows, "unit string, i long, raw int").repartition(5)
    pairs = list(itertools.permutations(arrays, 2))
    made = D.match_histograms(df, df.withColumnRenamed("unit", "target"), spark.createDataFrame(pairs, "unit string, target string"))
    got = {}
    for r in made.orderBy("i").collect():
        got.setdefault((r.unit, r.target), []).append(r.raw)
    assert got == {(a, b): plain_match(arrays[a], arrays[b]) for a, b in pairs}


def test_one_array_is_one_unit(spark):
    rng = np.random.default_rng(2)
    source, target = rng.integers(0, 100, 300), rng.integers(50, 256, 300)
    df = lambda a: spark.createDataFrame([(i, int(v)) for i, v in enumerate(a)], "i long, raw int")
    assert [r.raw for r in D.match_histogram(df(source), df(target)).orderBy("i").collect()] == plain_match(source, target)


def plain_otsu(values):
    best = []
    for t in sorted(set(values)):
        low, high = [v for v in values if v <= t], [v for v in values if v > t]
        gap = np.mean(low) - np.mean(high) if high else 0
        best.append((-round(len(low) * len(high) * gap * gap, 4), t))
    return min(best)[1]


def test_thresholds_by_unit(spark):
    rng = random.Random(3)
    units = {k: [rng.choice([rng.randint(0, 60), rng.randint(100, 255)]) for _ in range(rng.randint(1, 80))] for k in range(12)} | {99: [5] * 9}
    df = spark.createDataFrame([(k, v) for k, values in units.items() for v in values], "unit int, d int")
    assert {r.unit: r.threshold for r in D.otsu(df, "d", ["unit"]).collect()} == {k: plain_otsu(v) for k, v in units.items()}
    assert D.otsu(df).first().threshold == plain_otsu([v for x in units.values() for v in x])


def test_changes_come_from_the_similarity_map(spark):
    rng = np.random.default_rng(4)
    a = rng.integers(0, 256, (12, 12))
    b = a.copy()
    b[2:6, 3:8] = 255 - b[2:6, 3:8]  # one changed box
    rows = [(0, y, x, int(a[y, x]), int(b[y, x])) for y, x in np.ndindex(a.shape)]
    found = D.change_mask(spark.createDataFrame(rows, "pair_id long, y long, x long, a int, b int"), 3)
    marked = {(r.y, r.x) for r in found.where("mask = 1").collect()}
    inner = {(y, x) for y in range(3, 5) for x in range(4, 7)}
    assert inner <= marked and all(1 <= y <= 6 and 2 <= x <= 8 for y, x in marked)
    seen = {(r.y, r.x): r.d for r in found.collect()}
    limit = plain_otsu(list(seen.values()))
    assert marked == {k for k, d in seen.items() if d <= limit}


def test_listings_are_numbered_by_ranges(spark):
    a, b = ["s1", "s2", "s2", "s10", "a"], [f"n{i:03}" for i in range(50)]
    df = lambda names: spark.createDataFrame([(n,) for n in names], "name string").repartition(6)
    made = S.pair_sections(df(a), df(b))
    assert sorted((r.pair, r.name_a, r.name_b) for r in made.collect()) == [(i + 1, x, y) for i, (x, y) in enumerate(zip(sorted(a), sorted(b)))]


def test_a_box_reads_only_its_partitions(spark, tmp_path):
    rng = random.Random(5)
    nodes = spark.createDataFrame([(i, rng.uniform(-20, 60), rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(400)], "node long, center_z double, center_y double, center_x double")
    edges = spark.createDataFrame([(*sorted(rng.sample(range(400), 2)), 0.5) for _ in range(600)], "u long, v long, merge_score double")
    block, path = (10, 25, 50), str(tmp_path)
    H.write_rag(nodes, H.edge_centers(edges, nodes), path, (-100, -100, -100), (1000, 1000, 1000), block)
    begin, shape = (5, 30, 0), (20, 40, 50)
    want_nodes = {r.node for r in H.rag_slice(nodes, begin, shape).collect()}
    want_edges = sorted((r.u, r.v) for r in H.rag_slice(H.edge_centers(edges, nodes), begin, shape).collect())
    got_nodes, got_edges = H.read_rag(spark, path, begin, shape, block)
    assert {r.node for r in got_nodes.collect()} == want_nodes and sorted((r.u, r.v) for r in got_edges.collect()) == want_edges
    assert want_nodes and want_edges and set(got_nodes.columns) == set(nodes.columns)
    blocks = {tuple(int(part.split("=")[1]) for part in top.split("/")[-3:]) for top, _, _ in os.walk(f"{path}/nodes") if "block_x=" in top}
    inside = [b for b in blocks if 0 <= b[0] <= 2 and 1 <= b[1] <= 2 and b[2] == 0]
    run = got_nodes._jdf.queryExecution()
    run.toRdd().count()
    assert run.executedPlan().collectLeaves().head().metrics().get("numPartitions").get().value() == len(inside) < len(blocks)


@pytest.mark.parametrize("fit", ["shrink", "overhang"])
def test_write_boxes_follow_from_numbers(spark, fit):
    grid = B.block_grid(spark, (3, -2, 0), (10, 7, 5), (4, 3, 5), (1, 1, 1), fit)
    boxes = B.write_boxes(F.col("block_id"), (3, -2, 0), (10, 7, 5), (4, 3, 5), fit)
    same = [F.col(f"write_begin_{a}") == b for a, (b, _) in zip("zyx", boxes)] + [F.col(f"write_end_{a}") == e for a, (_, e) in zip("zyx", boxes)]
    assert grid.count() == 9 and all(grid.where(~s).isEmpty() for s in same)


def test_blocks_of_several_volumes(spark):
    df = spark.createDataFrame([(v, 0, y, 0, v * 10 + y) for v in (1, 2) for y in range(4)], "volume_id int, z long, y long, x long, raw int")
    made = B.map_blocks(df, lambda p: p.assign(value=p["raw"].sum())[["volume_id", "block_id", "z", "y", "x", "value"]], "volume_id int, block_id long, z long, y long, x long, value long", (0, 0, 0), (1, 4, 1), (1, 2, 1), (0, 1, 0))
    assert sorted((r.volume_id, r.y, r.value) for r in made.collect()) == sorted((v, y, sum(v * 10 + k for k in ((0, 1, 2) if y < 2 else (1, 2, 3)))) for v in (1, 2) for y in range(4))
