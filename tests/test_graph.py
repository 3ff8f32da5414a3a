"""Agglomeration, spanning forests and scores against plain loops."""

import random
from collections import Counter

import pytest

from cortexgrid.operators import graph as H


def best_first(n, histograms, threshold, score):
    """Merges the best edge of all, by (score, tie), again and again; tie is the largest (u, v) that an edge is made of."""
    live = {(u, v): (Counter(h), (u, v)) for (u, v), h in histograms.items()}
    place = list(range(n))
    while live:
        (u, v), (h, tie) = min(live.items(), key=lambda e: (score(e[1][0]), e[1][1]))
        if score(h) > threshold:
            break
        place = [u if p == v else p for p in place]
        merged = {}
        for (a, b), (g, t) in live.items():
            a, b = sorted((u if x == v else x) for x in (a, b))
            if a != b:
                old = merged.get((a, b), (Counter(), (-1, -1)))
                merged[a, b] = old[0] + g, max(old[1], t)
        live = merged
    return dict(enumerate(place))


def quantile(h):
    total, upto = sum(h.values()), 0
    for b in sorted(h):
        upto += h[b]
        if upto >= 0.25 * total:
            return 1 - b / 255.0


def test_quantile_agglomeration_equals_best_first(spark):
    rng, differ = random.Random(8), 0
    for bins in ((0, 60, 120, 255), range(256), (100, 200)):  # many ties, few, only ties
        n = 9
        histograms = {(u, v): {b: rng.randint(1, 4) for b in rng.sample(list(bins), min(len(bins), rng.randint(1, 4)))} for u in range(n) for v in range(u + 1, n) if rng.random() < 0.6}
        rows = [(u, v, b, k) for (u, v), h in histograms.items() for b, k in h.items()]
        nodes = spark.createDataFrame([(i,) for i in range(n)], "node long")
        for threshold in (0.4, 0.8):
            got = {r.node: r.segment for r in H.agglomerate_quantile(nodes, spark.createDataFrame(rows, "u long, v long, bin long, n long"), threshold).collect()}
            assert got == best_first(n, histograms, threshold, quantile)
            mean = best_first(n, histograms, threshold, lambda h: 1 - sum(b * k for b, k in h.items()) / 255 / sum(h.values()))
            differ += got != mean
    assert differ


def test_agglomeration_without_edges(spark):
    nodes = spark.createDataFrame([(4,), (9,)], "node long")
    none = spark.createDataFrame([], "u long, v long, bin long, n long")
    assert {r.node: r.segment for r in H.agglomerate_quantile(nodes, none, 1.0).collect()} == {4: 4, 9: 9}


def test_histograms_add_up(spark):
    met = spark.createDataFrame([(1, 2, 0.0), (1, 2, 1.0), (1, 2, 1.0), (1, 3, 0.5)], "u long, v long, a double")
    assert sorted(tuple(r) for r in H.edge_histograms(met).collect()) == [(1, 2, 0, 1), (1, 2, 255, 2), (1, 3, 127, 1)]
    assert {(r.u, r.v): (r.contacts, r.merge_score) for r in H.score_edges(met, "quantile").collect()} == {(1, 2): (3, 1.0), (1, 3): (1, 1 - 127 / 255)}


def test_mean_at_a_tie_is_exact(spark):
    # 80 contacts whose mean is exactly 0.6353125, in orders that sum to different doubles
    values = [k / 40 for k in range(40)] * 2
    values[0] = (0.6353125 * 80) - sum(values[1:])
    whole = [(round(v * 40)) for v in values]
    want = round(1 - sum(whole) / 40 / 80, 9)
    for seed in range(3):
        random.Random(seed).shuffle(values)
        met = spark.createDataFrame([(5, 7, v) for v in values], "u long, v long, a double").repartition(3)
        assert [tuple(r) for r in H.score_edges(met).collect()] == [(5, 7, 80, want)]


def components(nodes, edges):
    place = {n: n for n in nodes}

    def find(i):
        while place[i] != i:
            i = place[i]
        return i

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        place[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", [1, 2])
def test_forest_and_its_cuts(spark, seed):
    rng = random.Random(seed)
    nodes = [10 * i - 50 for i in range(40)]
    edges = [(*sorted(rng.sample(nodes, 2)), rng.choice([None, 0.1, 0.35, 0.5, 0.75, rng.random()])) for _ in range(90)]
    given = spark.createDataFrame(edges, "u long, v long, merge_score double")
    forest = H.spanning_forest(given)
    found = [tuple(r) for r in forest.collect()]
    scored = [e for e in edges if e[2] is not None]
    whole = components(nodes, [e[:2] for e in scored])
    assert len(found) == len(nodes) - len(set(whole.values())) and set(found) <= set(scored)
    assert components(nodes, [e[:2] for e in found]) == whole
    thresholds = (0.1, 0.35, 0.6, 2.0)
    cuts = {(r.t, r.node): r.segment for r in H.cut_forest(spark.createDataFrame([(n,) for n in nodes], "node long"), forest, thresholds).collect()}
    assert cuts == {(t, n): c for t in thresholds for n, c in components(nodes, [e[:2] for e in scored if e[2] <= t]).items()}


def test_forest_is_read_once_by_a_sweep(spark, monkeypatch):
    calls = []
    own = H.spanning_forest
    monkeypatch.setattr(H, "spanning_forest", lambda *a: calls.append(1) or own(*a))
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "node long")
    rows = H.sweep(nodes, spark.createDataFrame([(1, 2, 0.4), (2, 3, 0.9)], "u long, v long, merge_score double")).collect()
    assert len(calls) == 1 and len(rows) == 27
    assert {(r.name, r.node): r.segment for r in rows}["segmentation_04", 2] == 1 and {r.segment for r in rows if r.node == 3} == {3}
    assert H.spanning_forest(spark.createDataFrame([], "u long, v long, merge_score double")).count() == 0
