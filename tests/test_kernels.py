"""Distances, floods, boundaries and descriptors against plain loops."""

import itertools
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cortexgrid.operators import features as E
from cortexgrid.operators import fragments as R
from cortexgrid.operators import lines
from cortexgrid.operators import resample as D

VOXELS = "volume_id int, z long, y long, x long, "


def table(spark, a, name, kind="long"):
    return spark.createDataFrame([(0, *i, v.item()) for i, v in np.ndenumerate(a)], VOXELS + f"{name} {kind}").repartition(3)


def test_lower_envelope():
    rng = np.random.default_rng(1)
    for _ in range(60):
        lines, n = rng.integers(1, 5), rng.integers(1, 30)
        place = np.cumsum(rng.integers(1, 9, (lines, n)), axis=1) - 40
        height = np.where(rng.random((lines, n)) < 0.4, np.inf, rng.integers(0, 400, (lines, n)).astype(float))
        want = (height[:, None, :] + (place[:, :, None] - place[:, None, :]) ** 2.0).min(axis=2)
        assert np.array_equal(R.lower_envelope(place, height), want)


@pytest.mark.parametrize("many", [1 << 20, 40])
def test_distances_of_sparse_volumes(spark, monkeypatch, many):
    monkeypatch.setattr(lines, "LINE_VOXELS", many)
    rng = np.random.default_rng(2)
    at = sorted({tuple(int(v) for v in p) for p in rng.integers(-9, 9, (300, 3))})
    rows = [(v, *p, int(rng.random() > 0.05)) for v in (0, 3) for p in at]
    zero = {v: np.array([r[1:4] for r in rows if r[0] == v and r[4] == 0]) for v in (0, 3)}
    got = {tuple(r)[:4]: r.distance for r in R.distance_transform(spark.createDataFrame(rows, VOXELS + "mask int").repartition(3)).collect()}
    # distances pass along lines of voxels that are there, so none is too small
    assert len(got) == len(rows) and all(got[r[:4]] == 0 for r in rows if r[4] == 0)
    for r in rows:
        if got[r[:4]] is not None:
            assert got[r[:4]] >= math.sqrt(((zero[r[0]] - r[1:4]) ** 2).sum(axis=1).min()) - 1e-9


def test_distances_of_a_dense_volume(spark):
    rng = np.random.default_rng(3)
    mask = (rng.random((9, 8, 11)) > 0.03).astype(np.int64)
    zero = np.argwhere(mask == 0)
    got = {(r.z, r.y, r.x): r.distance for r in R.distance_transform(table(spark, mask, "mask")).collect()}
    assert got == {i: pytest.approx(math.sqrt(((zero - i) ** 2).sum(axis=1).min())) for i in np.ndindex(mask.shape)}


def test_one_zero_in_a_large_volume(spark):
    n = 100
    df = spark.range(n**3).select(F.lit(0).alias("volume_id"), F.expr(f"id div {n * n}").alias("z"), F.expr(f"id div {n} % {n}").alias("y"), (F.col("id") % n).alias("x"), (F.col("id") != 0).cast("int").alias("mask"))
    plan = R.distance_transform(df)
    assert "explode" not in plan._jdf.queryExecution().optimizedPlan().toString().lower()
    r = plan.agg(F.max("distance").alias("far"), F.sum(F.col("distance") ** 2).alias("all"), F.count("distance").alias("n")).first()
    assert r.n == n**3 and r.far == pytest.approx(math.sqrt(3) * (n - 1)) and r["all"] == pytest.approx(3 * n * n * sum(k * k for k in range(n)))


def slow_flood(level, marks):
    """Voxel by voxel: waves within levels, the first neighbour by place gives the label."""
    labels = {i: int(m) for i, m in np.ndenumerate(marks) if m}

    def around(i):
        for axis, step in ((0, -1), (1, -1), (2, -1), (2, 1), (1, 1), (0, 1)):
            j = tuple(v + step * (k == axis) for k, v in enumerate(i))
            if all(0 <= v < n for v, n in zip(j, marks.shape)):
                yield j

    if labels:
        for now in range(int(level.max()) + 1):
            while wave := {i: next(labels[j] for j in around(i) if j in labels) for i in np.ndindex(marks.shape) if i not in labels and level[i] <= now and any(j in labels for j in around(i))}:
                labels.update(wave)
    return np.array([labels.get(i, 0) for i in np.ndindex(marks.shape)]).reshape(marks.shape)


@pytest.mark.parametrize("steps", [3, 50, 1000])
def test_flood_equals_the_slow_one(steps):
    rng = np.random.default_rng(steps)
    for _ in range(4):
        shape = tuple(rng.integers(1, 9, 3))
        level = R.levels_of(rng.integers(0, steps, shape).astype(float))
        marks = np.where(rng.random(shape) < 0.05, rng.integers(1, 9, shape), 0)
        assert np.array_equal(R.flood(level, marks), slow_flood(level, marks))


def test_levels():
    h = np.array([[[3.0, 1.0, np.inf, 1.0]]])
    assert R.levels_of(h).tolist() == [[[1, 0, 2, 0]]]
    many = R.levels_of(np.random.default_rng(1).random((20, 20, 20)), 256)
    assert many.min() == 0 and many.max() == 255


def test_flood_of_a_million_voxels():
    rng = np.random.default_rng(5)
    shape = (100, 100, 100)
    marks = np.zeros(shape, np.int64)
    marks[tuple(rng.integers(0, 100, (3, 300)))] = np.arange(1, 301)
    began = time.time()
    out = R.flood(R.levels_of(rng.random(shape)), marks)
    assert (out > 0).all() and time.time() - began < 60


def grown(a, steps, mask=None):
    for _ in range(steps):
        new = a.copy()
        for i in np.ndindex(a.shape):
            for axis, step in itertools.product(range(3), (-1, 1)):
                j = tuple(v + step * (k == axis) for k, v in enumerate(i))
                if all(0 <= v < n for v, n in zip(j, a.shape)) and a[i] > 0 and a[j] != a[i] and (mask is None or mask[j] > 0):
                    new[i] = 0
        a = new
    return a


@pytest.mark.parametrize("steps", [1, 4])
def test_boundaries_grow(spark, steps):
    rng = np.random.default_rng(6)
    a, m = np.repeat(np.repeat(rng.integers(0, 3, (2, 3, 3)), 5, axis=1), 5, axis=2), rng.integers(0, 2, (2, 15, 15))
    df = table(spark, a, "label").join(table(spark, m, "mask"), ["volume_id", "z", "y", "x"])
    plain, masked = E.grow_boundary(df, steps), E.grow_boundary(df, steps, mask="mask")
    assert {(r.z, r.y, r.x): r.label for r in plain.collect()} == dict(np.ndenumerate(grown(a, steps)))
    assert {(r.z, r.y, r.x): r.label for r in masked.collect()} == dict(np.ndenumerate(grown(a, steps, m)))


def test_growing_reads_its_input_once(spark, tmp_path):
    table(spark, np.ones((3, 3, 3), np.int64), "label").write.parquet(str(tmp_path / "labels"))
    df = spark.read.parquet(str(tmp_path / "labels"))
    for steps in (1, 4):
        plan = E.grow_boundary(df, steps)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") == 1 and "Join" not in plan


def test_missing_voxels_are_no_neighbours(spark):
    df = spark.createDataFrame([(0, 0, 0, 0, 1), (0, 0, 0, 2, 2)], VOXELS + "label long")
    assert sorted(r.label for r in E.grow_boundary(df, 2).collect()) == [1, 2]


def test_descriptors_in_3d(spark):
    rng = np.random.default_rng(7)
    a = rng.integers(0, 3, (6, 6, 6))
    sigma, r = 0.8, int(3 * 0.8 + 0.5)
    got = {(x.z, x.y, x.x): x.lsds for x in E.shape_descriptors(table(spark, a, "label"), sigma, downsample=1).collect()}
    assert set(got) == {i for i, v in np.ndenumerate(a) if v}
    for i, lsds in got.items():
        d = np.array([np.subtract(j, i) for j, v in np.ndenumerate(a) if v == a[i] and max(abs(np.subtract(j, i))) <= r], float)
        w = np.exp(-0.5 * (d**2).sum(axis=1) / sigma**2)
        mean = (w[:, None] * d).sum(axis=0) / w.sum()
        cov = (w[:, None, None] * d[:, :, None] * d[:, None, :]).sum(axis=0) / w.sum() - mean[:, None] * mean
        want = [*mean, cov[0, 0], cov[1, 1], cov[2, 2], cov[0, 1], cov[0, 2], cov[1, 2], w.sum()]
        assert lsds == pytest.approx(want)


def test_descriptors_make_few_rows(spark):
    n, sigma = 12, 2.0
    a = np.ones((n, n, n), np.int64)
    df = table(spark, a, "label")
    r = int(3 * sigma + 0.5)
    sums = df.select(*E.KEY, "label").withColumn("s_", F.lit(1.0))
    made = 0
    for axis in "xyz":
        made += sums.count() * (2 * r + 1)
        sums = E._weighted_along(sums, axis, sigma, "label", [()])
    # sums reach r beyond the volume, so a pass has at most (n + 2 r) / n times the rows of the one before
    assert made <= 3 * (2 * r + 1) * n**3 * ((n + 2 * r) / n) ** 2 < (2 * r + 1) ** 3 * n**3


@pytest.mark.parametrize("sigma", [0.6, 2.0])
def test_smoothing_reflects_at_borders(spark, sigma):
    a = np.random.default_rng(8).random((5, 9, 7))
    w = D.gaussian_kernel(sigma)
    r, want = len(w) // 2, a
    for axis in range(3):
        padded = np.pad(want, [(r, r) if k == axis else (0, 0) for k in range(3)], "symmetric")
        want = sum(x * np.take(padded, range(k, k + a.shape[axis]), axis) for k, x in enumerate(w))
    plan = D.gaussian(table(spark, a, "raw", "double"), sigma, dict(zip("zyx", a.shape)))
    assert {(v.z, v.y, v.x): v.raw for v in plan.collect()} == {i: pytest.approx(v) for i, v in np.ndenumerate(want)}
    assert "explode" not in plan._jdf.queryExecution().optimizedPlan().toString().lower()


def test_smoothing_skips_missing_voxels(spark):
    df = spark.createDataFrame([(0, 0, 0, 0, 4.0), (0, 0, 0, 2, None), (0, 0, 0, 3, 2.0)], VOXELS + "raw double")
    w = D.gaussian_kernel(0.5)
    got = {r.x: r.raw for r in D.gaussian(df, 0.5, {"x": 5}).collect()}
    r = len(w) // 2
    line = np.pad(np.array([4.0, 0, 0, 2.0, 0]), r, "symmetric")
    assert got == {x: pytest.approx(sum(v * line[x + k] for k, v in enumerate(w))) for x in (0, 2, 3)}
