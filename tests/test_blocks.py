"""Kernels on blocks of arrays against plain loops, for volumes with holes and any block size."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cortexgrid.operators import blocks
from cortexgrid.operators import features as E
from cortexgrid.operators import graph as H

VOXELS = "volume_id string, z long, y long, x long, label long, mask int, affs array<double>"
SIZES = [(2, 3, 2), (32, 64, 64)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    return [
        (v, z, y, x, rng.choice([0, 1, 1, 2, 3]), rng.choice([0, 1, None]), [rng.randint(0, 40) / 40 for _ in range(3)] if rng.random() < 0.9 else None)
        for v in ("a", "b") for z in range(-3, 4) for y in range(-2, 5) for x in range(6) if rng.random() < 0.85
    ]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, VOXELS).repartition(4)


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("offsets", [E.SHORT, E.SHORT_2D, ((-1, 0, 0), (0, 3, -2), (2, 0, 0), (0, -4, 0))])
def test_affinities_and_masks(df, rows, offsets, size):
    label = {r[:4]: r[4] for r in rows}
    mask = {r[:4]: r[5] or 0 for r in rows}
    to = lambda k, o: (k[0], *(a + b for a, b in zip(k[1:], o)))
    got = {tuple(r)[:4]: r.affs for r in E.affinities(df, offsets, block=size).collect()}
    assert got == {k: [int(v > 0 and label.get(to(k, o)) == v) for o in offsets] for k, v in label.items()}
    got = {tuple(r)[:4]: r.affs_mask for r in E.affinity_mask(df, offsets, block=size).collect()}
    assert got == {k: [int(v > 0 and mask.get(to(k, o), 0) > 0) for o in offsets] for k, v in mask.items()}


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("connectivity", [1, 2])
def test_touching_labels(df, rows, connectivity, size):
    label = {r[:4]: r[4] for r in rows}
    want = set()
    for (v, z, y, x), n in label.items():
        for dz, dy, dx in H.half_neighbourhood(connectivity):
            m = label.get((v, z + dz, y + dy, x + dx), 0)
            if n > 0 and m > 0 and n != m:
                want.add((min(n, m), max(n, m)))
    assert {tuple(r) for r in H.rag_edges(df, connectivity, block=size).collect()} == want


@pytest.mark.parametrize("size", SIZES)
def test_contacts_by_block_equal_contacts_by_join(df, size):
    labels, affs = df.select("volume_id", "z", "y", "x", "label"), df.where("affs is not null").select("volume_id", "z", "y", "x", "affs")
    bins = H.contact_bins(labels, affs, block=size)
    met = H.contacts(labels, affs)
    want = Counter((r.u, r.v, min(int(r.a * 255), 255)) for r in met.collect())
    assert {(r.u, r.v, r.bin): r.n for r in bins.collect()} == want
    for how in ("mean", "quantile"):
        assert sorted(map(tuple, H.score_bins(bins, how).collect())) == sorted(map(tuple, H.score_edges(met, how).collect()))


def test_a_voxel_moves_once_and_into_halos(spark, df):
    n = 12
    whole = spark.range(n**3).select(F.lit(0).alias("volume_id"), F.expr(f"id div {n * n}").alias("z"), F.expr(f"id div {n} % {n}").alias("y"), (F.col("id") % n).alias("x"), F.lit(1).cast("long").alias("label"))
    offsets = E.SHORT * 1
    count = lambda b: {"n": blocks.pa.array([int(b.present.sum())])}
    moved = blocks.map_arrays(whole, ["label"], count, "n long", offsets, (6, 6, 6)).agg(F.sum("n")).first()[0]
    # a halo of one voxel below, on blocks of six; blocks beyond the volume hold its last face only
    assert moved == (n + 2) ** 3
    assert blocks.halo_of(((-1, 0, 2), (0, -3, 0))) == ([1, 3, 0], [0, 0, 2])


def test_empty_volumes(df):
    none = df.limit(0)
    assert E.affinities(none).count() == 0 and H.rag_edges(none).count() == 0 and H.contact_bins(none.drop("affs"), none).count() == 0
