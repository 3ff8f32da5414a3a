"""Brute force and properties on small inputs."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cortexgrid.functions import pixels as P
from cortexgrid.operators import features as E
from cortexgrid.operators import fragments as R
from cortexgrid.operators import graph as H
from cortexgrid.operators import oplog as L
from cortexgrid.operators import resample as D
from cortexgrid.operators import sections as S
from cortexgrid.operators.components import connected_components
from cortexgrid.plans import fixtures as fx
from cortexgrid.plans import scratch_root
from cortexgrid.plans.queries import QUERIES
from cortexgrid.sources import volumes as V


def cube(spark, a, name="raw"):
    rows = [(0, z, y, x, a[z, y, x].item()) for z, y, x in itertools.product(*map(range, a.shape))]
    return spark.createDataFrame(rows, f"volume_id int, z long, y long, x long, {name} {'double' if a.dtype.kind == 'f' else 'long'}")


def test_components_against_union_find(spark):
    rng = random.Random(3)
    nodes, edges = list(range(60)), [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    parent = list(nodes)
    find = lambda i: i if parent[i] == i else find(parent[i])
    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        parent[b] = a
    got = connected_components(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame([*edges, (None, 3)], "u long, v long"))
    assert {r.node: r.component for r in got.collect()} == {n: find(n) for n in nodes}


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def whole_graph(spark):
    """(nodes, edges, the smallest node of each node's component) of the whole region graph, by union-find."""
    nodes = [r.node for r in fx.graph_nodes(spark, SF).select("node").collect()]
    edges = [(r.u, r.v, r.merge_score) for r in fx.graph_edges(spark, SF).select("u", "v", "merge_score").collect()]
    place = {n: n for n in {*nodes, *(x for u, v, _ in edges for x in (u, v))}}

    def find(i):
        while place[i] != i:
            i = place[i]
        return i

    for u, v, score in edges:
        if score is not None and score <= 0.01:
            a, b = sorted((find(u), find(v)))
            place[b] = a
    return nodes, edges, {n: find(n) for n in place}


def test_components_of_the_whole_graph(spark, whole_graph):
    _, edges, place = whole_graph
    want = {x: place[x] for u, v, score in edges if score is not None and score <= 0.01 for x in (u, v)}
    assert {r.node: r.component for r in QUERIES["f9_components"](spark, SF).collect()} == want and any(n % 7 for n in want if n < 1000000)


def test_segment_and_contract_of_the_whole_graph(spark, whole_graph):
    nodes, edges, place = whole_graph
    number = {c: i for i, c in enumerate(sorted({place[n] for n in nodes}), 1)}
    assert {r.node: r.segment for r in QUERIES["f17_segment"](spark, SF).collect()} == {n: number[place[n]] for n in nodes}
    between = {tuple(sorted((place[u], place[v]))) for u, v, _ in edges if place[u] != place[v]}
    assert sorted((r.u, r.v) for r in QUERIES["f18_contract"](spark, SF).collect()) == sorted(between)
    members = {}
    for n in sorted(nodes):
        members.setdefault(place[n], []).append(str(n))
    assert {r.node: r.labels for r in QUERIES["f18_contract_nodes"](spark, SF).collect()} == {c: ",".join(m) for c, m in members.items()}


def test_components_without_edges(spark):
    got = connected_components(spark.createDataFrame([(5,), (5,)], "node long"), spark.createDataFrame([], "u long, v long"))
    assert [tuple(r) for r in got.collect()] == [(5, 5)]


def test_distance_transform_3d(spark):
    rng = np.random.default_rng(1)
    m = (rng.random((4, 5, 6)) > 0.15).astype(np.int64)
    zero = np.argwhere(m == 0)
    got = {(r.z, r.y, r.x): r.distance for r in R.distance_transform(cube(spark, m, "mask")).collect()}
    for at in itertools.product(*map(range, m.shape)):
        assert got[at] == pytest.approx(np.sqrt(((zero - at) ** 2).sum(axis=1).min()))


def test_distance_without_zeros_is_null(spark):
    assert R.distance_transform(cube(spark, np.ones((2, 2, 2), np.int64), "mask")).where("distance is not null").isEmpty()


def test_agglomerate_equals_best_first(spark):
    rng = random.Random(5)
    for _ in range(3):
        n = 8
        edges = [(u, v, rng.randint(1, 5), rng.random()) for u in range(n) for v in range(u + 1, n) if rng.random() < 0.5]
        live = {(u, v): [c, c * s] for u, v, c, s in edges}
        place = list(range(n))
        while live:
            (u, v), (c, s) = min(live.items(), key=lambda e: (e[1][1] / e[1][0], e[0]))
            if s / c > 0.5:
                break
            place = [u if p == v else p for p in place]
            merged = {}
            for (a, b), (k, t) in live.items():
                a, b = sorted((u if a == v else a, u if b == v else b))
                if a != b:
                    x = merged.setdefault((a, b), [0, 0.0])
                    x[0] += k
                    x[1] += t
            live = merged
        e = spark.createDataFrame(edges, "u long, v long, contacts long, merge_score double")
        got = H.agglomerate(spark.createDataFrame([(i,) for i in range(n)], "node long"), e, 0.5)
        assert {r.node: r.segment for r in got.collect()} == dict(enumerate(place))


def test_coarser_thresholds_only_merge(spark):
    edges = spark.createDataFrame([(1, 2, 0.36), (2, 3, 0.52), (3, 4, 0.9)], "u long, v long, merge_score double")
    rows = H.sweep(spark.createDataFrame([(i,) for i in range(1, 5)], "node long"), edges).collect()
    assert {r.name for r in rows} == {H.threshold_name(t) for t in H.THRESHOLDS} and H.threshold_name(0.4) == "segmentation_04"
    assert {r.node: r.segment for r in rows if r.name == "segmentation_075"} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_pad_then_crop_and_invert_twice(spark):
    a = np.arange(3 * 4 * 5).reshape(3, 4, 5)
    padded = D.pad_to_multiple(cube(spark, a), a.shape, (4, 4, 4))
    assert padded.count() == 4 * 4 * 8
    inner = {(r.z, r.y, r.x - 1): r.raw for r in padded.where("z < 3 and x between 1 and 5").collect()}
    assert all(inner[i] == a[i] for i in itertools.product(*map(range, a.shape)))
    twice = cube(spark, a).select("raw", P.invert(P.invert(F.col("raw"))).alias("again"))
    assert twice.where("raw != again").isEmpty()


def test_all_nan_channels(spark):
    nan = float("nan")
    r = spark.createDataFrame([([nan, nan],)], "c array<double>").select(P.merge_channels(F.col("c")).alias("s"), P.max_channel(F.col("c")).alias("m")).first()
    assert r.s == 0 and np.isnan(r.m)


def test_background_must_occur(spark):
    with pytest.raises(ValueError):
        S.background_mask(cube(spark, np.ones((1, 2, 2), np.int64), "label"), -3)


def test_complete_or_error(spark):
    grid = spark.range(3).withColumnRenamed("id", "block_id")
    L.assert_complete(grid, grid)
    with pytest.raises(RuntimeError):
        L.assert_complete(grid, grid.where("block_id < 2"))


def test_volumes_on_disk(spark, tmp_path):
    a = np.random.default_rng(0).integers(0, 255, (5, 6, 7))
    path = f"{tmp_path}/one.zarr"
    V.write_volume(cube(spark, a).withColumnRenamed("raw", "value"), path, "volumes/raw/s0", a.shape, (2, 4, 4))
    got = V.read_volume(spark, path, "volumes/raw")
    assert all(a[r.z, r.y, r.x] == r.value for r in got.collect()) and got.count() == a.size
    assert [r.dataset for r in V.list_datasets(spark, path).collect()] == ["volumes/raw/s0"]
    with pytest.raises(ValueError):
        V.read_volume(spark, f"{tmp_path}/one.tiff", "volumes/raw")
    with pytest.raises(FileNotFoundError):
        V.read_volume(spark, path, "volumes/none")


def test_image_folder(spark, tmp_path):
    def bmp(pixels):  # 24-bit, bottom up, rows padded to 4 bytes
        h, w = len(pixels), len(pixels[0])
        rows = b"".join(bytes(v for p in row for v in (p, p, p)) + b"\0" * (-3 * w % 4) for row in reversed(pixels))
        return b"BM" + (54 + len(rows)).to_bytes(4, "little") + b"\0" * 4 + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + w.to_bytes(4, "little") + h.to_bytes(4, "little") + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + b"\0" * 24 + rows

    for i, v in ((10, 7), (9, 200)):
        (tmp_path / f"s{i}.bmp").write_bytes(bmp([[v, 0], [1, 2], [3, 4]]))
    got = {(r.section_id, r.y, r.x): r.value for r in V.read_sections(spark, str(tmp_path)).collect()}
    assert got[0, 0, 0] == 200 and got[1, 0, 0] == 7 and got[1, 2, 1] == 4 and len(got) == 12


def test_ssim_of_equal_images_is_one(spark):
    rows = [(0, y, x, (y * x) % 9, (y * x) % 9) for y in range(9) for x in range(9)]
    assert D.ssim(spark.createDataFrame(rows, "pair_id long, y long, x long, a int, b int"), 9, 9).first().score == pytest.approx(1.0)


def test_an_edge_at_a_threshold_merges(spark):
    met = [(1, 2, a) for a in [0.65] * 13] + [(2, 3, 0.6499999)]
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "node long")
    edges = H.score_edges(spark.createDataFrame(met, "u long, v long, a double"))
    for found in (H.agglomerate(nodes, edges, 0.35), H.segment(nodes, edges, 0.35), H.sweep(nodes, edges, (0.35,)).drop("name")):
        got = {r.node: r.segment for r in found.collect()}
        assert got[1] == got[2] != got[3]


def test_seeds_of_two_volumes(spark):
    rows = [(v, 0, 0, x, s) for v, seeds in ((0, (0, 1)), (1, (1, 2, 5))) for x in range(6) for s in [int(x in seeds)]]
    got = R.label_seeds(spark.createDataFrame(rows, "volume_id int, z long, y long, x long, seed int"), ("y", "x"))
    assert {(r.volume_id, r.x): r.seed_id for r in got.collect()} == {(0, 0): 1, (0, 1): 1, (1, 1): 2, (1, 2): 2, (1, 5): 3}


def test_descriptors_of_another_label_in_3d(spark):
    a = np.random.default_rng(5).integers(0, 3, (6, 6, 6))
    sigma, got = 1.0, {(r.z, r.y, r.x): r.lsds for r in E.shape_descriptors(cube(spark, a, "cell"), 1.0, downsample=2, label="cell").collect()}
    small = a[::2, ::2, ::2]
    inside = [tuple(p) for p in np.argwhere(small > 0)]
    assert set(got) == set(inside)
    for p in inside:
        near = [np.subtract(q, p) for q in inside if small[q] == small[p] and max(abs(i - j) for i, j in zip(p, q)) <= 3 * sigma]
        w = np.array([np.exp(-0.5 * (d @ d) / sigma**2) for d in near])
        d = np.array(near, float)
        mean = w @ d / w.sum()
        cov = np.einsum("i,ij,ik->jk", w, d, d) / w.sum() - np.outer(mean, mean)
        assert got[p] == pytest.approx([*mean, cov[0, 0], cov[1, 1], cov[2, 2], cov[0, 1], cov[0, 2], cov[1, 2], w.sum()], abs=1e-9)


def test_a_box_opens_only_its_chunks(spark, tmp_path):
    path = f"{tmp_path}/v.zarr"
    a = np.arange(8 * 4).reshape(1, 8, 4)
    df = cube(spark, a, "value")
    V.write_volume(df, path, "raw", a.shape, (1, 2, 2))
    for name in ("0.2.0", "0.3.1"):  # outside the box: opening them would fail
        (tmp_path / "v.zarr" / "raw" / name).write_bytes(b"no chunk")
    (tmp_path / "v.zarr" / "raw" / "0.1.0").unlink()  # inside: the fill value
    got = {(r.y, r.x): r.value for r in V.read_volume(spark, path, "raw", ((0, 1, 0), (1, 4, 4))).collect()}
    assert got == {(y, x): 0 if y > 1 and x < 2 else a[0, y, x] for y in range(1, 4) for x in range(4)}
    assert V.read_volume(spark, path, "raw", ((0, 3, 0), (1, 3, 4))).count() == 0


def test_numbered_sections_and_globs(spark, tmp_path):
    rng, want = np.random.default_rng(2), {}
    for name, sections in (("b", 12), ("a", 2)):
        for n in range(sections):
            own = rng.integers(0, 200, (1, 4, 4))
            V.write_volume(cube(spark, own, "value"), f"{tmp_path}/{name}.zarr", f"raw/{n}", (4, 4), (2, 4))
            want |= {(f"{name}.zarr", n, y, x): int(own[0, y, x]) for y in range(4) for x in range(4)}
    got = V.read_volumes(spark, f"{tmp_path}/*.zarr", "raw")
    assert {(r.volume_id, r.z, r.y, r.x): r.value for r in got.collect()} == want
    with pytest.raises(FileNotFoundError):
        V.read_volumes(spark, f"{tmp_path}/none*.zarr", "raw")


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(RuntimeError):
        scratch_root(Session)


@pytest.mark.parametrize("parts", [1, 7])
def test_fragment_whose_mean_is_the_threshold_stays(spark, parts):
    rows = [(0, z, y, 0, 1 + (z == 99)) for z in range(100) for y in range(10)]
    df = spark.createDataFrame(rows, "volume_id int, z long, y long, x long, fragment long").coalesce(1).repartition(parts)
    mean = F.when(F.col("fragment") == 1, 0.1).otherwise(0.0999)
    affs = df.select(*R.KEY, F.array(F.lit(9.0), mean, mean).alias("affs"))
    got = R.filter_fragments(df, affs, 0.1, True).groupBy("fragment").count().collect()
    assert {r.fragment: r["count"] for r in got} == {1: 990, 0: 10}


def test_descriptors_pass_no_sums_on(spark):
    plan = E.shape_descriptors(cube(spark, np.ones((3, 3, 3), np.int64), "label"), 1.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan


def test_graph_is_written_in_few_pieces(spark, tmp_path):
    nodes = spark.createDataFrame([(i, float(i % 2), 0.0, 0.0) for i in range(400)], "node long, center_z double, center_y double, center_x double").repartition(8)
    H.write_rag(nodes, nodes.select(F.col("node").alias("u"), (F.col("node") + 1).alias("v"), *(f"center_{a}" for a in "zyx")), str(tmp_path / "rag"), (0, 0, 0), (2, 1, 1), (1, 1, 1))
    for name in ("nodes", "edges"):
        assert spark.read.parquet(str(tmp_path / "rag" / name)).count() == 400
        assert len(list((tmp_path / "rag" / name).rglob("*.parquet"))) == 2


def test_affinities_join_whole_sections_once(spark):
    assert fx.affs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


@pytest.mark.parametrize("name", ["f21_agglomerate", "f22_sweep"])
def test_edges_are_scored_from_sums_of_blocks(spark, monkeypatch, name):
    def never(*_):
        raise AssertionError("a row for each contact")

    monkeypatch.setattr(H, "contacts", never)
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count()


def test_images_are_opened_once(spark):
    found = QUERIES["a9_read_sections"](spark, "/root/testdata/sf0.001")
    assert found.inputFiles() and all(f.endswith(".parquet") for f in found.inputFiles())
