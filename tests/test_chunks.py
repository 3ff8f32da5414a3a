"""The chunked-volume format: reads by filter, writes with a commit."""

import gzip
import json
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual

from cortexgrid.sources import volumes as V
from cortexgrid.sources.chunks import VolumeReader, VolumeWriter, Written, load


def container(tmp_path, a, chunk, fill=0, skip=(), compressor=True):
    at = tmp_path / "v.zarr" / "raw"
    os.makedirs(at)
    (at / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": a.shape, "chunks": chunk, "dtype": a.dtype.str, "compressor": {"id": "gzip", "level": 1} if compressor else None, "fill_value": fill, "order": "C", "filters": None}))
    for index in np.ndindex(*(-(-n // c) for n, c in zip(a.shape, chunk))):
        if index not in skip:
            block = np.zeros(chunk, a.dtype)
            part = a[tuple(slice(i * c, (i + 1) * c) for i, c in zip(index, chunk))]
            block[tuple(map(slice, part.shape))] = part
            raw = block.tobytes()
            (at / ".".join(map(str, index))).write_bytes(gzip.compress(raw) if compressor else raw)
    return str(tmp_path / "v.zarr")


def voxels(df):
    return {(r.z, r.y, r.x): r.value for r in df.collect()}


def test_filters_open_only_their_chunks(spark, tmp_path):
    a = np.arange(6 * 7 * 8, dtype=np.uint16).reshape(6, 7, 8)
    path = container(tmp_path, a, (2, 3, 4))
    # any chunk outside of the box would be an error
    for name in os.listdir(f"{path}/raw"):
        if name[0] != "." and name not in ("1.0.0", "1.1.0", "2.0.0", "2.1.0"):
            with open(f"{path}/raw/{name}", "wb") as f:
                f.write(b"broken")
    got = voxels(load(spark, path, "raw").where("z > 1 and z <= 5 and y < 6 and x = 3 and value % 2 = 1"))
    assert got == {i: int(v) for i, v in np.ndenumerate(a) if 1 < i[0] <= 5 and i[1] < 6 and i[2] == 3 and v % 2 == 1}
    got = voxels(V.read_volume(spark, path, "raw", ((3, 0, 1), (6, 5, 4))))
    assert got == {i: int(v) for i, v in np.ndenumerate(a) if 3 <= i[0] and i[1] < 5 and 1 <= i[2] < 4}
    with pytest.raises(Exception, match="gzip|BadGzip|broken"):
        load(spark, path, "raw").agg(F.sum("value")).collect()


@pytest.mark.parametrize(
    "condition", ["z in (1, 5)", "z > 1.5 and z < 4.5", "x >= 2 or y = 1", "z = 9", "not (z = 2)", "z between 2 and 3 and x is not null", "y <= 2 and y > 2", "volume_id = 'v.zarr' and x > 6", "z > y"]
)
def test_filters_give_what_they_give_without_pushdown(spark, tmp_path, condition):
    a = np.random.default_rng(3).random((6, 7, 8)).astype(np.float32)
    path = container(tmp_path, a, (4, 4, 4), compressor=False)
    whole = load(spark, path, "raw")
    kept = spark.createDataFrame(whole.collect(), whole.schema).where(condition)
    assert voxels(whole.where(condition)) == voxels(kept)


def test_box_of_filters(tmp_path):
    path = container(tmp_path, np.zeros((6, 7, 8), np.uint8), (2, 3, 4))
    reader = VolumeReader(path, "raw", "v")
    given = [GreaterThan(("z",), 1), LessThanOrEqual(("z",), 3), In(("y",), (4, 5)), EqualTo(("value",), 3), GreaterThanOrEqual(("x",), 2.5), LessThan(("x",), 4)]
    left = list(reader.pushFilters(given))
    assert left == [given[2], given[3]] and (reader.low, reader.high) == ([2, 4, 3], [4, 6, 4])
    assert [c for p in reader.partitions() for c in reader.chunks(p)] == [(1, 1, 0)]


def test_missing_chunks(spark, tmp_path):
    a = np.full((4, 4), 9, np.int32)
    path = container(tmp_path / "filled", a, (2, 2), fill=5, skip=[(0, 1)])
    assert sorted(voxels(load(spark, path, "raw")).items()) == [((0, y, x), 5 if y < 2 <= x else 9) for y in range(4) for x in range(4)]
    path = container(tmp_path / "null", a, (2, 2), fill=None, skip=[(0, 1)])
    assert load(spark, path, "raw").count() == 12 and load(spark, path, "raw").where("z = 1").count() == 0


def test_a_million_chunk_positions_plan_in_seconds(spark, tmp_path):
    at = tmp_path / "v.zarr" / "raw"
    os.makedirs(at)
    (at / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": [100_000] * 3, "chunks": [1000] * 3, "dtype": "|u1", "compressor": None, "fill_value": None, "order": "C"}))
    began = time.time()
    reader = VolumeReader(str(tmp_path / "v.zarr"), "raw", "v")
    assert sum(p.last - p.first for p in reader.partitions()) == 10**6
    assert time.time() - began < 10
    began = time.time()
    assert load(spark, str(tmp_path / "v.zarr"), "raw").where("z between 70000 and 70010 and y < 2000").count() == 0
    assert time.time() - began < 60


def rows(spark, a):
    return spark.createDataFrame([(*i, v.item()) for i, v in np.ndenumerate(a)], "z long, y long, x long, value long").repartition(5)


def test_write_and_read_back(spark, tmp_path):
    a = np.random.default_rng(4).integers(-5, 2000, (5, 6, 7))
    path = str(tmp_path / "w.zarr")
    V.write_volume(rows(spark, a), path, "labels", a.shape, (2, 4, 3), "<i4", {"resolution": [8, 8, 8]})
    assert voxels(V.read_volume(spark, path, "labels")) == {i: int(v) for i, v in np.ndenumerate(a)}
    assert V.volume_meta(spark, path, "labels")[2] == {"resolution": [8, 8, 8]}
    assert sorted(os.listdir(path)) == ["labels"]
    V.write_volume(rows(spark, a[:2]), path, "labels", (2, 6, 7), (2, 4, 3), "<i4")  # replaces
    assert V.read_volume(spark, path, "labels").count() == 2 * 6 * 7


def test_a_failed_write_leaves_the_old_dataset(spark, tmp_path):
    a = np.arange(4 * 4 * 4).reshape(4, 4, 4)
    path = str(tmp_path / "w.zarr")
    V.write_volume(rows(spark, a), path, "raw", a.shape, (2, 2, 2), "<i8")
    bad = rows(spark, a).withColumn("value", F.when(F.col("z") == 3, F.raise_error(F.lit("killed in mid-write")).cast("long")).otherwise(F.lit(1)))
    with pytest.raises(Exception, match="killed"):
        V.write_volume(bad, path, "raw", a.shape, (2, 2, 2), "<i8")
    assert voxels(V.read_volume(spark, path, "raw")) == {i: int(v) for i, v in np.ndenumerate(a)}
    assert os.listdir(path) == ["raw"]


def test_chunks_of_several_tasks_are_refused(spark, tmp_path):
    path = str(tmp_path / "w.zarr")
    writer = VolumeWriter(path, "raw", [4, 4, 4], [2, 2, 2], "|u1", {}, True)
    writer._put("0.0.0", b"x")
    with pytest.raises(ValueError):
        writer.commit([Written([(0, 0, 0)]), Written([(0, 0, 0)])])
    assert not os.listdir(path)


def test_append_adds_chunks(spark, tmp_path):
    a = np.arange(4 * 2 * 2).reshape(4, 2, 2)
    path = str(tmp_path / "w.zarr")
    V.write_volume(rows(spark, a).where("z < 2"), path, "raw", a.shape, (2, 2, 2), "<i8")
    V.write_volume(rows(spark, a).where("z >= 2"), path, "raw", a.shape, (2, 2, 2), "<i8", mode="append")
    assert voxels(V.read_volume(spark, path, "raw")) == {i: int(v) for i, v in np.ndenumerate(a)}
