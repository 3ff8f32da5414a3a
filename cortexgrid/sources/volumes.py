"""Chunked volumes (.zarray and one file for each chunk) and image folders.

Chunk files are listed and read by Spark's binaryFile source, so any store that Spark reads will do and each chunk is a
record; a box lists only the names of the chunks that it meets. Decoding is per chunk, in Arrow batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cortexgrid.operators.grid import AXES
from cortexgrid.operators.graph import dense_ids
from cortexgrid.plans import materialize
from cortexgrid.sources.chunks import FORMAT, Array, check_format, load, register, unpack


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    p, store = _hadoop(spark, path)
    return bool(store.exists(p))


def _json(spark: SparkSession, path: str) -> dict:
    """A small metadata file; Spark's readers skip names that begin with a dot."""
    p, store = _hadoop(spark, path)
    stream = store.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def volume_meta(spark: SparkSession, path: str, dataset: str) -> tuple[str, dict, dict]:
    """(path of the array, .zarray, .zattrs); falls back to <dataset>/s0."""
    check_format(path)
    for name in (dataset, f"{dataset}/s0"):
        at = f"{path.rstrip('/')}/{name}"
        if _exists(spark, f"{at}/.zarray"):
            return at, _json(spark, f"{at}/.zarray"), _json(spark, f"{at}/.zattrs") if _exists(spark, f"{at}/.zattrs") else {}
    raise FileNotFoundError(f"{path}/{dataset}")


def _matches(spark: SparkSession, glob: str) -> list[str]:
    """Paths of a glob, in natural order; a listing, no data."""
    p, store = _hadoop(spark, glob)
    return sorted((f.getPath().toString() for f in store.globStatus(p) or ()), key=natural_key)


def _check_compressor(packed: dict | None) -> None:
    if packed and packed["id"] not in ("gzip", "zlib", "bz2", "lzma", "zstd"):
        try:
            import numcodecs  # noqa: F401
        except ImportError:
            raise ValueError(f"unknown compressor {packed['id']}") from None


def _read_arrays(spark: SparkSession, arrays: Sequence[str], meta: dict, roi: tuple[Sequence[int], Sequence[int]] | None) -> DataFrame:
    """(array, z, y, x, value) of arrays with one shape, chunk and type, by one scan of the chunk files that the box meets.

    array is the number in the given order. Chunks without a file hold the fill value; where that is null they give no rows.
    """
    shape, chunk = meta["shape"], meta["chunks"]
    dims, sep = len(shape), meta.get("dimension_separator", ".")
    dtype, packed, order = np.dtype(meta["dtype"]), meta["compressor"], meta.get("order", "C")
    _check_compressor(packed)
    low = [max(0, b) for b in roi[0][-dims:]] if roi else [0] * dims
    high = [min(e, n) for e, n in zip(roi[1][-dims:], shape)] if roi else list(shape)
    spans = [range(b // c, max(b // c, -(-e // c))) for b, e, c in zip(low, high, chunk)]
    kind, schema = ("double" if dtype.kind == "f" else "long"), "array int, z long, y long, x long, value "
    if not all(spans) or not arrays:
        return spark.createDataFrame([], schema + kind)
    names = sep.join("{" + ",".join(map(str, span)) + "}" for span in spans)
    globs = [f"{at}/{names}" for at in arrays]
    globs = [g for g in globs if _matches(spark, g)]
    wanted = spark.range(len(arrays)).select(F.col("id").cast("int").alias("array"))
    for i, span in enumerate(spans):
        wanted = wanted.withColumn(f"c{i}", F.explode(F.sequence(F.lit(span[0]).cast("long"), F.lit(span[-1]).cast("long"))))
    index = [f"c{i}" for i in range(dims)]
    number = F.create_map(*(x for i, at in enumerate(arrays) for x in (F.lit(_qualified(spark, at)), F.lit(i))))
    pattern = "^(.*)/" + r"[/.]".join(["([0-9]+)"] * dims) + "$"

    def files(content: bool) -> DataFrame:
        if not globs:
            return spark.createDataFrame([], "array int, " + "".join(f"{c} long, " for c in index) + "content binary")
        found = spark.read.format("binaryFile").load(globs)
        place = [F.regexp_extract("path", pattern, i + 2).cast("long").alias(c) for i, c in enumerate(index)]
        array = F.try_element_at(number, F.regexp_extract("path", pattern, 1)).alias("array")
        return found.select(array, *place, *([F.col("content")] if content else []))

    fill = meta.get("fill_value")
    chunks = files(True)
    if fill is not None:
        # names only are compared, contents aren't shuffled
        chunks = chunks.unionByName(wanted.join(files(False), ["array", *index], "left_anti").withColumn("content", F.lit(None).cast("binary")))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for array, *place, content in zip(*(c.to_pylist() for c in batch.columns[:-1]), batch.columns[-1]):
                if (raw := content.as_py()) is None:
                    block = np.full(chunk, fill, dtype)
                else:
                    block = np.frombuffer(unpack(raw, packed, dtype.itemsize * int(np.prod(chunk))), dtype).reshape(chunk, order=order)
                grids = np.indices(chunk).reshape(dims, -1) + (np.array(place) * chunk)[:, None]
                keep = np.all((grids >= np.array(low)[:, None]) & (grids < np.array(high)[:, None]), axis=0)
                values = block.ravel()[keep]
                values = values.astype(np.float64) if dtype.kind == "f" else values.astype(np.int64)
                coordinates = [np.zeros(keep.sum(), np.int64)] * (3 - dims) + list(grids[:, keep])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(keep.sum(), array, np.int32)), *map(pa.array, coordinates), pa.array(values)], names=["array", "z", "y", "x", "value"])

    return chunks.mapInArrow(decode, schema + kind)


def _qualified(spark: SparkSession, path: str) -> str:
    p, store = _hadoop(spark, path)
    return store.makeQualified(p).toString()


def read_volume(spark: SparkSession, path: str, dataset: str, roi: tuple[Sequence[int], Sequence[int]] | None = None, volume_id: str | None = None) -> DataFrame:
    """A1: (volume_id, z, y, x, value) of a 2D or 3D array; 2D ones have z 0. roi is (begin, end) in voxels.

    Any filter of z, y and x on the result does what roi does: only chunks that it meets are opened, none is listed (see
    chunks). Missing chunks hold the fill value. uint64 comes as bigint in two's complement.
    """
    axes = Array(path, dataset).axes  # errors at once, not in Spark's planning
    out = load(spark, path, dataset, volume_id)
    for axis, begin, end in zip(AXES[-len(roi[0]) :], *roi) if roi else ():
        if axis in axes:
            out = out.where((F.col(axis) >= int(begin)) & (F.col(axis) < int(end)))
    return out


def write_volume(df: DataFrame, path: str, dataset: str, shape: Sequence[int], chunk: Sequence[int], dtype: str = "|u1", attributes: dict | None = None, mode: str = "overwrite", raw: DataFrame | None = None) -> None:
    """A4: voxels (z, y, x, value) as a gzip-5 array; voxels without a row hold 0. A shape of two numbers takes y and x only.

    Rows are dealt by chunk, each chunk is encoded and written by one task, and the array appears in its place when all
    are done: a job that fails leaves the old one whole. mode append puts chunks beside those there. raw, where given,
    goes to <root>/volumes/raw next to it.
    """
    register(df.sparkSession)
    place = [F.floor(F.col(a) / n).alias(f"c{a}") for a, n in zip(AXES[-len(shape) :], chunk)]
    dealt = df.select("z", "y", "x", "value", *place)
    names = dealt.columns[4:]
    dealt = dealt.repartition(*names).sortWithinPartitions(*names).select("z", "y", "x", "value")
    options = {"dataset": dataset, "shape": json.dumps(list(shape)), "chunk": json.dumps(list(chunk)), "dtype": dtype, "attributes": json.dumps(attributes or {})}
    dealt.write.format(FORMAT).options(**options).mode(mode).save(path)
    if raw is not None:
        write_volume(raw, path, "volumes/raw", shape, chunk, "|u1", attributes, mode)


def list_datasets(spark: SparkSession, path: str) -> DataFrame:
    """A5: (dataset,) of every array below a container."""
    p, store = _hadoop(spark, path)
    top, found = store.makeQualified(p).toString().rstrip("/"), []
    files = store.listFiles(p, True)
    while files.hasNext():  # the container's listing: names, no data
        name = files.next().getPath().toString()
        if name.endswith("/.zarray"):
            found.append((name[len(top) + 1 : -len("/.zarray")],))
    return spark.createDataFrame(sorted(found), "dataset string")


def read_volumes(spark: SparkSession, paths: Sequence[str] | str, dataset: str) -> DataFrame:
    """Several containers (a list or a glob) in one table; sections dataset/0, dataset/1, ... have their number as z.

    Arrays of one shape, chunk and type are one scan, however many sections there are.
    """
    found = _matches(spark, paths) if isinstance(paths, str) else sorted(paths, key=natural_key)
    alike: dict[str, tuple[dict, list[tuple[str, str, int | None]]]] = {}
    for path in found:
        names = [r.dataset for r in list_datasets(spark, path).collect()]
        sections = sorted((n for n in names if n.startswith(f"{dataset}/") and n.rsplit("/", 1)[-1].isdigit()), key=natural_key)
        for n in sections or [dataset]:
            at, meta, _ = volume_meta(spark, path, n)
            own = path.rstrip("/").rsplit("/", 1)[-1], at, int(n.rsplit("/", 1)[-1]) if sections else None
            alike.setdefault(json.dumps(meta, sort_keys=True), (meta, []))[1].append(own)
    out = None
    for meta, own in alike.values():
        at = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("array") + 1)
        z = F.coalesce(at([x[2] for x in own]).cast("bigint"), F.col("z"))
        part = _read_arrays(spark, [x[1] for x in own], meta, None).select(at([x[0] for x in own]).alias("volume_id"), z.alias("z"), "y", "x", "value")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise FileNotFoundError(str(paths))
    return out


def natural_key(name: str) -> list:
    return [int(p) if p.isdigit() else p.lower() for p in re.split(r"([0-9]+)", name)]


def copy_datasets(spark: SparkSession, sources: Sequence[str], target: str, names: Sequence[str]) -> None:
    """The named datasets of each source, where it has them, to <target>/<source's name>, replacing."""
    for source in sources:
        have = {r.dataset for r in list_datasets(spark, source).collect()}
        for name in names:
            if name in have:
                _, meta, attributes = volume_meta(spark, source, name)
                write_volume(read_volume(spark, source, name), f"{target}/{source.rstrip('/').rsplit('/', 1)[-1]}", name, meta["shape"], meta["chunks"], meta["dtype"], attributes)


#: Pixels of small images that go into one batch of rows.
PIXELS_AT_ONCE = 1 << 18


def read_sections(spark: SparkSession, folder: str) -> DataFrame:
    """(section_id, name, y, x, value) of the images in a folder, names sorted, grey 0..255."""
    images = spark.read.format("image").option("dropInvalid", "true").load(folder).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")
    images = materialize(images, "images")  # each file is opened once
    parts = F.transform(F.regexp_extract_all(F.lower("origin"), F.lit("([0-9]+|[^0-9]+)")), lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, 20, "0")).otherwise(p))
    # names alone are ranked; pixels are joined with their number
    number = dense_ids(images.select(parts.alias("_key"), "origin")).select("origin", (F.col("_id") - 1).alias("section_id"))
    images = images.join(number, "origin").select("section_id", *images.columns)

    def rows_of(batch: pa.RecordBatch, held: list[tuple]) -> pa.RecordBatch:
        rows, sections, high, wide, grey = zip(*held)
        sizes = np.multiply(high, wide)
        own = np.repeat(np.arange(len(held)), sizes)
        at = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        y, x = np.divmod(at, np.array(wide)[own])
        names = batch.column(1).take(pa.array(np.array(rows)[own]))
        return pa.RecordBatch.from_arrays([pa.array(np.array(sections, np.int64)[own]), names, pa.array(y.astype(np.int64)), pa.array(x.astype(np.int64)), pa.array(np.concatenate(grey))], names=["section_id", "name", "y", "x", "value"])

    def pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            size = 0
            for k, (section, h, w, c, data) in enumerate(zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5)))):
                a = np.frombuffer(data, np.uint8).reshape(h, w, c).astype(np.float64)
                grey = a[:, :, 0] if c == 1 else 0.114 * a[:, :, 0] + 0.587 * a[:, :, 1] + 0.299 * a[:, :, 2]  # stored as BGR
                held.append((k, section, h, w, np.rint(grey.ravel()).astype(np.int32)))
                size += h * w
                if size >= PIXELS_AT_ONCE:
                    yield rows_of(batch, held)
                    held, size = [], 0
            if held:
                yield rows_of(batch, held)

    return images.mapInArrow(pixels, "section_id long, name string, y long, x long, value int")
