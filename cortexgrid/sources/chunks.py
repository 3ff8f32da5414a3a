"""A1 and A4: chunked arrays as a Spark data source, read by filter and written with a commit.

    register(spark)
    spark.read.format("chunked_volume").option("dataset", "volumes/raw").load("/data/a.zarr").where("z >= 10 and x < 6")

Comparisons of z, y and x with numbers become a box; the box gives the chunks' numbers, and tasks take ranges of these, so
planning neither lists files nor names chunks. Each task opens its own chunks by pyarrow's file systems.
"""

from __future__ import annotations

import bz2
import gzip
import json
import lzma
import math
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

FORMAT = "chunked_volume"
#: Bytes of decoded chunks that a task reads, about, and chunks that it opens at most.
TASK_BYTES, TASK_CHUNKS = 64 << 20, 4096
_AXES = ("z", "y", "x")
#: Beyond any voxel.
_FAR = 1 << 62


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def read_file(path: str) -> bytes | None:
    """A file's bytes; None if there is none."""
    store, place = store_of(path)
    try:
        with store.open_input_stream(place) as f:
            return f.read()
    except FileNotFoundError:
        return None


def unpack(raw: bytes, packed: dict | None, size: int) -> bytes:
    """A chunk's bytes. Compressors beyond Python's and Arrow's need the numcodecs package."""
    if not packed:
        return raw
    known = {"gzip": gzip.decompress, "zlib": zlib.decompress, "bz2": bz2.decompress, "lzma": lzma.decompress, "zstd": lambda x: pa.decompress(x, size, "zstd").to_pybytes()}
    if packed["id"] in known:
        return known[packed["id"]](raw)
    import numcodecs

    return numcodecs.get_codec(packed).decode(raw)


def check_format(path: str) -> None:
    """Only .zarr containers are known; other suffixes are errors."""
    if not path.rstrip("/").endswith((".zarr", ".zr")):
        raise ValueError(f"unknown container format: {path}")


class Array:
    """Place, metadata and chunk grid of one array of a container; falls back to <dataset>/s0."""

    def __init__(self, path: str, dataset: str):
        check_format(path)
        for name in (dataset, f"{dataset}/s0"):
            self.at = f"{path.rstrip('/')}/{name}"
            if (raw := read_file(f"{self.at}/.zarray")) is not None:
                break
        else:
            raise FileNotFoundError(f"{path}/{dataset}")
        self.meta = json.loads(raw)
        self.shape, self.chunk = self.meta["shape"], self.meta["chunks"]
        self.dtype, self.fill = np.dtype(self.meta["dtype"]), self.meta.get("fill_value")
        self.axes = _AXES[-len(self.shape) :]

    def value_type(self) -> str:
        return "double" if self.dtype.kind == "f" else "long"

    def name(self, index: Sequence[int]) -> str:
        return self.meta.get("dimension_separator", ".").join(map(str, index))

    def block(self, index: Sequence[int]) -> np.ndarray | None:
        """A chunk's values; the fill value where it has no file, None if that is null."""
        raw = read_file(f"{self.at}/{self.name(index)}")
        if raw is None:
            return None if self.fill is None else np.full(self.chunk, self.fill, self.dtype)
        raw = unpack(raw, self.meta["compressor"], self.dtype.itemsize * math.prod(self.chunk))
        return np.frombuffer(raw, self.dtype).reshape(self.chunk, order=self.meta.get("order", "C"))


class Range(InputPartition):
    """Numbers first .. last - 1 of the box's chunks, row by row."""

    def __init__(self, first: int, last: int):
        self.first, self.last = first, last
        super().__init__((first, last))


class VolumeReader(DataSourceReader):
    def __init__(self, path: str, dataset: str, volume_id: str):
        self.array, self.volume_id = Array(path, dataset), volume_id
        self.low, self.high = [0] * len(self.array.axes), list(self.array.shape)

    def _narrow(self, axis: str, low: float, high: float) -> None:
        """Voxels low <= axis < high."""
        if axis in self.array.axes:
            i = self.array.axes.index(axis)
            self.low[i], self.high[i] = max(self.low[i], math.ceil(low)), min(self.high[i], math.ceil(high))
        elif not low <= 0 < high:  # 2D arrays have z 0
            self.high = [0] * len(self.high)

    def pushFilters(self, filters: list[Filter]):
        """Takes comparisons of an axis with a number; others, and lists of numbers beyond their range, stay with Spark."""
        for f in filters:
            axis = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v)
            if axis in _AXES and isinstance(f, In) and f.value and all(map(number, f.value)):
                self._narrow(axis, min(f.value), max(f.value) + 1)
                yield f
            elif axis in _AXES and isinstance(f, EqualTo) and number(f.value):
                self._narrow(axis, f.value, f.value + 1)
            elif axis in _AXES and isinstance(f, GreaterThanOrEqual) and number(f.value):
                self._narrow(axis, f.value, _FAR)
            elif axis in _AXES and isinstance(f, GreaterThan) and number(f.value):
                self._narrow(axis, math.floor(f.value) + 1, _FAR)
            elif axis in _AXES and isinstance(f, LessThanOrEqual) and number(f.value):
                self._narrow(axis, -_FAR, math.floor(f.value) + 1)
            elif axis in _AXES and isinstance(f, LessThan) and number(f.value):
                self._narrow(axis, -_FAR, f.value)
            else:
                yield f

    def spans(self) -> list[range]:
        """Chunks that the box meets, on each axis."""
        return [range(b // c, -(-e // c)) if b < e else range(0) for b, e, c in zip(self.low, self.high, self.array.chunk)]

    def partitions(self) -> list[Range]:
        total = math.prod(map(len, self.spans()))
        each = max(1, min(TASK_CHUNKS, TASK_BYTES // max(1, self.array.dtype.itemsize * math.prod(self.array.chunk))))
        return [Range(k, min(total, k + each)) for k in range(0, total, each)] or [Range(0, 0)]

    def chunks(self, partition: Range) -> Iterator[tuple[int, ...]]:
        spans = self.spans()
        for k in range(partition.first, partition.last):
            index = []
            for span in reversed(spans):
                k, i = divmod(k, len(span))
                index.append(span[i])
            yield tuple(reversed(index))

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        dims, value = len(self.array.axes), pa.float64() if self.array.value_type() == "double" else pa.int64()
        for index in self.chunks(partition):
            block = self.array.block(index)
            if block is None:
                continue
            first = [i * c for i, c in zip(index, self.array.chunk)]
            inside = tuple(slice(max(b - f, 0), min(e - f, c)) for b, e, f, c in zip(self.low, self.high, first, self.array.chunk))
            block = block[inside]
            places = [g.ravel() + f + s.start for g, f, s in zip(np.indices(block.shape), first, inside)]
            n = block.size
            values = block.ravel().astype(np.float64 if value == pa.float64() else np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.DictionaryArray.from_arrays(np.zeros(n, np.int32), [self.volume_id]).cast(pa.string()), *(pa.array(x, pa.int64()) for x in [np.zeros(n, np.int64)] * (3 - dims) + places), pa.array(values, value)],
                names=["volume_id", *_AXES, "value"],
            )


class Written(WriterCommitMessage):
    def __init__(self, chunks: list[tuple[int, ...]]):
        self.chunks = chunks


class VolumeWriter(DataSourceArrowWriter):
    """Chunks go to a folder of the job's own beside the array; the commit puts it in the array's place."""

    def __init__(self, path: str, dataset: str, shape: list[int], chunk: list[int], dtype: str, attributes: dict, overwrite: bool):
        check_format(path)
        self.at, self.shape, self.chunk, self.dtype, self.overwrite = f"{path.rstrip('/')}/{dataset}", shape, chunk, np.dtype(dtype), overwrite
        self.attributes, self.job = attributes, f"{path.rstrip('/')}/{dataset}.job-{uuid.uuid4().hex}"
        self.meta = {"zarr_format": 2, "shape": shape, "chunks": chunk, "dtype": dtype, "compressor": {"id": "gzip", "level": 5}, "fill_value": 0, "order": "C", "filters": None}

    def _put(self, name: str, data: bytes) -> None:
        """Written under another name first, so that a file is whole or not there."""
        store, folder = store_of(self.job)
        store.create_dir(folder, recursive=True)
        part = f"{folder}/part-{uuid.uuid4().hex}"
        with store.open_output_stream(part) as f:
            f.write(data)
        store.move(part, f"{folder}/{name}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Rows of one chunk stand together, in any order."""
        axes = _AXES[-len(self.shape) :]
        done: list[tuple[int, ...]] = []
        block, now = None, None

        def finish() -> None:
            if now is not None:
                self._put(".".join(map(str, now)), gzip.compress(block.tobytes(), 5, mtime=0))
                done.append(now)

        for batch in iterator:
            places = [batch.column(a).to_numpy() for a in axes]
            values = batch.column("value").to_numpy(zero_copy_only=False).astype(self.dtype)
            index = np.stack([p // c for p, c in zip(places, self.chunk)], axis=1)
            starts = np.flatnonzero(np.concatenate(([True], (index[1:] != index[:-1]).any(axis=1)))) if len(index) else []
            for a, b in zip(starts, [*starts[1:], len(index)]):
                own = tuple(int(i) for i in index[a])
                if own != now:
                    finish()
                    block, now = np.zeros(self.chunk, self.dtype), own
                block[tuple(p[a:b] - i * c for p, i, c in zip(places, own, self.chunk))] = values[a:b]
        finish()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        chunks = [c for m in messages if m for c in m.chunks]
        if len(set(chunks)) < len(chunks):
            self.abort(messages)
            raise ValueError("rows of a chunk came from several tasks; deal them by chunk first, as write_volume does")
        self._put(".zattrs", json.dumps(self.attributes).encode())
        self._put(".zarray", json.dumps(self.meta).encode())
        store, folder = store_of(self.job)
        _, place = store_of(self.at)
        there = store.get_file_info(place).type == fs.FileType.Directory
        if there and not self.overwrite:
            for info in store.get_file_info(fs.FileSelector(folder)):
                store.move(info.path, f"{place}/{info.base_name}")
            store.delete_dir(folder)
            return
        old = f"{folder}-old"
        if there:
            store.move(place, old)
        store.create_dir(place.rsplit("/", 1)[0], recursive=True)
        store.move(folder, place)
        if there:
            store.delete_dir(old)

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = store_of(self.job)
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)


class VolumeSource(DataSource):
    """Options: path, dataset, volume_id (the path's last part); for writes shape, chunk (JSON), dtype, attributes (JSON)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _place(self) -> tuple[str, str]:
        return self.options["path"], self.options["dataset"]

    def schema(self) -> str:
        return f"volume_id string, z long, y long, x long, value {Array(*self._place()).value_type()}"

    def reader(self, schema) -> VolumeReader:
        path, dataset = self._place()
        return VolumeReader(path, dataset, self.options.get("volume_id") or path.rstrip("/").rsplit("/", 1)[-1])

    def writer(self, schema, overwrite: bool) -> VolumeWriter:
        o = self.options
        return VolumeWriter(*self._place(), json.loads(o["shape"]), json.loads(o["chunk"]), o.get("dtype", "|u1"), json.loads(o.get("attributes", "{}")), overwrite)


def register(spark: SparkSession) -> None:
    """The format's name for this session, with filters pushed to Python data sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VolumeSource)


def load(spark: SparkSession, path: str, dataset: str, volume_id: str | None = None) -> DataFrame:
    register(spark)
    given = spark.read.format(FORMAT).option("dataset", dataset)
    return (given.option("volume_id", volume_id) if volume_id else given).load(path)
