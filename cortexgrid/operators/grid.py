"""Block grids, halos, blockwise maps. A voxel table has volume_id, z, y, x and values."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

AXES = ("z", "y", "x")
KEY = ["volume_id", *AXES]


def coverage(begin: Sequence[int], shape: Sequence[int], context: Sequence[int], mode: str = "pad") -> tuple[list[int], list[int]]:
    """The box to write. valid: smaller than the input by the context; pad: the input itself, its halo filled with 0."""
    if mode == "pad":
        return list(begin), list(shape)
    if mode != "valid":
        raise ValueError(mode)
    return [b + c for b, c in zip(begin, context)], [max(0, n - 2 * c) for n, c in zip(shape, context)]


def block_grid(spark: SparkSession, begin: Sequence[int], shape: Sequence[int], block: Sequence[int], context: Sequence[int] = (0, 0, 0), fit: str = "shrink", volume_id: int = 0) -> DataFrame:
    """Blocks that cover a box, row by row; shrink clips the last one, overhang lets it stick out.

    (volume_id, block_id, write_begin_<axis>, write_end_<axis>, read_begin_<axis>, read_end_<axis>).
    """
    df = spark.range(math.prod(-(-n // b) for n, b in zip(shape, block))).withColumnRenamed("id", "block_id")
    columns = [F.lit(volume_id).alias("volume_id"), F.col("block_id")]
    for axis, c, (first, last) in zip(AXES, context, write_boxes(F.col("block_id"), begin, shape, block, fit)):
        columns += [first.alias(f"write_begin_{axis}"), last.alias(f"write_end_{axis}"), (first - c).alias(f"read_begin_{axis}"), (last + c).alias(f"read_end_{axis}")]
    return df.select(*columns)


def write_boxes(block_id: Column, begin: Sequence[int], shape: Sequence[int], block: Sequence[int], fit: str = "shrink") -> list[tuple[Column, Column]]:
    """(begin, end) of a block's write box on each axis, from its number."""
    counts = [-(-n // b) for n, b in zip(shape, block)]
    index = (F.floor(block_id / (counts[1] * counts[2])), F.floor(block_id / counts[2]) % counts[1], block_id % counts[2])
    out = []
    for i, b0, n, size in zip(index, begin, shape, block):
        first = (i * size + b0).cast("bigint")
        out.append((first, F.least(first + size, F.lit(b0 + n).cast("bigint")) if fit == "shrink" else first + size))
    return out


def gather_halo(df: DataFrame, begin: Sequence[int], shape: Sequence[int], block: Sequence[int], context: Sequence[int]) -> DataFrame:
    """Each voxel with block_id of every block whose read box holds it. Candidates are computed, so no range join."""
    counts = [-(-n // b) for n, b in zip(shape, block)]
    out = df
    for axis, b0, size, c, n in zip(AXES, begin, block, context, counts):
        low = F.greatest(F.floor((F.col(axis) - b0 - c) / size), F.lit(0)).cast("bigint")
        high = F.least(F.floor((F.col(axis) - b0 + c) / size), F.lit(n - 1)).cast("bigint")
        out = out.where(low <= high).withColumn(f"_b{axis}", F.explode(F.sequence(low, high)))
    number = (F.col("_bz") * counts[1] + F.col("_by")) * counts[2] + F.col("_bx")
    return out.withColumn("block_id", number).drop("_bz", "_by", "_bx")


def crop_to_write(df: DataFrame, grid: DataFrame) -> DataFrame:
    """Only voxels inside their block's write box."""
    boxes = grid.select("volume_id", "block_id", *(f"write_{e}_{a}" for a in AXES for e in ("begin", "end")))
    inside = reduce(lambda p, q: p & q, ((F.col(a) >= F.col(f"write_begin_{a}")) & (F.col(a) < F.col(f"write_end_{a}")) for a in AXES))
    return df.join(boxes, ["volume_id", "block_id"]).where(inside).select(*df.columns)


def center_crop(df: DataFrame, size: Sequence[int], to: Sequence[int]) -> DataFrame:
    """The middle box of shape to out of size, moved to the origin."""
    out = df
    for axis, n, m in zip(AXES, size, to):
        first = (n - m) // 2
        out = out.where((F.col(axis) >= first) & (F.col(axis) < first + m)).withColumn(axis, F.col(axis) - first)
    return out


def snap_to_labels(raw: DataFrame, labels: DataFrame) -> DataFrame:
    """Raw within the labels' bounding box of each volume."""
    box = labels.groupBy("volume_id").agg(*(f(a).alias(f"_{n}{a}") for a in AXES for n, f in (("low", F.min), ("high", F.max))))
    inside = reduce(lambda p, q: p & q, (F.col(a).between(F.col(f"_low{a}"), F.col(f"_high{a}")) for a in AXES))
    return raw.join(box, "volume_id").where(inside).select(*raw.columns)


def map_blocks(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, begin: Sequence[int], shape: Sequence[int], block: Sequence[int], context: Sequence[int] = (0, 0, 0)) -> DataFrame:
    """Fn over each block with its halo, cropped to the write box.

    fn takes and gives the voxels of one block, so a block with its halo must fit a task's memory; the schema must have
    volume_id, block_id, z, y, x. This is where a user's inference goes.
    """
    made = gather_halo(df, begin, shape, block, context).groupBy("volume_id", "block_id").applyInPandas(fn, schema)
    # a block's box follows from its number, so cropping joins nothing
    inside = [(F.col(a) >= first) & (F.col(a) < last) for a, (first, last) in zip(AXES, write_boxes(F.col("block_id"), begin, shape, block))]
    return made.where(reduce(lambda p, q: p & q, inside))


def global_ids(df: DataFrame, voxels_per_block: int, label: str = "label") -> DataFrame:
    """Labels unique over blocks: id + block_id * voxels_per_block for id > 0.

    A block whose largest id exceeds voxels_per_block is first relabelled 1..n.
    """
    block = ["volume_id", "block_id"]
    ids = df.where(F.col(label) > 0).select(*block, label).distinct()
    ranked = ids.withColumn("_dense", F.row_number().over(Window.partitionBy(*block).orderBy(label))).withColumn("_max", F.max(label).over(Window.partitionBy(*block)))
    new = F.when(F.col("_max") > voxels_per_block, F.col("_dense")).otherwise(F.col(label)) + F.col("block_id") * voxels_per_block
    return df.join(ranked.select(*block, label, new.cast("bigint").alias("_new")), [*block, label], "left").withColumn(label, F.coalesce("_new", F.col(label))).select(*df.columns)
