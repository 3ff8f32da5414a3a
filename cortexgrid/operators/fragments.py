"""Masks, distances, seeds and watershed fragments."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cortexgrid.operators.components import connected_components
from cortexgrid.operators.graph import WHOLE, dense_ids
from cortexgrid.operators.grid import AXES, KEY, gather_halo
from cortexgrid.operators.lines import along
from cortexgrid.operators.resample import gaussian
from cortexgrid.plans import materialize


def apply_mask(df: DataFrame, mask: DataFrame, value: str) -> DataFrame:
    """value (a number or an array) times the mask; voxels without a mask count as masked out."""
    m = F.coalesce("mask", F.lit(0))
    array = df.schema[value].dataType.typeName() == "array"
    new = F.transform(value, lambda v: v * m) if array else (F.col(value) * m).cast(df.schema[value].dataType)
    return df.join(mask.select(*KEY, "mask"), KEY, "left").withColumn(value, new).drop("mask")


def lower_envelope(place: np.ndarray, height: np.ndarray) -> np.ndarray:
    """min over j of height[j] + (place[i] - place[j])^2 for each i of each line (row); places rise, heights may be infinite.

    The envelope of the parabolas is kept as a stack, all lines one step at a time (Felzenszwalb and Huttenlocher 2012).
    """
    lines, n = place.shape
    out = np.full((lines, n), np.inf)
    row = np.flatnonzero(np.isfinite(height).any(axis=1))
    p, g = place[row].astype(np.float64), height[row]
    stack, start = np.zeros((len(row), n), np.int64), np.full((len(row), n + 1), -np.inf)
    top = np.full(len(row), -1)
    for q in range(n):
        todo = np.flatnonzero(np.isfinite(g[:, q]))
        while len(todo):
            held = top[todo] >= 0
            v = stack[todo, np.maximum(top[todo], 0)]
            new, old = p[todo, q], p[todo, v]
            with np.errstate(divide="ignore", invalid="ignore"):
                meet = np.where(held, ((g[todo, q] + new * new) - (g[todo, v] + old * old)) / (2 * (new - old)), -np.inf)
            under = held & (meet <= start[todo, np.maximum(top[todo], 0)])
            top[todo[under]] -= 1
            done, meet = todo[~under], meet[~under]
            top[done] += 1
            stack[done, top[done]] = q
            start[done, top[done]] = np.where(top[done] > 0, meet, -np.inf)
            todo = todo[under]
    start[np.arange(len(row)), top + 1] = np.inf
    now, every = np.zeros(len(row), np.int64), np.arange(len(row))
    for i in range(n):
        while (late := start[every, now + 1] < p[:, i]).any():
            now += late
        v = stack[every, now]
        out[row, i] = g[every, v] + (p[:, i] - p[every, v]) ** 2
    return out


def distance_transform(df: DataFrame, axes: Sequence[str] = AXES, mask: str = "mask") -> DataFrame:
    """distance, in voxels along axes, to the nearest voxel with mask 0; null where there is none.

    Exact and separable: squared distances along the last axis by windows, then the lower envelope of parabolas along each
    other one. A pass is linear in the voxels, however far the zeros are, and a task holds its longest line at least.
    """
    last, others = axes[-1], list(axes[:-1])[::-1]
    line = Window.partitionBy(*(k for k in KEY if k != last)).orderBy(last)
    zero = F.when(F.col(mask) == 0, F.col(last))
    before = F.last(zero, True).over(line.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(zero, True).over(line.rowsBetween(0, Window.unboundedFollowing))
    near = F.least(F.col(last) - before, after - F.col(last))
    out = df.select(*KEY, (near * near).cast("double").alias("g"))
    for axis in others:
        out = along(out, axis, "g", lower_envelope)
    return out.select(*KEY, F.sqrt("g").alias("distance"))


def lsd_distance(df: DataFrame, sigma: float, shape: dict[str, int], lsds: str = "lsds") -> DataFrame:
    """the volume's largest value less the smoothed sum of squares of the first three channels."""
    squares = F.aggregate(F.slice(lsds, 1, 3), F.lit(0.0), lambda a, v: a + v * v)
    smooth = gaussian(df.select(*KEY, squares.alias("value")), sigma, shape, "value")
    top = smooth.groupBy("volume_id").agg(F.max("value").alias("_top"))
    return smooth.join(top, "volume_id").select(*KEY, (F.col("_top") - F.col("value")).alias("distance"))


def seeds(df: DataFrame, size: int = 10, axes: Sequence[str] = AXES, distance: str = "distance") -> DataFrame:
    """seed = 1 where distance is the largest in the cube of offsets -size/2 .. size/2 - 1; null distances never are."""
    low, high = -(size // 2), size - size // 2 - 1
    out = df.withColumn("_top", F.col(distance))
    for axis in axes:
        out = out.withColumn("_top", F.max("_top").over(Window.partitionBy(*(k for k in KEY if k != axis)).orderBy(axis).rangeBetween(low, high)))
    return out.withColumn("seed", F.coalesce((F.col(distance) == F.col("_top")).cast("int"), F.lit(0))).drop("_top")


def label_seeds(df: DataFrame, axes: Sequence[str] = AXES, seed: str = "seed") -> DataFrame:
    """face-connected components of seeds, numbered 1..n over all volumes by their first voxel (volume_id, z, y, x)."""
    on = materialize(dense_ids(df.where(F.col(seed) > 0).select(*KEY)).withColumnRenamed("_id", "node"), "seeds")
    next_to = F.explode(F.array(*(F.struct(*((F.col(k) + 1 if k == a else F.col(k)).cast("bigint").alias(k) for k in AXES)) for a in axes)))
    near = on.select("volume_id", F.col("node").alias("u"), next_to.alias("to")).select("volume_id", "to.*", "u")
    edges = near.join(on.withColumnRenamed("node", "v"), KEY).select("u", "v")
    found = materialize(on.join(connected_components(on, edges), "node"), "found")
    ranks = dense_ids(found.select("component")).withColumnRenamed("_id", "seed_id")
    return found.join(ranks, "component").select(*KEY, "seed_id")


#: Levels that a block's heights are cut into if it has more different ones.
LEVELS = 256


def levels_of(height: np.ndarray, most: int = LEVELS) -> np.ndarray:
    """Whole levels in the order of heights; infinite heights are beyond all."""
    known = np.isfinite(height)
    values, at = np.unique(height[known], return_inverse=True)
    if len(values) > most:
        low, high = values[0], values[-1]
        at = np.minimum(most - 1, ((height[known] - low) / (high - low) * most).astype(np.int64))
    out = np.full(height.shape, min(len(values), most), np.int64)
    out[known] = at
    return out


def flood(level: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Labels of a block: seeds grow level by level, and within a level in waves, to face neighbours.

    A voxel that a wave reaches from several sides takes the label of the neighbour that comes first by (z, y, x). Voxels
    wait in a bucket for their level; each wave is a few array operations over flat places.
    """
    padded = tuple(n + 2 for n in marks.shape)
    labels, heights = np.full(padded, -1, np.int64), np.full(padded, -1, np.int64)
    inner = (slice(1, -1),) * 3
    labels[inner], heights[inner] = marks, level
    labels, heights = labels.ravel(), heights.ravel()
    steps = np.array([padded[1] * padded[2], padded[2], 1])
    steps = np.concatenate((-steps, steps[::-1]))  # neighbours in the order of their places
    buckets: list[list[np.ndarray]] = [[] for _ in range(int(level.max()) + 1 if level.size else 0)]
    waiting = labels != 0

    def reach(new: np.ndarray, now: int) -> np.ndarray:
        """Unlabelled neighbours of new voxels; those above the present level wait in their bucket."""
        near = np.unique((new[:, None] + steps).ravel())
        near = near[~waiting[near]]
        waiting[near] = True
        at = heights[near]
        later = near[at > now]
        if len(later):
            later = later[np.argsort(heights[later], kind="stable")]
            own, first = np.unique(heights[later], return_index=True)
            for h, part in zip(own.tolist(), np.split(later, first[1:])):
                buckets[h].append(part)
        return near[at <= now]

    reach(np.flatnonzero(labels > 0), -1)
    for now, bucket in enumerate(buckets):
        wave = np.concatenate(bucket) if bucket else np.zeros(0, np.int64)
        while len(wave):
            around = labels[wave[:, None] + steps]
            labels[wave] = around[np.arange(len(wave)), (around > 0).argmax(axis=1)]
            wave = reach(wave, now)
        bucket.clear()
    return labels.reshape(padded)[inner]


def watershed(df: DataFrame, begin: Sequence[int], shape: Sequence[int], block: Sequence[int], context: Sequence[int] = (0, 0, 0)) -> DataFrame:
    """F8: (volume_id, block_id, z, y, x, fragment) of voxels with distance and seed_id (0 for none).

    Each block with its halo is flooded on max(distance) - distance by one task, which holds just that block, over LEVELS
    levels at most; fragments end at block borders and are joined later by the region graph. A block without seeds is all 0.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf[list(AXES)].to_numpy()
        low = at.min(axis=0)
        size = tuple(at.max(axis=0) - low + 1)
        place = tuple((at - low).T)
        height, marks = np.full(size, np.inf), np.zeros(size, np.int64)
        height[place] = pdf["distance"].max() - pdf["distance"].fillna(0.0).to_numpy()
        marks[place] = pdf["seed_id"].to_numpy()
        return pdf[["volume_id", "block_id", *AXES]].assign(fragment=flood(levels_of(height), marks)[place])

    schema = "volume_id int, block_id long, z long, y long, x long, fragment long"
    given = df.select(F.col("volume_id").cast("int").alias("volume_id"), *AXES, "distance", "seed_id")
    made = gather_halo(given, begin, shape, block, context).groupBy("volume_id", "block_id").applyInPandas(run, schema)
    own = F.lit(True)
    number = F.lit(0)
    for a, b0, n, size in zip(AXES, begin, shape, block):
        number = number * -(-n // size) + F.floor((F.col(a) - b0) / size)
    return made.where(own & (F.col("block_id") == number))


def filter_fragments(fragments: DataFrame, affs: DataFrame, threshold: float, per_section: bool = False, fragment: str = "fragment") -> DataFrame:
    """fragments whose mean affinity (y and x channels per section, else all) is below threshold become 0.

    Affinities are summed as whole numbers, so that a fragment whose mean is the threshold stays in whatever order they
    are summed. A fragment with a NaN stays.
    """
    a = F.col("affs")
    mean = (a[1] + a[2]) / 2 if per_section else (a[0] + a[1] + a[2]) / 3
    # background is 0 either way and stays out of the joins
    on = F.coalesce(F.col(fragment) != 0, F.lit(False))
    inside = fragments.where(on)
    whole = F.when(~F.isnan("_mean"), F.round(F.col("_mean") * WHOLE).cast("bigint"))
    sums = inside.join(affs, KEY).withColumn("_mean", mean).groupBy(fragment).agg(F.sum(whole).alias("_sum"), F.count("_mean").alias("_n"), F.count_if(F.isnan("_mean")).alias("_nan"))
    below = (F.col("_sum") < F.col("_n") * F.lit(round(threshold * WHOLE)).cast("bigint")) & (F.col("_nan") == 0)
    low = sums.where(below).select(fragment, F.lit(0).cast("bigint").alias("_zero"))
    new = inside.join(low, fragment, "left").withColumn(fragment, F.coalesce("_zero", fragment)).select(*fragments.columns)
    return new.unionByName(fragments.where(~on))
