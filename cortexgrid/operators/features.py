"""Training targets, losses and prediction exports."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cortexgrid.functions.pixels import ensure_uint8, invert, max_channel, scale_shift, scale_shift_clip
from cortexgrid.operators.blocks import BLOCK, Block, map_arrays
from cortexgrid.operators.grid import AXES, KEY

#: Neighbourhoods of affinities.
SHORT = ((-1, 0, 0), (0, -1, 0), (0, 0, -1))
SHORT_2D = ((0, -1, 0), (0, 0, -1))


def shifted(df: DataFrame, offsets: Sequence[Sequence[int]], columns: Sequence[str]) -> DataFrame:
    """One row for each voxel and offset (number o), with <column>_o of the voxel at that offset, null outside.

    All offsets go through one equi-join.
    """
    moves = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("o", "dz", "dy", "dx"), (i, *o)))) for i, o in enumerate(offsets)))
    want = df.withColumn("_m", F.explode(moves)).select("*", F.col("_m.o").alias("o"), *((F.col(a) + F.col(f"_m.d{a}")).cast("bigint").alias(f"_{a}") for a in AXES)).drop("_m")
    have = df.select("volume_id", *(F.col(a).alias(f"_{a}") for a in AXES), *(F.col(c).alias(f"{c}_o") for c in columns))
    return want.join(have, ["volume_id", *(f"_{a}" for a in AXES)], "left").drop(*(f"_{a}" for a in AXES))


def affinities(df: DataFrame, offsets: Sequence[Sequence[int]] = SHORT, label: str = "label", block: Sequence[int] = BLOCK) -> DataFrame:
    """affs[o] = 1 where the labels at the voxel and at its offset are equal and above 0. By blocks of arrays."""

    def equal(b: Block) -> dict[str, pa.Array]:
        own = b.at(b.values[label])
        return b.voxels(affs=np.stack([(own > 0) & (own == b.at(b.values[label], o)) for o in offsets]).astype(np.int32))

    return map_arrays(df, [label], equal, "z long, y long, x long, affs array<int>", offsets, block)


def affinity_mask(df: DataFrame, offsets: Sequence[Sequence[int]] = SHORT, mask: str = "mask", block: Sequence[int] = BLOCK) -> DataFrame:
    """1 where both ends of the offset are masked-in. By blocks of arrays."""

    def both(b: Block) -> dict[str, pa.Array]:
        own = b.at(b.values[mask]) > 0
        return b.voxels(affs_mask=np.stack([own & (b.at(b.values[mask], o) > 0) for o in offsets]).astype(np.int32))

    return map_arrays(df, [mask], both, "z long, y long, x long, affs_mask array<int>", offsets, block)


def balance_weights(df: DataFrame, value: str, mask: str, by: Sequence[str]) -> DataFrame:
    """Weight 1/(2p) for positives and 1/(2(1-p)) for others, p their masked share by group, clipped; masked-out 0."""
    share = df.where(F.col(mask) > 0).groupBy(*by).agg(F.avg((F.col(value) > 0).cast("double")).alias("_p"))
    p = F.greatest(F.lit(0.05), F.least(F.lit(0.95), F.col("_p")))
    weight = F.when(F.col(mask) <= 0, 0.0).when(F.col(value) > 0, 1 / (2 * p)).otherwise(1 / (2 * (1 - p)))
    return df.join(share, list(by), "left").withColumn("weight", weight).drop("_p")


def grow_boundary(df: DataFrame, steps: int = 1, label: str = "label", mask: str | None = None) -> DataFrame:
    """Labels set to 0 within steps faces of another label; the volume's border and masked-out voxels don't erode.

    Neighbours are the rows before and after along each axis, so df is read once whatever the steps.
    """
    out = df
    for _ in range(steps):
        hit = F.lit(False)
        for axis in AXES:
            line = Window.partitionBy(*(k for k in KEY if k != axis)).orderBy(axis)
            for move, step in ((F.lag, -1), (F.lead, 1)):
                near = lambda c: move(c).over(line)  # noqa: B023, E731
                other = (near(axis) == F.col(axis) + step) & near(label).isNotNull() & (near(label) != F.col(label))
                hit = hit | F.coalesce(other & (near(mask) > 0) if mask else other, F.lit(False))
        out = out.withColumn(label, F.when((F.col(label) > 0) & hit, F.lit(0)).otherwise(F.col(label)).cast("bigint"))
    return out


def _weighted_along(sums: DataFrame, axis: str, sigma: float, label: str, moments: Sequence[tuple[str, ...]]) -> DataFrame:
    """Sums of moments, by the axes whose offsets they multiply, brought along one more axis for each label.

    A row goes to the 2 r + 1 places around it, r = 3 sigma rounded.
    """
    r = int(3 * sigma + 0.5)
    moves = F.array(*(F.struct(F.lit(d).alias("d"), F.lit(math.exp(-0.5 * d * d / sigma**2)).alias("w")) for d in range(-r, r + 1)))
    moved = sums.withColumn("_m", F.explode(moves)).withColumn(axis, (F.col(axis) + F.col("_m.d")).cast("bigint"))
    w, d = F.col("_m.w"), -F.col("_m.d").cast("double")  # seen from where the row goes
    out = []
    for m in moments:
        times = m.count(axis)
        before = "s_" + "_".join(a for a in m if a != axis)
        out.append(F.sum(w * F.col(before) * (F.lit(1.0) if times == 0 else d if times == 1 else d * d)).alias("s_" + "_".join(m)))
    return moved.groupBy(*KEY, label).agg(*out)


#: Voxels times places around them that are looked up at once.
LOOKED_UP = 1 << 21


def shape_descriptors(df: DataFrame, sigma: float, axes: Sequence[str] = AXES, downsample: int = 2, label: str = "label", block: Sequence[int] = BLOCK) -> DataFrame:
    """E5: per voxel of every downsample-th grid point, over same-label voxels weighted by a Gaussian truncated at 3 sigma.

    lsds holds the mean offset for each axis, then the covariance (variances first), then the weight sum: 10 channels in
    3D, 6 in 2D. sigma is in voxels of the downsampled grid; the truncation is along each axis. By blocks of arrays: a
    voxel moves once, and its block looks up the (2 r + 1)^n labels around it, r = 3 sigma rounded.
    """
    coarse = df.where(F.col(label) > 0)
    for a in axes:
        coarse = coarse.where(F.col(a) % downsample == 0).withColumn(a, F.expr(f"{a} div {downsample}"))
    r = int(3 * sigma + 0.5)
    reach = range(-r, r + 1)
    offsets = np.array([(z, y, x) for z in (reach if "z" in axes else (0,)) for y in (reach if "y" in axes else (0,)) for x in (reach if "x" in axes else (0,))])
    d = {a: offsets[:, AXES.index(a)].astype(np.float64) for a in axes}
    pairs = [(a, a) for a in axes] + [(axes[i], axes[j]) for i in range(len(axes)) for j in range(i + 1, len(axes))]
    weight = np.exp(-0.5 * sum(d[a] ** 2 for a in axes) / sigma**2)
    moments = np.stack([*(weight * d[a] for a in axes), *(weight * d[a] * d[b] for a, b in pairs), weight], axis=1)
    at = {a: k for k, a in enumerate(axes)}

    def described(b: Block) -> dict[str, pa.Array]:
        labels = b.values[label]
        own = b.at(b.present)
        place = tuple(p + h for p, h in zip(np.nonzero(own), b.halo))
        flat, steps = np.ravel_multi_index(place, labels.shape), offsets @ np.array([labels.shape[1] * labels.shape[2], labels.shape[2], 1])
        every, found = labels.ravel(), np.zeros((len(flat), moments.shape[1]))
        many = max(1, LOOKED_UP // len(steps))
        for k in range(0, len(flat), many):
            part = flat[k : k + many]
            found[k : k + many] = (every[part[:, None] + steps] == every[part][:, None]) @ moments
        n = found[:, -1:]
        made = found / np.where(n > 0, n, 1)
        for k, (p, q) in enumerate(pairs, len(axes)):
            made[:, k] -= made[:, at[p]] * made[:, at[q]]
        made[:, -1] = found[:, -1]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, made.size + 1, made.shape[1], dtype=np.int32)), pa.array(made.ravel()))
        return {**b.voxels(), label: pa.array(every[flat]), "lsds": lists}

    return map_arrays(coarse.select(*KEY, label), [label], described, f"z long, y long, x long, {label} {df.schema[label].dataType.simpleString()}, lsds array<double>", offsets.tolist(), block)


def weighted_mse(df: DataFrame, prediction: str = "p", target: str = "t", weight: str = "w", by: Sequence[str] = ()) -> DataFrame:
    """Mean of w * (p - t)^2 over w > 0; 0 without any."""
    return df.groupBy(*by).agg(_mse(prediction, target, weight).alias("loss"))


def _mse(p: str, t: str, w: str) -> Column:
    d = F.col(p) - F.col(t)
    return F.coalesce(F.avg(F.when(F.col(w) > 0, F.col(w) * d * d)), F.lit(0.0))


def multi_task_mse(df: DataFrame, tasks: Sequence[tuple[str, str, str]], weights: Sequence[float]) -> DataFrame:
    """The weighted sum of several tasks' losses, in one aggregate."""
    return df.agg(sum((F.lit(float(k)) * _mse(*t) for t, k in zip(tasks, weights)), F.lit(0.0)).alias("loss"))


def inverted_affinities(df: DataFrame, affs: str = "affs") -> DataFrame:
    """The largest channel as uint8, inverted."""
    return df.select(*KEY, invert(ensure_uint8(max_channel(F.col(affs)))).alias("value"))


def export_indicator(df: DataFrame, indicator: str = "indicator", scale: float = 255.0) -> DataFrame:
    """Indicator * scale as uint8; the scale goes to the volume's metadata."""
    return df.select(*KEY, F.pmod(scale_shift(F.col(indicator), scale, 0.0).cast("int"), F.lit(256)).alias("value"))


def output_metadata(df: DataFrame, outputs: dict[str, tuple[str, str, float]]) -> DataFrame:
    """(volume_id, dataset, dtype, scale), the metadata of each volume's outputs: {column: (dataset, dtype, scale)}.

    A reader divides values by scale; write_volume keeps these as attributes.
    """
    rows = F.array(*(F.struct(F.lit(name).alias("dataset"), F.lit(kind).alias("dtype"), F.lit(float(scale)).alias("scale")) for name, kind, scale in outputs.values()))
    return df.select("volume_id").distinct().select("volume_id", F.explode(rows).alias("m")).select("volume_id", "m.*")


def export_vectors(df: DataFrame, vec: str = "vec", to_nm: float = 1.0, scale: float = 0.25) -> DataFrame:
    """Partner vectors in nm, scaled and clipped to int8."""
    return df.select(*KEY, F.transform(vec, lambda v: scale_shift_clip(v / F.lit(to_nm), scale, 0.0).cast("int")).alias("vec"))


def fuse_predictions(indicator: DataFrame, vectors: DataFrame, how: str = "inner") -> DataFrame:
    """Indicator and vectors of two setups by voxel."""
    return indicator.join(vectors, KEY, how)


def apply_output_properties(df: DataFrame, outputs: dict[str, tuple[str, str, float]]) -> DataFrame:
    """Columns renamed, scaled and cast: {column: (new name, Spark type, scale)}."""
    rest = [c for c in df.columns if c not in outputs]
    return df.select(*rest, *(scale_shift(F.col(c), scale, 0.0).cast(kind).alias(name) for c, (name, kind, scale) in outputs.items()))
