"""Training patches, drawn by hashes so that every engine draws the same ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cortexgrid.operators.grid import AXES


def draw(*parts: Column) -> Column:
    """A repeatable integer below 2 ** 28 from the md5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts))), 1, 7), 16, 10).cast("bigint")


def uniform(*parts: Column) -> Column:
    """A repeatable number in [0, 1)."""
    return draw(*parts) / float(1 << 28)


def label_padding(output: Sequence[int], voxel: Sequence[int]) -> list[int]:
    """Half the output's diagonal, rounded up to voxels."""
    half = sum(n * n for n in output) ** 0.5 / 2
    return [int(-(-half // v) * v) for v in voxel]


def sample_patches(boxes: DataFrame, size: Sequence[int], n: int, seed: int) -> DataFrame:
    """N patches of size from volumes (volume_id, begin_<axis>, shape_<axis>), numbered 0..n-1.

    The source volume and the corner are drawn by hash; volumes are chosen evenly by their rank.
    """
    ranked = boxes.withColumn("_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("volume_id")) - 1)
    volumes = boxes.count()
    patches = boxes.sparkSession.range(n).withColumnRenamed("id", "patch_id").withColumn("_rank", (draw(F.lit(seed), F.lit("source"), F.col("patch_id")) % volumes).cast("int"))
    out = patches.join(ranked, "_rank")
    corner = [(F.col(f"begin_{a}") + draw(F.lit(seed), F.lit(a), F.col("patch_id")) % (F.col(f"shape_{a}") - s + 1)).cast("bigint").alias(f"begin_{a}") for a, s in zip(AXES, size)]
    return out.select("patch_id", "volume_id", *corner)


def patch_voxels(df: DataFrame, patches: DataFrame, size: Sequence[int]) -> DataFrame:
    """The voxels of each patch, with coordinates counted from its corner."""
    spread = patches
    for a, s in zip(AXES, size):
        spread = spread.withColumn(f"p{a}", F.explode(F.sequence(F.lit(0), F.lit(s - 1)).cast("array<bigint>")))
    spread = spread.select("patch_id", "volume_id", *(f"p{a}" for a in AXES), *((F.col(f"begin_{a}") + F.col(f"p{a}")).alias(a) for a in AXES))
    return spread.join(df, ["volume_id", *AXES])


def min_masked(voxels: DataFrame, least: float = 0.5, mask: str = "mask") -> DataFrame:
    """C14: patch ids whose masked-in share is at least least."""
    return voxels.groupBy("patch_id").agg(F.avg(mask).alias("masked")).where(F.col("masked") >= least)


def reject_empty(voxels: DataFrame, p: float, background: int = 0, seed: int = 0, value: str = "raw") -> DataFrame:
    """Patch ids, without those that hold only background, which are rejected with probability p."""
    spans = voxels.groupBy("patch_id").agg(F.min(value).alias("low"), F.max(value).alias("high"))
    empty = (F.col("low") == background) & (F.col("high") == background)
    return spans.where(~empty | (uniform(F.lit(seed), F.lit("reject"), F.col("patch_id")) >= p)).select("patch_id")


def require_nonempty(voxels: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Patch ids with a positive sum in every column."""
    sums = voxels.groupBy("patch_id").agg(*(F.sum(c).alias(f"_{c}") for c in columns))
    test = F.lit(True)
    for c in columns:
        test = test & (F.col(f"_{c}") > 0)
    return sums.where(test).select("patch_id")


def transpose_patch(voxels: DataFrame, axes: tuple[str, str], mirror: Sequence[str] = (), size: Sequence[int] = ()) -> DataFrame:
    """C17: two patch axes exchanged, then the axes in mirror reversed within size."""
    a, b = (f"p{x}" for x in axes)
    out = voxels.withColumns({a: F.col(b), b: F.col(a)})
    return out.withColumns({f"p{m}": F.lit(size[AXES.index(m)] - 1) - F.col(f"p{m}") for m in mirror})


def intensity_jitter(voxels: DataFrame, seed: int, value: str = "value") -> DataFrame:
    """Mean + (v - mean) * scale + shift, clipped to [0, 1]; scale in [0.8, 1.2), shift in [-0.2, 0.2) by patch."""
    mean = voxels.groupBy("patch_id").agg(F.avg(value).alias("_mean"))
    part = lambda name: uniform(F.lit(seed), F.lit(name), F.col("patch_id"))
    new = F.col("_mean") + (F.col(value) - F.col("_mean")) * (0.8 + 0.4 * part("scale")) + (0.4 * part("shift") - 0.2)
    return voxels.join(mean, "patch_id").withColumn(value, F.greatest(F.lit(0.0), F.least(F.lit(1.0), new))).drop("_mean")
