"""Resampling, histograms, image comparison."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from cortexgrid.operators.components import connected_components
from cortexgrid.operators.grid import AXES, KEY
from cortexgrid.operators.lines import along


def upsample(df: DataFrame, factors: Sequence[int]) -> DataFrame:
    """Each voxel repeated factors times along z, y, x."""
    out = df
    for a, f in zip(AXES, factors):
        out = out.withColumn(a, F.explode(F.sequence(F.col(a) * f, F.col(a) * f + (f - 1))))
    return out


def mask_on_grid(fine: DataFrame, coarse: DataFrame, factors: Sequence[int], mask: str = "mask") -> DataFrame:
    """fine's voxels with the value of the coarse voxel that they lie in; 0 outside."""
    cell = fine.withColumns({f"_{a}": F.floor(F.col(a) / f).cast("bigint") for a, f in zip(AXES, factors)})
    named = coarse.select("volume_id", *(F.col(a).alias(f"_{a}") for a in AXES), F.col(mask).alias("_mask"))
    joined = cell.join(named, ["volume_id", *(f"_{a}" for a in AXES)], "left")
    return joined.select(*fine.columns, F.coalesce("_mask", F.lit(0)).alias(mask))


def iso_resample(df: DataFrame, z_res: float, xy_res: float, sections: int, value: str = "raw", whole: bool = False) -> DataFrame:
    """D3: sections 0..n-1 resampled linearly to int(n * z_res / xy_res) ones; end points kept; value is a double.

    whole cuts values off to whole numbers, as a uint8 result has them.
    """
    out_n = int(sections * z_res / xy_res)
    step = (sections - 1) / (out_n - 1) if out_n > 1 else 0.0
    targets = df.sparkSession.range(out_n).withColumnRenamed("id", "k").withColumn("pos", F.col("k") * F.lit(step))
    targets = targets.select("k", "pos", F.floor("pos").cast("bigint").alias("low"), F.least(F.floor("pos").cast("bigint") + 1, F.lit(sections - 1)).alias("high"))
    a = df.select("volume_id", F.col("z").alias("low"), "y", "x", F.col(value).alias("_a"))
    b = df.select("volume_id", F.col("z").alias("high"), "y", "x", F.col(value).alias("_b"))
    both = targets.join(a, "low").join(b, ["volume_id", "high", "y", "x"])
    part = F.col("pos") - F.col("low")
    made = F.col("_a") * (1 - part) + F.col("_b") * part
    return both.select("volume_id", F.col("k").alias("z"), "y", "x", (made.cast("int") if whole else made).alias(value))


def pad_to_multiple(df: DataFrame, shape: Sequence[int], voxel: Sequence[int], mode: str = "constant", value: str = "raw") -> DataFrame:
    """A box at the origin padded to multiples of voxel, moved so that it begins at 0; unchanged where it is one."""
    pads = [0 if n % v == 0 else v * (n // v + 1) - n for n, v in zip(shape, voxel)]
    grid = df.select("volume_id").distinct()
    source = []
    for a, n, p in zip(AXES, shape, pads):
        grid = grid.withColumn(a, F.explode(F.sequence(F.lit(0), F.lit(n + p - 1)).cast("array<bigint>")))
        at = F.col(a) - p // 2
        source.append((F.greatest(F.lit(0), F.least(F.lit(n - 1), at)) if mode == "edge" else at).cast("bigint").alias(f"_{a}"))
    placed = grid.select("*", *source)
    inner = df.select("volume_id", *(F.col(a).alias(f"_{a}") for a in AXES), value)
    return placed.join(inner, ["volume_id", *(f"_{a}" for a in AXES)], "left").select(*KEY, F.coalesce(value, F.lit(0)).alias(value))


def histogram(df: DataFrame, value: str = "raw", bins: int = 255) -> DataFrame:
    """(v, n) for v in 0..bins-1; the last bin also holds larger values."""
    counts = df.groupBy(F.least(F.col(value), F.lit(bins - 1)).cast("bigint").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return df.sparkSession.range(bins).withColumnRenamed("id", "v").join(counts, "v", "left").na.fill(0, ["n"])


def _by_value(*unit: str) -> WindowSpec:
    return Window.partitionBy(*unit).orderBy("v")  # over at most 256 values of a unit


def _shares(counts: DataFrame, *unit: str) -> DataFrame:
    """(unit, v, q): the share of a unit's counts n up to v."""
    upto = F.sum("n").over(_by_value(*unit).rowsBetween(Window.unboundedPreceding, 0))
    return counts.select(*unit, "v", F.try_divide(upto, F.sum("n").over(Window.partitionBy(*unit))).alias("q"))


def target_quantiles(target: DataFrame, value: str = "raw", by: Sequence[str] = (), bins: int = 255) -> DataFrame:
    """(by, v, q): each value's cumulative share in its unit, with bin 0 re-estimated from bins 1 and 2.

    q is null for a unit that this leaves empty.
    """
    counts = target.groupBy(*by, F.least(F.col(value), F.lit(bins - 1)).cast("bigint").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    every = counts.select(*by).distinct() if by else counts.sparkSession.range(1).select()
    every = every.select(*by, F.explode(F.sequence(F.lit(0), F.lit(bins - 1)).cast("array<bigint>")).alias("v"))
    h = every.join(counts, [*by, "v"], "left").na.fill(0, ["n"])
    unit = by or [F.lit(0)]
    first = F.greatest(F.lit(0), 2 * F.lead("n", 1).over(_by_value(*unit)) - F.lead("n", 2).over(_by_value(*unit)))
    fixed = h.withColumn("n", F.when(F.col("v") == 0, first).otherwise(F.col("n")))
    upto = F.sum("n").over(_by_value(*unit).rowsBetween(Window.unboundedPreceding, 0))
    return fixed.select(*by, "v", F.try_divide(upto, F.sum("n").over(Window.partitionBy(*unit))).alias("q"))


def match_histograms(source: DataFrame, target: DataFrame, pairs: DataFrame, value: str = "raw", unit: str = "unit", goal: str = "target") -> DataFrame:
    """D6 for many units at once: source's rows once for each of their unit's targets, values mapped, with the column goal.

    source has unit (a section, volume or data set), target has goal, pairs has the wanted (unit, goal). Each unit's values
    go to the target's value of the same share, by interpolation in its quantiles: these and the unit's own are sorted
    together, and the last quantile before an own one is what it lies after. Where target quantiles are flat the last index
    counts; 0 stays 0; results are truncated to uint8. A unit has at most 256 values, so windows are short; the mapping has
    256 rows a pair at most, and Catalyst broadcasts it while that is small.
    """
    counts = source.groupBy(unit, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    nth = lambda c, i: F.lead(c, i).over(_by_value(unit))
    alone = F.count(F.lit(1)).over(Window.partitionBy(unit)) == 1
    zero = F.when((nth("v", 1) == 1) & (nth("v", 2) == 2), F.greatest(F.lit(0), 2 * nth("n", 1) - nth("n", 2))).when(alone, F.lit(1)).otherwise(F.lit(0))
    own = _shares(counts.withColumn("n", F.when(F.col("v") == 0, zero).otherwise(F.col("n"))), unit)
    step = target_quantiles(target, value, [goal]).where("q is not null").withColumn("nq", F.lead("q").over(_by_value(goal)))
    wanted = pairs.select(unit, goal).distinct()
    asked = wanted.join(own, unit).select(unit, goal, "q", F.lit(1).alias("kind"), "v", F.lit(None).cast("struct<tv:bigint,tq:double,nq:double>").alias("s"))
    known = wanted.join(step, goal).select(unit, goal, "q", F.lit(0).alias("kind"), "v", F.struct(F.col("v").alias("tv"), F.col("q").alias("tq"), "nq").alias("s"))
    order = Window.partitionBy(unit, goal).orderBy("q", "kind", "v").rowsBetween(Window.unboundedPreceding, 0)
    placed = asked.unionByName(known).withColumn("s", F.last("s", True).over(order)).where("kind = 1 and s is not null")
    flat = F.col("s.nq").isNull() | (F.col("s.nq") == F.col("s.tq"))
    new = F.when(flat, F.col("s.tv").cast("double")).otherwise(F.col("s.tv") + (F.col("q") - F.col("s.tq")) / (F.col("s.nq") - F.col("s.tq")))
    lut = placed.select(unit, goal, F.col("v").alias(value), F.when(F.col("v") == 0, 0).otherwise(F.floor(new)).cast("int").alias("_new"))
    return source.join(wanted, unit).join(lut, [unit, goal, value], "left").select(*(F.coalesce("_new", F.lit(0)).alias(value) if c == value else F.col(c) for c in source.columns), goal)


def match_histogram(source: DataFrame, target: DataFrame, value: str = "raw") -> DataFrame:
    """Source with values mapped so that their distribution follows the target's, as one unit; see match_histograms."""
    one = source.sparkSession.range(1).select(F.lit(0).alias("_unit"), F.lit(0).alias("_goal"))
    made = match_histograms(source.withColumn("_unit", F.lit(0)), target.withColumn("_goal", F.lit(0)), one, value, "_unit", "_goal")
    return made.select(*source.columns)


def _moving_mean(df: DataFrame, columns: Sequence[str], win: int, by: Sequence[str]) -> DataFrame:
    half = win // 2
    out = df
    for along, other in (("x", "y"), ("y", "x")):
        w = Window.partitionBy(*by, other).orderBy(along).rowsBetween(-half, half)
        out = out.withColumns({c: F.avg(c).over(w) for c in columns})
    return out


def ssim_map(pairs: DataFrame, win: int = 7, span: float = 255.0) -> DataFrame:
    """Structural similarity of pairs (pair_id, y, x, a, b) at each pixel; sample covariance, K1 0.01, K2 0.03."""
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    five = pairs.select("pair_id", "y", "x", a.alias("ma"), b.alias("mb"), (a * a).alias("aa"), (b * b).alias("bb"), (a * b).alias("ab"))
    m = _moving_mean(five, ["ma", "mb", "aa", "bb", "ab"], win, ["pair_id"])
    norm = win * win / (win * win - 1.0)
    ma, mb = F.col("ma"), F.col("mb")
    va, vb, vab = norm * (F.col("aa") - ma * ma), norm * (F.col("bb") - mb * mb), norm * (F.col("ab") - ma * mb)
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    return m.select("pair_id", "y", "x", (((2 * ma * mb + c1) * (2 * vab + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2))).alias("s"))


def ssim(pairs: DataFrame, height: int, width: int, win: int = 7) -> DataFrame:
    """(pair_id, score), the mean over pixels whose window lies inside."""
    half = win // 2
    return ssim_map(pairs, win).where(F.col("y").between(half, height - 1 - half) & F.col("x").between(half, width - 1 - half)).groupBy("pair_id").agg(F.avg("s").alias("score"))


def otsu(df: DataFrame, value: str = "d", by: Sequence[str] = ()) -> DataFrame:
    """(by, threshold), for each unit that of the largest variance between the classes v <= threshold and v > threshold.

    The smallest of equals counts.
    """
    h = df.groupBy(*by, F.col(value).cast("bigint").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    unit = by or [F.lit(0)]
    whole, upto = Window.partitionBy(*unit), _by_value(*unit).rowsBetween(Window.unboundedPreceding, 0)
    sums = h.select(*by, "v", F.sum("n").over(upto).alias("w0"), F.sum(F.col("n") * F.col("v")).over(upto).alias("s0"), F.sum("n").over(whole).alias("w"), F.sum(F.col("n") * F.col("v")).over(whole).alias("s"))
    gap = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / (F.col("w") - F.col("w0"))
    between = F.when(F.col("w") == F.col("w0"), F.lit(0.0)).otherwise(F.col("w0").cast("double") * (F.col("w") - F.col("w0")) * gap * gap)
    return sums.withColumn("var", F.round(between, 4)).groupBy(*by).agg(F.max_by(F.col("v"), F.struct("var", -F.col("v"))).alias("threshold"))


def change_mask(pairs: DataFrame, win: int = 7) -> DataFrame:
    """D9 on D8's map: (pair_id, y, x, d, mask), mask 1 where the similarity, as uint8, is at most its pair's threshold."""
    seen = ssim_map(pairs, win).select("pair_id", "y", "x", F.pmod((F.round("s", 9) * 255).cast("int"), F.lit(256)).alias("d"))
    return seen.join(otsu(seen, "d", ["pair_id"]), "pair_id").select("pair_id", "y", "x", "d", (F.col("d") <= F.col("threshold")).cast("int").alias("mask"))


def change_regions(mask: DataFrame, min_area: int = 40, by: str = "pair_id") -> DataFrame:
    """Face-connected regions of set pixels larger than min_area: (by, region, area, and the bounding box).

    A region's number is its first pixel's, row by row. Pixels are (by, y, x, mask), with y and x below 2 ** 20.
    """
    on = mask.where("mask > 0").select((F.col(by) * (1 << 40) + F.col("y") * (1 << 20) + F.col("x")).alias("node"), by, "y", "x")
    steps = on.select(F.col("node").alias("u"), F.explode(F.array(F.col("node") + 1, F.col("node") + (1 << 20))).alias("v"))
    edges = steps.join(on.select(F.col("node").alias("v")), "v", "left_semi").select("u", "v")
    found = on.join(connected_components(on, edges), "node").groupBy(by, F.col("component").alias("region"))
    out = found.agg(F.count(F.lit(1)).alias("area"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    return out.where(F.col("area") > min_area)


def gaussian_kernel(sigma: float, truncate: float = 3.0) -> list[float]:
    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def gaussian(df: DataFrame, sigma: float, shape: dict[str, int], value: str = "raw") -> DataFrame:
    """Separable smoothing along the axes in shape (axis -> length), with reflection at borders, the border voxel counted twice.

    A line is one array and a pass is one sum of shifted arrays; voxels that are missing or null add nothing.
    """
    weights = gaussian_kernel(sigma)
    r = len(weights) // 2

    def smooth(n: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        def run(place: np.ndarray, given: np.ndarray) -> np.ndarray:
            row, at = np.nonzero(np.isfinite(given) & (place >= 0) & (place < n))
            dense = np.zeros((len(given), n))
            dense[row, place[row, at]] = given[row, at]
            padded = np.pad(dense, ((0, 0), (r, r)), "symmetric")
            made = sum(w * padded[:, k : k + n] for k, w in enumerate(weights))
            out = np.full(given.shape, np.inf)
            row, at = np.nonzero((place >= 0) & (place < n))
            out[row, at] = made[row, place[row, at]]
            return out

        return run

    out = df.select(*KEY, F.col(value).cast("double").alias(value))
    for axis, n in shape.items():
        out = along(out, axis, value, smooth(n))
    return out
