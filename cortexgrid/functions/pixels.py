"""Column expressions on voxel values: C1-C7, D7, E11, F2, F3."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(v: Column) -> Column:
    """uint8 to [0, 1]."""
    return v / 255.0


def scale_shift(v: Column, scale: float, shift: float) -> Column:
    """C2."""
    return v * F.lit(float(scale)) + F.lit(float(shift))


def scale_shift_clip(v: Column, scale: float, shift: float, low: float = -128, high: float = 127) -> Column:
    """Scaled, shifted, clipped; tinyint for the int8 range, truncated."""
    out = F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), scale_shift(v, scale, shift)))
    return out.cast("tinyint") if (low, high) == (-128, 127) else out


def ensure_uint8(v: Column) -> Column:
    """C4: v * 255 truncated, modulo 256."""
    return F.pmod((v * 255).cast("int"), F.lit(256))


def invert(v: Column, dtype: str = "uint8") -> Column:
    """255 - v for uint8, 1 - v for float."""
    return F.lit(255) - v if dtype == "uint8" else F.lit(1.0) - v


def _present(channels: Column) -> Column:
    return F.filter(channels, lambda c: ~F.isnan(c))


def merge_channels(channels: Column) -> Column:
    """The sum without NaN; 0 if all are NaN."""
    return F.aggregate(_present(channels), F.lit(0.0), lambda a, c: a + c)


def max_channel(channels: Column) -> Column:
    """The largest without NaN; NaN if all are NaN."""
    return F.coalesce(F.array_max(_present(channels)), F.lit(float("nan")))


def to_grey(r: Column, g: Column, b: Column) -> Column:
    """ITU-R 601 weights."""
    return 0.299 * r + 0.587 * g + 0.114 * b


def boundary_mask(affs: Column, per_section: bool = False, largest: float = 1.0) -> Column:
    """mean affinity over half of the largest; per section without z. Means of three are rounded to nine places."""
    z, y, x = (affs[i] for i in range(3))
    return ((0.5 * (y + x)) if per_section else F.round((z + y + x) / 3, 9)) > F.lit(0.5 * largest)


def affinity_range(v: Column, dtype: str) -> Column:
    """integer affinities to [0, 1]."""
    return v / 255.0 if dtype in ("tinyint", "smallint", "int", "bigint") else v.cast("double")
