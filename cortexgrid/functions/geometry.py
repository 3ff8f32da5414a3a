"""B1: algebra of boxes [begin, begin + shape) along one axis or three, as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _each(a: Column, b: Column, f) -> Column:
    return F.zip_with(a, b, f)


def roi(begin: Column, shape: Column) -> Column:
    return F.struct(begin.alias("begin"), shape.alias("shape"))


def roi_grow(r: Column, context: Column) -> Column:
    """Grown by context on both sides; negative context shrinks."""
    return roi(_each(r["begin"], context, lambda b, c: b - c), _each(r["shape"], context, lambda s, c: s + 2 * c))


def roi_snap(r: Column, step: Column) -> Column:
    """The smallest box on the grid of step that holds r."""
    begin = _each(r["begin"], step, lambda b, s: (F.floor(b / s) * s).cast("bigint"))
    end = _each(_each(r["begin"], r["shape"], lambda b, n: b + n), step, lambda e, s: (F.ceil(e / s) * s).cast("bigint"))
    return roi(begin, _each(end, begin, lambda e, b: e - b))


def roi_intersect(a: Column, b: Column) -> Column:
    """The common box; shape 0 along axes without one."""
    begin = _each(a["begin"], b["begin"], lambda p, q: F.greatest(p, q))
    ends = lambda r: _each(r["begin"], r["shape"], lambda p, n: p + n)
    end = _each(ends(a), ends(b), lambda p, q: F.least(p, q))
    return roi(begin, _each(end, begin, lambda e, p: F.greatest(e - p, F.lit(0).cast("bigint"))))


def is_multiple(shape: Column, step: Column) -> Column:
    return F.forall(_each(shape, step, lambda n, s: n % s), lambda m: m == 0)


def to_voxel(world: Column, resolution: Column) -> Column:
    return _each(world, resolution, lambda w, r: F.floor(w / r).cast("bigint"))


def to_world(voxel: Column, resolution: Column) -> Column:
    return _each(voxel, resolution, lambda v, r: v * r)
