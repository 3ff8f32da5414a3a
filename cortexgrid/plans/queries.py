"""One query per operator over the given tables, with the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cortexgrid.functions import geometry as G
from cortexgrid.functions import pixels as P
from cortexgrid.operators import features as E
from cortexgrid.operators import fragments as R
from cortexgrid.operators import graph as H
from cortexgrid.operators import grid as B
from cortexgrid.operators import oplog as L
from cortexgrid.operators import patches as C
from cortexgrid.operators import resample as D
from cortexgrid.operators import sections as S
from cortexgrid.plans import fixtures as fx
from cortexgrid.plans.cut import scratch_path
from cortexgrid.sources import volumes as V
from cortexgrid.streaming.pending import log_stream, pending_after, pending_stream
from cortexgrid.streaming.states import current_states, states_stream, wait_idle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
KEY = B.KEY


def query(name: str, sql: str | None = None, recursive: bool = False):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = fx.with_views(sql, recursive)
        return fn

    return add


def depth(spark: SparkSession, sf_dir: str) -> int:
    """Sections of the volume."""
    return fx.table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0] + 1


def spread(df: DataFrame, column: str, n: int, digits: int | None = None) -> DataFrame:
    """An array column as c0, c1, ..."""
    one = lambda i: F.get(column, F.lit(i)) if digits is None else F.round(F.get(column, F.lit(i)), digits)
    return df.select(*(c for c in df.columns if c != column), *(one(i).alias(f"c{i}") for i in range(n)))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


BLOCK, CONTEXT = (16, 3, 3), (2, 1, 1)
_N = "(SELECT max(vec_id) + 1 AS n FROM embeddings)"


@query("b1_roi", """
SELECT p_partkey, floor((p_partkey - 1) / 4.0)::BIGINT * 4 AS begin_z, ceil((p_partkey + p_size + 2) / 4.0)::BIGINT * 4 - floor((p_partkey - 1) / 4.0)::BIGINT * 4 AS shape_z,
  greatest(p_size - 2, 10)::BIGINT AS both_y, greatest(least(p_size + 5, 30) - greatest(p_size - 2, 10), 0)::BIGINT AS common_y,
  (p_size + 3) % 4 = 0 AS multiple, floor(p_partkey / 8.0)::BIGINT AS voxel_z
FROM part""")
def b1_roi(spark, sf_dir):
    longs = lambda *xs: F.array(*(F.lit(x).cast("bigint") if isinstance(x, int) else x.cast("bigint") for x in xs))
    p = fx.table(spark, sf_dir, "part")
    r = G.roi(longs(F.col("p_partkey"), F.col("p_size")), longs(F.col("p_size") + 1, 3))
    grown = G.roi_grow(r, longs(1, 2))
    snapped = G.roi_snap(grown, longs(4, 4))
    common = G.roi_intersect(grown, G.roi(longs(0, 10), longs(1000000, 20)))
    return p.select("p_partkey", snapped["begin"][0].alias("begin_z"), snapped["shape"][0].alias("shape_z"), common["begin"][1].alias("both_y"), common["shape"][1].alias("common_y"),
                    G.is_multiple(F.slice(grown["shape"], 1, 1), longs(4)).alias("multiple"), G.to_voxel(r["begin"], longs(8, 8))[0].alias("voxel_z"))


def _grid_sql(pad: bool) -> str:
    c = (0, 0, 0) if pad else CONTEXT
    axes = []
    for a, n, b, k, m in zip("zyx", ("n", "8", "8"), BLOCK, c, CONTEXT):
        first = f"({k} + i{a} * {b})"
        last = f"least({first} + {b}, {n} - {k})"
        axes.append(f"{first} AS write_begin_{a}, {last} AS write_end_{a}, {first} - {m} AS read_begin_{a}, {last} + {m} AS read_end_{a}")
    counts = [f"CAST(ceil(({n} - 2 * {k}) / {b}.0) AS BIGINT)" for n, b, k in zip(("n", "8", "8"), BLOCK, c)]
    return f"""WITH d AS {_N}, z AS (SELECT n, unnest(range(0, {counts[0]})) AS iz FROM d), y AS (SELECT *, unnest(range(0, {counts[1]})) AS iy FROM z), x AS (SELECT *, unnest(range(0, {counts[2]})) AS ix FROM y)
SELECT 0 AS volume_id, (iz * {counts[1]} + iy) * {counts[2]} + ix AS block_id, {', '.join(axes)} FROM x"""


@query("b3_block_grid", _grid_sql(True))
def b3_block_grid(spark, sf_dir):
    return B.block_grid(spark, (0, 0, 0), (depth(spark, sf_dir), 8, 8), BLOCK, CONTEXT)


@query("b3_block_grid_overhang", f"""WITH d AS {_N}, c AS (SELECT CAST(ceil(n / 16.0) AS BIGINT) AS nz FROM d)
SELECT 0 AS volume_id, (iz * 3 + iy) * 3 + ix AS block_id, iz * 16 AS write_begin_z, iz * 16 + 16 AS write_end_z, iz * 16 - 2 AS read_begin_z, iz * 16 + 18 AS read_end_z,
  iy * 3 AS write_begin_y, iy * 3 + 3 AS write_end_y, iy * 3 - 1 AS read_begin_y, iy * 3 + 4 AS read_end_y, ix * 3 AS write_begin_x, ix * 3 + 3 AS write_end_x, ix * 3 - 1 AS read_begin_x, ix * 3 + 4 AS read_end_x
FROM (SELECT unnest(range(0, nz)) AS iz FROM c), (SELECT unnest(range(0, 3)) AS iy), (SELECT unnest(range(0, 3)) AS ix)""")
def b3_block_grid_overhang(spark, sf_dir):
    return B.block_grid(spark, (0, 0, 0), (depth(spark, sf_dir), 8, 8), BLOCK, CONTEXT, "overhang")


@query("b4_coverage", _grid_sql(False))
def b4_coverage(spark, sf_dir):
    begin, shape = B.coverage((0, 0, 0), (depth(spark, sf_dir), 8, 8), CONTEXT, "valid")
    return B.block_grid(spark, begin, shape, BLOCK, CONTEXT)


_HALO = f"""WITH d AS {_N}, c AS (SELECT CAST(ceil(n / 16.0) AS BIGINT) AS nz FROM d),
g AS (SELECT (iz * 3 + iy) * 3 + ix AS block_id, iz, iy, ix FROM (SELECT unnest(range(0, nz)) AS iz FROM c), (SELECT unnest(range(0, 3)) AS iy), (SELECT unnest(range(0, 3)) AS ix)),
h AS (SELECT r.*, g.* FROM fx_raw r JOIN g ON r.z >= iz * 16 - 2 AND r.z < iz * 16 + 18 AND r.y >= iy * 3 - 1 AND r.y < iy * 3 + 4 AND r.x >= ix * 3 - 1 AND r.x < ix * 3 + 4)
"""


def _halo(spark, sf_dir):
    return B.gather_halo(fx.raw(spark, sf_dir), (0, 0, 0), (depth(spark, sf_dir), 8, 8), BLOCK, CONTEXT)


@query("b5_gather_halo", _HALO + "SELECT block_id, count(*) AS voxels, CAST(sum(raw) AS BIGINT) AS total FROM h GROUP BY block_id")
def b5_gather_halo(spark, sf_dir):
    return _halo(spark, sf_dir).groupBy("block_id").agg(F.count(F.lit(1)).alias("voxels"), F.sum("raw").alias("total"))


@query("b6_crop_to_write", "SELECT volume_id, z, y, x, raw, ((z // 16) * 3 + y // 3) * 3 + x // 3 AS block_id FROM fx_raw")
def b6_crop_to_write(spark, sf_dir):
    return B.crop_to_write(_halo(spark, sf_dir), b3_block_grid(spark, sf_dir))


@query("b7_center_crop", f"WITH d AS {_N} SELECT volume_id, z - (n - 100) // 2 AS z, y - 2 AS y, x - 2 AS x, raw FROM fx_raw, d WHERE z - (n - 100) // 2 BETWEEN 0 AND 99 AND y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 4")
def b7_center_crop(spark, sf_dir):
    return B.center_crop(fx.raw(spark, sf_dir), (depth(spark, sf_dir), 8, 8), (100, 4, 3))


@query("b8_snap_to_labels", "WITH l AS MATERIALIZED (SELECT volume_id, min(z) AS a, max(z) AS b, min(y) AS c, max(y) AS d, min(x) AS e, max(x) AS f FROM fx_labels WHERE label = 6 GROUP BY volume_id), j AS MATERIALIZED (SELECT r.*, a, b, c, d, e, f FROM fx_raw r JOIN l ON l.volume_id = r.volume_id) SELECT volume_id, z, y, x, raw FROM j WHERE z BETWEEN a AND b AND y BETWEEN c AND d AND x BETWEEN e AND f")
def b8_snap_to_labels(spark, sf_dir):
    return B.snap_to_labels(fx.raw(spark, sf_dir), fx.labels(spark, sf_dir).where("label = 6"))


@query("b9_map_blocks", "SELECT volume_id, ((z // 16) * 3 + y // 3) * 3 + x // 3 AS block_id, z, y, x, CAST(sum(raw) OVER (PARTITION BY z, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS value FROM fx_raw")
def b9_map_blocks(spark, sf_dir):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["z", "y", "x"])
        z, y, raw = pdf["z"].to_numpy(), pdf["y"].to_numpy(), pdf["raw"].to_numpy().astype(np.int64)
        line = (z[1:] == z[:-1]) & (y[1:] == y[:-1])  # the row before is in the same line
        value = raw.copy()
        value[1:] += raw[:-1] * line
        value[:-1] += raw[1:] * line
        return pdf[["volume_id", "block_id", "z", "y", "x"]].assign(value=value)

    return B.map_blocks(fx.raw(spark, sf_dir), fn, "volume_id int, block_id long, z long, y long, x long, value long", (0, 0, 0), (depth(spark, sf_dir), 8, 8), BLOCK, CONTEXT)


@query("b10_global_ids", """
WITH b AS (SELECT volume_id, z, y, x, label, ((z // 16) * 3 + y // 3) * 3 + x // 3 AS block_id FROM fx_labels),
i AS (SELECT block_id, label, dense_rank() OVER (PARTITION BY block_id ORDER BY label) AS d, max(label) OVER (PARTITION BY block_id) AS m FROM (SELECT DISTINCT block_id, label FROM b WHERE label > 0))
SELECT volume_id, z, y, x, b.block_id, coalesce(CASE WHEN m > 50 THEN d ELSE i.label END + b.block_id * 50, b.label) AS label FROM b LEFT JOIN i ON b.block_id = i.block_id AND b.label = i.label""")
def b10_global_ids(spark, sf_dir):
    number = F.expr("((z div 16) * 3 + y div 3) * 3 + x div 3")
    return B.global_ids(fx.labels(spark, sf_dir).drop("raw").withColumn("block_id", number), 50)


@query("c1_normalize", "SELECT volume_id, z, y, x, round(raw / 255.0::DOUBLE, 6) AS value FROM fx_raw")
def c1_normalize(spark, sf_dir):
    return fx.raw(spark, sf_dir).select(*KEY, F.round(P.normalize(F.col("raw")), 6).alias("value"))


@query("c2_scale_shift", "SELECT volume_id, z, y, x, round(raw / 255.0::DOUBLE * 2 - 1, 6) AS value FROM fx_raw")
def c2_scale_shift(spark, sf_dir):
    return fx.raw(spark, sf_dir).select(*KEY, F.round(P.scale_shift(P.normalize(F.col("raw")), 2, -1), 6).alias("value"))


@query("c3_scale_shift_clip", "SELECT volume_id, z, y, x, CAST(trunc(greatest(-128, least(127, (raw - 127) * 3.0::DOUBLE + 0.5))) AS INT) AS value FROM fx_raw")
def c3_scale_shift_clip(spark, sf_dir):
    return fx.raw(spark, sf_dir).select(*KEY, P.scale_shift_clip(F.col("raw") - 127, 3.0, 0.5).cast("int").alias("value"))


@query("c4_ensure_uint8", "SELECT volume_id, z, y, x, ((CAST(trunc((raw - 127) / 40.0::DOUBLE * 255) AS INT) % 256) + 256) % 256 AS value FROM fx_raw")
def c4_ensure_uint8(spark, sf_dir):
    return fx.raw(spark, sf_dir).select(*KEY, P.ensure_uint8((F.col("raw") - 127) / F.lit(40.0)).alias("value"))


@query("c5_invert", "SELECT volume_id, z, y, x, 255 - raw AS value, round(1 - raw / 255.0::DOUBLE, 6) AS share FROM fx_raw")
def c5_invert(spark, sf_dir):
    return fx.raw(spark, sf_dir).select(*KEY, P.invert(F.col("raw")).alias("value"), F.round(P.invert(P.normalize(F.col("raw")), "float"), 6).alias("share"))


_NAN = "list_transform(lsds, lambda v: CASE WHEN v > 0.5 THEN 'nan'::DOUBLE ELSE v END)"


def _with_nan(spark, sf_dir):
    return fx.lsds(spark, sf_dir).withColumn("lsds", F.transform("lsds", lambda v: F.when(v > 0.5, F.lit(float("nan"))).otherwise(v)))


@query("c6_merge_channels", f"SELECT volume_id, z, y, x, round(coalesce(list_sum(list_filter({_NAN}, lambda v: NOT isnan(v))), 0), 6) AS value FROM fx_lsds")
def c6_merge_channels(spark, sf_dir):
    return _with_nan(spark, sf_dir).select(*KEY, F.round(P.merge_channels(F.col("lsds")), 6).alias("value"))


@query("c7_max_channel", f"SELECT volume_id, z, y, x, round(coalesce(list_max(list_filter({_NAN}, lambda v: NOT isnan(v))), -1), 6) AS value FROM fx_lsds")
def c7_max_channel(spark, sf_dir):
    m = P.max_channel(F.col("lsds"))
    return _with_nan(spark, sf_dir).select(*KEY, F.round(F.when(F.isnan(m), -1.0).otherwise(m), 6).alias("value"))


@query("c8_concat_channels", "SELECT volume_id, z, y, x, CAST(raw AS DOUBLE) AS c0, round(lsds[1], 6) AS c1, round(lsds[10], 6) AS c10 FROM fx_raw JOIN fx_lsds USING (volume_id, z, y, x)")
def c8_concat_channels(spark, sf_dir):
    both = S.concat_channels(fx.raw(spark, sf_dir), fx.lsds(spark, sf_dir), "raw", "lsds")
    return both.select(*KEY, F.col("lsds")[0].alias("c0"), F.round(F.col("lsds")[1], 6).alias("c1"), F.round(F.col("lsds")[10], 6).alias("c10"))


@query("c9_export_sections", "WITH s AS (SELECT z, row_number() OVER (ORDER BY z) - 1 AS section_id FROM (SELECT z FROM fx_mask WHERE z < (SELECT max(z) FROM fx_mask) GROUP BY z HAVING max(mask) > 0)) SELECT m.*, section_id FROM fx_mask m JOIN s USING (z)")
def c9_export_sections(spark, sf_dir):
    return S.export_sections(fx.mask(spark, sf_dir))


@query("c10_background_mask", "SELECT volume_id, z, y, x, raw, CASE WHEN label = -3 THEN 0 ELSE label END AS label, CASE WHEN label <> -3 THEN 1 ELSE 0 END AS mask FROM fx_labels_bg")
def c10_background_mask(spark, sf_dir):
    return S.background_mask(fx.labels_bg(spark, sf_dir), -3)


@query("c11_drop_empty_sections", "WITH e AS (SELECT z, row_number() OVER (ORDER BY z DESC) AS r, count(*) OVER () AS n FROM (SELECT z FROM fx_mask GROUP BY z HAVING max(mask) = 0)) SELECT * FROM fx_mask WHERE z NOT IN (SELECT z FROM e WHERE r <= floor(0.4 * n))")
def c11_drop_empty_sections(spark, sf_dir):
    return S.drop_empty_sections(fx.mask(spark, sf_dir), 40)


@query("c12_replace_sections", "SELECT volume_id, z, y, x, raw, CASE WHEN z IN (3, 7, 120) THEN 0 ELSE label END AS label FROM fx_labels")
def c12_replace_sections(spark, sf_dir):
    return S.replace_sections(fx.labels(spark, sf_dir), [3, 7, 120])


_DRAW = "(CAST('0x' || substr(md5({}), 1, 7) AS BIGINT))"
PATCH, SEED = (5, 4, 4), 11


def _patches(spark, sf_dir):
    n = depth(spark, sf_dir)
    box = spark.createDataFrame([(0, 0, 0, 0, n, 8, 8)], "volume_id int, begin_z long, begin_y long, begin_x long, shape_z long, shape_y long, shape_x long")
    return C.sample_patches(box, PATCH, n // 2, SEED)


_PATCHES = f"""WITH d AS {_N}, pt AS (SELECT i AS patch_id, 0 AS volume_id, {_DRAW.format("'11:z:' || i")} % (n - 4) AS begin_z, {_DRAW.format("'11:y:' || i")} % 5 AS begin_y, {_DRAW.format("'11:x:' || i")} % 5 AS begin_x
  FROM (SELECT n, unnest(range(0, n // 2)) AS i FROM d))"""
_PV = _PATCHES + """, pv AS (SELECT patch_id, r.z - begin_z AS pz, r.y - begin_y AS py, r.x - begin_x AS px, r.* FROM pt JOIN {} r ON r.z BETWEEN begin_z AND begin_z + 4 AND r.y BETWEEN begin_y AND begin_y + 3 AND r.x BETWEEN begin_x AND begin_x + 3)
"""


@query("c13_sample_patches", _PATCHES + " SELECT * FROM pt")
def c13_sample_patches(spark, sf_dir):
    return _patches(spark, sf_dir)


def _voxels(spark, sf_dir, df):
    return C.patch_voxels(df, _patches(spark, sf_dir), PATCH)


@query("c14_min_masked", _PV.format("fx_mask") + "SELECT patch_id, round(avg(mask), 6) AS masked FROM pv GROUP BY patch_id HAVING avg(mask) >= 0.02")
def c14_min_masked(spark, sf_dir):
    return rounded(C.min_masked(_voxels(spark, sf_dir, fx.mask(spark, sf_dir)), 0.02), "masked")


@query("c15_reject_empty", _PV.format("fx_mask") + f"SELECT patch_id FROM pv GROUP BY patch_id HAVING NOT (min(mask) = 0 AND max(mask) = 0) OR {_DRAW.format(chr(39) + '11:reject:' + chr(39) + ' || patch_id')} / 268435456.0::DOUBLE >= 0.7")
def c15_reject_empty(spark, sf_dir):
    return C.reject_empty(_voxels(spark, sf_dir, fx.mask(spark, sf_dir)), 0.7, 0, SEED, "mask")


@query("c16_require_nonempty", _PV.format("fx_mask") + "SELECT patch_id FROM pv GROUP BY patch_id HAVING sum(mask) > 0 AND sum(raw) > 0")
def c16_require_nonempty(spark, sf_dir):
    return C.require_nonempty(_voxels(spark, sf_dir, fx.mask(spark, sf_dir)), ["mask", "raw"])


@query("c17_transpose_patch", _PV.format("fx_raw") + "SELECT patch_id, pz, px AS py, 3 - py AS px, raw FROM pv")
def c17_transpose_patch(spark, sf_dir):
    out = C.transpose_patch(_voxels(spark, sf_dir, fx.raw(spark, sf_dir)), ("y", "x"), ("x",), PATCH)
    return out.select("patch_id", "pz", "py", "px", "raw")


@query("c18_intensity_jitter", _PV.format("fx_raw") + f"""SELECT patch_id, z, y, x, round(greatest(0, least(1, m + (raw / 255.0::DOUBLE - m) * (0.8 + 0.4 * {_DRAW.format("'11:scale:' || patch_id")} / 268435456.0::DOUBLE) + 0.4 * {_DRAW.format("'11:shift:' || patch_id")} / 268435456.0::DOUBLE - 0.2)), 5) AS value
FROM (SELECT *, avg(raw / 255.0::DOUBLE) OVER (PARTITION BY patch_id) AS m FROM pv)""")
def c18_intensity_jitter(spark, sf_dir):
    v = _voxels(spark, sf_dir, fx.raw(spark, sf_dir)).withColumn("value", P.normalize(F.col("raw")))
    return rounded(C.intensity_jitter(v, SEED).select("patch_id", "z", "y", "x", "value"), "value", digits=5)


@query("c20_check_sections", "WITH a AS (SELECT z, count(*) AS n FROM fx_raw GROUP BY z), b AS (SELECT z, count(*) AS m FROM fx_labels WHERE label > 0 GROUP BY z) SELECT 0 AS volume_id, z, coalesce(n, 0) AS raw_voxels, coalesce(m, 0) AS label_voxels FROM a FULL JOIN b USING (z) WHERE n IS DISTINCT FROM m")
def c20_check_sections(spark, sf_dir):
    return S.check_sections(fx.raw(spark, sf_dir), fx.labels(spark, sf_dir).where("label > 0"))


@query("c21_min_sections", "SELECT min(n) AS sections FROM (SELECT label, count(DISTINCT vec_id) AS n FROM embeddings GROUP BY label)")
def c21_min_sections(spark, sf_dir):
    return S.min_sections(fx.table(spark, sf_dir, "embeddings").select(F.col("label").alias("volume_id"), F.col("vec_id").alias("z")))


@query("d1_upsample", "SELECT volume_id, z, y * 2 + dy AS y, x * 3 + dx AS x, raw FROM fx_raw, (SELECT unnest(range(0, 2)) AS dy), (SELECT unnest(range(0, 3)) AS dx)")
def d1_upsample(spark, sf_dir):
    return D.upsample(fx.raw(spark, sf_dir), (1, 2, 3))


@query("d2_mask_on_grid", "SELECT r.*, coalesce(m.mask, 0) AS mask FROM fx_raw r LEFT JOIN (SELECT * FROM fx_coarse_mask WHERE z % 3 <> 0) m ON (m.z, m.y, m.x) = (r.z // 5, r.y // 2, r.x // 2)")
def d2_mask_on_grid(spark, sf_dir):
    return D.mask_on_grid(fx.raw(spark, sf_dir), fx.coarse_mask(spark, sf_dir).where("z % 3 != 0"), (5, 2, 2))


_ISO = f"""WITH d AS MATERIALIZED ({_N[1:-1]}), t AS MATERIALIZED (SELECT k, pos, CAST(floor(pos) AS BIGINT) AS low, least(CAST(floor(pos) AS BIGINT) + 1, n - 1) AS high, pos - floor(pos) AS part
FROM (SELECT n, k, k * ((n - 1) / (CAST(floor(n * 40.0 / 16.0) AS BIGINT) - 1.0::DOUBLE)) AS pos FROM (SELECT n, unnest(range(0, CAST(floor(n * 40.0 / 16.0) AS BIGINT))) AS k FROM d))),
a AS MATERIALIZED (SELECT k, high, part, volume_id, y, x, raw FROM t JOIN fx_raw ON z = low), b AS MATERIALIZED (SELECT k, a.y, a.x, a.volume_id, a.raw * (1 - part) + r.raw * part AS value FROM a JOIN fx_raw r ON r.z = high AND r.y = a.y AND r.x = a.x)"""


@query("d3_iso_resample", _ISO + " SELECT volume_id, k AS z, y, x, round(value, 5) AS raw FROM b")
def d3_iso_resample(spark, sf_dir):
    return rounded(D.iso_resample(fx.raw(spark, sf_dir), 40, 16, depth(spark, sf_dir)), "raw", digits=5)


@query("d3_iso_resample_whole", _ISO + " SELECT volume_id, k AS z, y, x, CAST(trunc(value) AS INT) AS raw FROM b")
def d3_iso_resample_whole(spark, sf_dir):
    return D.iso_resample(fx.raw(spark, sf_dir), 40, 16, depth(spark, sf_dir), whole=True)


@query("d4_pad_to_multiple", f"""WITH d AS {_N}, s AS (SELECT n, CASE WHEN n % 40 = 0 THEN 0 ELSE 40 * (n // 40 + 1) - n END AS p FROM d),
g AS (SELECT *, unnest(range(0, n + p)) AS z FROM s), gg AS (SELECT z, p, y, x FROM g, (SELECT unnest(range(0, 9)) AS y), (SELECT unnest(range(0, 12)) AS x))
SELECT 0 AS volume_id, gg.z, gg.y, gg.x, coalesce(r.raw, 0) AS raw FROM gg LEFT JOIN fx_raw r ON r.z = gg.z - p // 2 AND r.y = gg.y AND r.x = gg.x - 2""")
def d4_pad_to_multiple(spark, sf_dir):
    return D.pad_to_multiple(fx.raw(spark, sf_dir), (depth(spark, sf_dir), 8, 8), (40, 9, 12))


@query("d4_pad_edge", f"""WITH d AS {_N}, s AS (SELECT n, CASE WHEN n % 40 = 0 THEN 0 ELSE 40 * (n // 40 + 1) - n END AS p FROM d),
g AS (SELECT *, unnest(range(0, n + p)) AS z FROM s), gg AS (SELECT z, n, p, y, x FROM g, (SELECT unnest(range(0, 9)) AS y), (SELECT unnest(range(0, 12)) AS x))
SELECT 0 AS volume_id, gg.z, gg.y, gg.x, r.raw FROM gg LEFT JOIN fx_raw r ON r.z = greatest(0, least(n - 1, gg.z - p // 2)) AND r.y = least(7, gg.y) AND r.x = greatest(0, least(7, gg.x - 2))""")
def d4_pad_edge(spark, sf_dir):
    return D.pad_to_multiple(fx.raw(spark, sf_dir), (depth(spark, sf_dir), 8, 8), (40, 9, 12), "edge")


_HIST = "SELECT v, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, 255)) AS v) LEFT JOIN (SELECT least(raw, 254) AS v, count(*) AS n FROM {} GROUP BY 1) USING (v)"


@query("d5_histogram", _HIST.format("fx_raw"))
def d5_histogram(spark, sf_dir):
    return D.histogram(fx.raw(spark, sf_dir))


@query("d6_match_histogram", f"""WITH h AS ({_HIST.format("fx_target")}), h2 AS (SELECT v, CASE WHEN v = 0 THEN greatest(0, 2 * lead(n) OVER (ORDER BY v) - lead(n, 2) OVER (ORDER BY v)) ELSE n END AS n FROM h),
t AS (SELECT v AS tv, sum(n) OVER (ORDER BY v) / (sum(n) OVER ())::DOUBLE AS tq FROM h2), t2 AS (SELECT tv, tq, lead(tq) OVER (ORDER BY tv) AS nq FROM t),
c AS (SELECT raw AS v, count(*) AS n FROM fx_source GROUP BY raw),
c2 AS (SELECT v, CASE WHEN v = 0 THEN CASE WHEN lead(v) OVER (ORDER BY v) = 1 AND lead(v, 2) OVER (ORDER BY v) = 2 THEN greatest(0, 2 * lead(n) OVER (ORDER BY v) - lead(n, 2) OVER (ORDER BY v)) WHEN count(*) OVER () = 1 THEN 1 ELSE 0 END ELSE n END AS n FROM c),
q AS (SELECT v, sum(n) OVER (ORDER BY v) / (sum(n) OVER ())::DOUBLE AS q FROM c2),
m AS (SELECT v, q, max(tv) AS tv FROM q JOIN t2 ON tq <= q GROUP BY v, q),
lut AS (SELECT m.v, CASE WHEN m.v = 0 THEN 0 WHEN nq IS NULL OR nq = tq THEN m.tv ELSE floor(m.tv + (q - tq) / (nq - tq)) END AS new FROM m JOIN t2 USING (tv))
SELECT volume_id, z, y, x, CAST(coalesce(new, 0) AS INT) AS raw FROM fx_source s LEFT JOIN lut ON lut.v = s.raw""")
def d6_match_histogram(spark, sf_dir):
    return D.match_histogram(fx.source(spark, sf_dir), fx.target(spark, sf_dir))


def _datasets(spark, sf_dir):
    """Sections in three data sets, by class."""
    own = fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("z"), (F.col("label") % 3).alias("dataset"))
    return fx.raw0(spark, sf_dir).join(own, "z").select("dataset", "z", "y", "x", "raw")


@query("d6_match_dataset_pairs", """WITH s AS MATERIALIZED (SELECT label % 3 AS dataset, z, y, x, r.raw FROM fx_raw0 r JOIN embeddings ON vec_id = z),
h AS (SELECT dataset AS target, v, coalesce(n, 0) AS n FROM (SELECT dataset, unnest(range(0, 255)) AS v FROM (SELECT DISTINCT dataset FROM s)) LEFT JOIN (SELECT dataset, least(raw, 254) AS v, count(*) AS n FROM s GROUP BY 1, 2) USING (dataset, v)),
h2 AS (SELECT target, v, CASE WHEN v = 0 THEN greatest(0, 2 * lead(n) OVER w - lead(n, 2) OVER w) ELSE n END AS n FROM h WINDOW w AS (PARTITION BY target ORDER BY v)),
t AS (SELECT target, v AS tv, sum(n) OVER (PARTITION BY target ORDER BY v) / (sum(n) OVER (PARTITION BY target))::DOUBLE AS tq FROM h2), t2 AS MATERIALIZED (SELECT *, lead(tq) OVER (PARTITION BY target ORDER BY tv) AS nq FROM t),
c AS (SELECT dataset, z, raw AS v, count(*) AS n FROM s GROUP BY ALL),
c2 AS (SELECT dataset, z, v, CASE WHEN v = 0 THEN CASE WHEN lead(v) OVER w = 1 AND lead(v, 2) OVER w = 2 THEN greatest(0, 2 * lead(n) OVER w - lead(n, 2) OVER w) WHEN count(*) OVER (PARTITION BY dataset, z) = 1 THEN 1 ELSE 0 END ELSE n END AS n FROM c WINDOW w AS (PARTITION BY dataset, z ORDER BY v)),
q AS MATERIALIZED (SELECT dataset, z, v, sum(n) OVER (PARTITION BY dataset, z ORDER BY v) / (sum(n) OVER (PARTITION BY dataset, z))::DOUBLE AS q FROM c2),
m AS MATERIALIZED (SELECT q.*, target, max(tv) AS tv FROM q JOIN t2 ON target <> dataset WHERE tq <= q GROUP BY ALL),
lut AS MATERIALIZED (SELECT dataset, z, target, v, CASE WHEN v = 0 THEN 0 WHEN nq IS NULL OR nq = tq THEN m.tv ELSE floor(m.tv + (q - tq) / (nq - tq)) END AS new FROM m JOIN t2 USING (target, tv)),
p AS MATERIALIZED (SELECT a.dataset, b.dataset AS target FROM (SELECT DISTINCT dataset FROM s) a JOIN (SELECT DISTINCT dataset FROM s) b ON a.dataset <> b.dataset)
SELECT s.dataset, s.z, y, x, p.target, CAST(coalesce(new, 0) AS INT) AS raw FROM s JOIN p USING (dataset) LEFT JOIN lut ON lut.dataset = s.dataset AND lut.z = s.z AND lut.target = p.target AND lut.v = s.raw""")
def d6_match_dataset_pairs(spark, sf_dir):
    """Each section to the whole of every other data set."""
    df = _datasets(spark, sf_dir).withColumn("unit", F.struct("dataset", "z"))
    both = S.dataset_pairs(df.select("dataset"), "dataset")
    pairs = df.select("unit").distinct().join(both, F.col("unit.dataset") == F.col("source")).select("unit", "target")
    return D.match_histograms(df, df.select(F.col("dataset").alias("target"), "raw"), pairs).select("dataset", "z", "y", "x", "target", "raw")


@query("d7_to_grey", "SELECT volume_id, z, y, x, round(0.299::DOUBLE * raw + 0.587::DOUBLE * (255 - raw) + 0.114::DOUBLE * (raw // 2), 6) AS grey FROM fx_raw")
def d7_to_grey(spark, sf_dir):
    r = F.col("raw")
    return fx.raw(spark, sf_dir).select(*KEY, F.round(P.to_grey(r, 255 - r, F.expr("raw div 2")), 6).alias("grey"))


@query("d8_ssim", """WITH p AS (SELECT a.pair_id, a.y, a.x, avg(b.a::DOUBLE) AS ma, avg(b.b::DOUBLE) AS mb, avg(b.a::DOUBLE * b.a) AS aa, avg(b.b::DOUBLE * b.b) AS bb, avg(b.a::DOUBLE * b.b) AS ab FROM fx_pairs a JOIN fx_pairs b ON b.pair_id = a.pair_id AND b.y BETWEEN a.y - 3 AND a.y + 3 AND b.x BETWEEN a.x - 3 AND a.x + 3 WHERE a.y BETWEEN 3 AND 4 AND a.x BETWEEN 3 AND 4 GROUP BY 1, 2, 3)
SELECT pair_id, round(avg((2 * ma * mb + 6.5025::DOUBLE) * (2 * (49 / 48.0::DOUBLE) * (ab - ma * mb) + 58.5225::DOUBLE) / ((ma * ma + mb * mb + 6.5025::DOUBLE) * ((49 / 48.0::DOUBLE) * (aa - ma * ma + bb - mb * mb) + 58.5225::DOUBLE))), 6) AS score FROM p GROUP BY pair_id""")
def d8_ssim(spark, sf_dir):
    return rounded(D.ssim(fx.pairs(spark, sf_dir), 8, 8), "score")


_OTSU = """WITH h AS (SELECT abs(a - b) AS v, count(*) AS n FROM fx_pairs GROUP BY 1),
s AS (SELECT v, sum(n) OVER (ORDER BY v)::DOUBLE AS w0, sum(n * v) OVER (ORDER BY v)::DOUBLE AS s0, (sum(n) OVER ())::DOUBLE AS w, (sum(n * v) OVER ())::DOUBLE AS s FROM h),
o AS (SELECT v AS threshold FROM (SELECT v, round(CASE WHEN w = w0 THEN 0 ELSE w0 * (w - w0) * (s0 / w0 - (s - s0) / (w - w0)) * (s0 / w0 - (s - s0) / (w - w0)) END, 0) AS var FROM s) ORDER BY var DESC, v LIMIT 1)
"""


@query("d9_otsu", _OTSU + "SELECT CAST(threshold AS BIGINT) AS threshold FROM o")
def d9_otsu(spark, sf_dir):
    return D.otsu(fx.pairs(spark, sf_dir).withColumn("d", F.abs(F.col("a") - F.col("b"))))


_CHANGES = """WITH near AS MATERIALIZED (SELECT a.pair_id, a.y, a.x, avg(b.a::DOUBLE) AS ma, avg(b.b::DOUBLE) AS mb, avg(b.a::DOUBLE * b.a) AS aa, avg(b.b::DOUBLE * b.b) AS bb, avg(b.a::DOUBLE * b.b) AS ab FROM fx_pairs a JOIN fx_pairs b ON b.pair_id = a.pair_id WHERE b.y BETWEEN a.y - 3 AND a.y + 3 AND b.x BETWEEN a.x - 3 AND a.x + 3 GROUP BY 1, 2, 3),
m AS MATERIALIZED (SELECT pair_id, y, x, ((CAST(trunc(round((2 * ma * mb + 6.5025::DOUBLE) * (2 * (49 / 48.0::DOUBLE) * (ab - ma * mb) + 58.5225::DOUBLE) / ((ma * ma + mb * mb + 6.5025::DOUBLE) * ((49 / 48.0::DOUBLE) * (aa - ma * ma + bb - mb * mb) + 58.5225::DOUBLE)), 9) * 255) AS INT) % 256) + 256) % 256 AS d FROM near),
h AS (SELECT pair_id, d AS v, count(*) AS n FROM m GROUP BY 1, 2),
s AS (SELECT pair_id, v, sum(n) OVER o::DOUBLE AS w0, sum(n * v) OVER o::DOUBLE AS s0, (sum(n) OVER u)::DOUBLE AS w, (sum(n * v) OVER u)::DOUBLE AS s FROM h WINDOW o AS (PARTITION BY pair_id ORDER BY v), u AS (PARTITION BY pair_id)),
t AS MATERIALIZED (SELECT pair_id, arg_max(v, {'var': round(CASE WHEN w = w0 THEN 0 ELSE w0 * (w - w0) * (s0 / w0 - (s - s0) / (w - w0)) * (s0 / w0 - (s - s0) / (w - w0)) END, 4), 'v': -v}) AS threshold FROM s GROUP BY pair_id)
"""


@query("d9_otsu_pairs", _CHANGES + "SELECT pair_id, CAST(threshold AS BIGINT) AS threshold FROM t")
def d9_otsu_pairs(spark, sf_dir):
    return D.change_mask(fx.pairs(spark, sf_dir)).groupBy("pair_id").agg(F.max(F.when(F.col("mask") == 1, F.col("d"))).cast("bigint").alias("threshold"))


@query("d10_change_regions", _CHANGES + """, c0 AS MATERIALIZED (SELECT pair_id, y * 8 + x AS i, x FROM m JOIN t USING (pair_id) WHERE d <= threshold),
r AS (SELECT pair_id, i, i AS reach FROM c0 UNION SELECT r.pair_id, c0.i, r.reach FROM r JOIN c0 ON c0.pair_id = r.pair_id AND (c0.i = r.i + 8 OR c0.i = r.i - 8 OR (c0.i = r.i + 1 AND c0.x > 0) OR (c0.i = r.i - 1 AND c0.x < 7))),
c AS (SELECT pair_id, i, min(reach) AS region FROM r GROUP BY 1, 2)
SELECT pair_id, pair_id * 1099511627776 + (region // 8) * 1048576 + region % 8 AS region, count(*) AS area, min(i // 8) AS y0, max(i // 8) AS y1, min(i % 8) AS x0, max(i % 8) AS x1 FROM c GROUP BY pair_id, region HAVING count(*) > 4""", True)
def d10_change_regions(spark, sf_dir):
    return D.change_regions(D.change_mask(fx.pairs(spark, sf_dir)), 4)


@query("d11_pair_sections", "WITH a AS (SELECT s_name AS n, row_number() OVER (ORDER BY s_name) AS pair FROM supplier), b AS (SELECT p_name AS n, row_number() OVER (ORDER BY p_name) AS pair FROM (SELECT DISTINCT p_name FROM part)) SELECT a.n AS name_a, b.n AS name_b, a.pair FROM a JOIN b USING (pair)")
def d11_pair_sections(spark, sf_dir):
    return S.pair_sections(fx.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name")), fx.table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()).withColumn("pair", F.col("pair").cast("bigint"))


def _gauss_sql(view: str, sigma: float) -> str:
    k = D.gaussian_kernel(sigma)
    r = len(k) // 2
    w = "k AS (SELECT * FROM (VALUES " + ", ".join(f"({i - r}, {x!r}::DOUBLE)" for i, x in enumerate(k)) + ") t(o, w))"
    at = lambda a: f"CASE WHEN {a} + o < 0 THEN -({a} + o) - 1 WHEN {a} + o >= 8 THEN 15 - ({a} + o) ELSE {a} + o END"
    return f"{w}, gy AS (SELECT a.volume_id, a.z, a.y, a.x, sum(w * b.value) AS value FROM {view} a, k JOIN {view} b ON b.z = a.z AND b.x = a.x AND b.y = {at('a.y')} GROUP BY 1, 2, 3, 4), gx AS (SELECT a.volume_id, a.z, a.y, a.x, sum(w * b.value) AS value FROM gy a, k JOIN gy b ON b.z = a.z AND b.y = a.y AND b.x = {at('a.x')} GROUP BY 1, 2, 3, 4)"


@query("d12_gaussian", "WITH v AS (SELECT volume_id, z, y, x, raw::DOUBLE AS value FROM fx_raw), " + _gauss_sql("v", 1.0) + " SELECT volume_id, z, y, x, round(value, 5) AS raw FROM gx")
def d12_gaussian(spark, sf_dir):
    return rounded(D.gaussian(fx.raw(spark, sf_dir), 1.0, {"y": 8, "x": 8}), "raw", digits=5)


def _aff(dz: int, dy: int, dx: int) -> str:
    return f"CASE WHEN l.label > 0 AND EXISTS (SELECT 1 FROM fx_labels o WHERE o.z = l.z + {dz} AND o.y = l.y + {dy} AND o.x = l.x + {dx} AND o.label = l.label) THEN 1 ELSE 0 END"


@query("e1_affinities", f"SELECT volume_id, z, y, x, {_aff(-1, 0, 0)} AS c0, {_aff(0, -1, 0)} AS c1, {_aff(0, 0, -1)} AS c2, {_aff(0, 3, -2)} AS c3 FROM fx_labels l")
def e1_affinities(spark, sf_dir):
    return spread(E.affinities(fx.labels(spark, sf_dir), (*E.SHORT, (0, 3, -2))), "affs", 4)


def _two(dz: int, dy: int, dx: int) -> str:
    return f"CASE WHEN l.mask > 0 AND EXISTS (SELECT 1 FROM fx_mask o WHERE o.z = l.z + {dz} AND o.y = l.y + {dy} AND o.x = l.x + {dx} AND o.mask > 0) THEN 1 ELSE 0 END"


@query("e2_affinity_mask", f"SELECT volume_id, z, y, x, {_two(-1, 0, 0)} AS c0, {_two(0, -1, 0)} AS c1, {_two(0, 0, -1)} AS c2 FROM fx_mask l")
def e2_affinity_mask(spark, sf_dir):
    return spread(E.affinity_mask(fx.mask(spark, sf_dir)), "affs_mask", 3)


@query("e3_balance_weights", """WITH v AS (SELECT volume_id, z, y, x, CASE WHEN raw >= 140 THEN 1 ELSE 0 END AS value, CASE WHEN raw % 5 = 0 THEN 0 ELSE 1 END AS mask FROM fx_raw),
s AS (SELECT z, greatest(0.05::DOUBLE, least(0.95::DOUBLE, avg(CASE WHEN mask > 0 THEN value END))) AS p FROM v GROUP BY z)
SELECT v.*, round(CASE WHEN mask = 0 THEN 0 WHEN value > 0 THEN 1 / (2 * p) ELSE 1 / (2 * (1 - p)) END, 6) AS weight FROM v JOIN s USING (z)""")
def e3_balance_weights(spark, sf_dir):
    v = fx.raw(spark, sf_dir).select(*KEY, (F.col("raw") >= 140).cast("int").alias("value"), (F.col("raw") % 5 != 0).cast("int").alias("mask"))
    return rounded(E.balance_weights(v, "value", "mask", ["z"]), "weight")


_FACES = "(SELECT * FROM (VALUES (1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) t(dz, dy, dx))"


def _grow_eq(source: str) -> str:
    return f"SELECT a.volume_id, a.z, a.y, a.x, CASE WHEN a.label > 0 AND coalesce(bool_or(b.label <> a.label), false) THEN 0 ELSE a.label END AS label FROM (SELECT *, z + dz AS bz, y + dy AS bx_y, x + dx AS bx FROM {source}, {_FACES}) a LEFT JOIN {source} b ON b.z = bz AND b.y = bx_y AND b.x = bx GROUP BY 1, 2, 3, 4, a.label"


@query("e4_grow_boundary", f"WITH g0 AS (SELECT volume_id, z, y, x, label FROM fx_labels), g1 AS ({_grow_eq('g0')}), g2 AS ({_grow_eq('g1')}) SELECT * FROM g2")
def e4_grow_boundary(spark, sf_dir):
    return E.grow_boundary(fx.labels(spark, sf_dir).drop("raw"), 2)


@query("e5_shape_descriptors", """WITH c AS (SELECT volume_id, z, y // 2 AS y, x // 2 AS x, label FROM fx_labels WHERE label > 0 AND y % 2 = 0 AND x % 2 = 0),
j AS (SELECT a.volume_id, a.z, a.y, a.x, a.label, (b.y - a.y)::DOUBLE AS dy, (b.x - a.x)::DOUBLE AS dx FROM c a JOIN c b ON b.z = a.z AND b.label = a.label),
w AS (SELECT *, exp(-0.5 * (dy * dy + dx * dx) / 1.44::DOUBLE) AS w FROM j WHERE abs(dy) <= 4 AND abs(dx) <= 4)
SELECT volume_id, z, y, x, label, round(sum(w * dy) / sum(w), 6) AS c0, round(sum(w * dx) / sum(w), 6) AS c1, round(sum(w * dy * dy) / sum(w) - (sum(w * dy) / sum(w)) * (sum(w * dy) / sum(w)), 6) AS c2,
  round(sum(w * dx * dx) / sum(w) - (sum(w * dx) / sum(w)) * (sum(w * dx) / sum(w)), 6) AS c3, round(sum(w * dy * dx) / sum(w) - (sum(w * dy) / sum(w)) * (sum(w * dx) / sum(w)), 6) AS c4, round(sum(w), 6) AS c5
FROM w GROUP BY volume_id, z, y, x, label""")
def e5_shape_descriptors(spark, sf_dir):
    out = spread(E.shape_descriptors(fx.labels(spark, sf_dir), 1.2, ("y", "x"), 2), "lsds", 6, 6)
    return out.withColumns({f"c{i}": F.col(f"c{i}") + 0.0 for i in range(6)})


_LSD_3D = ["z", "y", "x"]
_LSD_MEAN = {a: f"sum(w * d{a}) / sum(w)" for a in _LSD_3D}
_LSD_ALL = [_LSD_MEAN[a] for a in _LSD_3D] + [f"sum(w * d{a} * d{b}) / sum(w) - ({_LSD_MEAN[a]}) * ({_LSD_MEAN[b]})" for a, b in ("zz", "yy", "xx", "zy", "zx", "yx")] + ["sum(w)"]


@query("e5_shape_descriptors_3d", """WITH c AS (SELECT volume_id, z // 2 AS z, y // 2 AS y, x // 2 AS x, label FROM fx_labels WHERE label > 0 AND z % 2 = 0 AND y % 2 = 0 AND x % 2 = 0),
t AS (SELECT *, z + unnest(range(-3, 4)) AS bz FROM c),
w AS (SELECT a.volume_id, a.z, a.y, a.x, a.label, (b.z - a.z)::DOUBLE AS dz, (b.y - a.y)::DOUBLE AS dy, (b.x - a.x)::DOUBLE AS dx, exp(-0.5 * ((b.z - a.z) ** 2 + (b.y - a.y) ** 2 + (b.x - a.x) ** 2) / 1.0::DOUBLE) AS w FROM t a JOIN c b ON b.z = a.bz AND b.label = a.label WHERE abs(b.y - a.y) <= 3 AND abs(b.x - a.x) <= 3)
SELECT volume_id, z, y, x, label, """ + ", ".join(f"round({e}, 6) AS c{i}" for i, e in enumerate(_LSD_ALL)) + " FROM w GROUP BY volume_id, z, y, x, label")
def e5_shape_descriptors_3d(spark, sf_dir):
    out = spread(E.shape_descriptors(fx.labels(spark, sf_dir), 1.0, downsample=2), "lsds", 10, 6)
    return out.withColumns({f"c{i}": F.col(f"c{i}") + 0.0 for i in range(10)})


@query("e6_mito_affinities", f"WITH fx_labels AS (SELECT volume_id, z, y, x, raw // 12 - 10 AS label FROM fx_raw) SELECT volume_id, z, y, x, {_aff(-1, 0, 0)} AS c0, {_aff(0, -1, 0)} AS c1, {_aff(0, 0, -1)} AS c2 FROM fx_labels l".replace("fx_labels", "mito"))
def e6_mito_affinities(spark, sf_dir):
    mito = fx.raw(spark, sf_dir).select(*KEY, F.expr("raw div 12 - 10 as mito"))
    return spread(E.affinities(mito, E.SHORT, "mito"), "affs", 3)


def _losses(spark, sf_dir):
    v = F.col("raw") / 255.0
    return fx.raw(spark, sf_dir).select("z", v.alias("p"), (F.col("x") / 8.0).alias("t"), ((F.col("raw") % 3).cast("double")).alias("w"))


@query("e7_weighted_mse", "SELECT z % 10 AS g, round(coalesce(avg(CASE WHEN raw % 3 > 0 THEN (raw % 3) * (raw / 255.0::DOUBLE - x / 8.0::DOUBLE) * (raw / 255.0::DOUBLE - x / 8.0::DOUBLE) END), 0), 6) AS loss FROM fx_raw GROUP BY 1")
def e7_weighted_mse(spark, sf_dir):
    return rounded(E.weighted_mse(_losses(spark, sf_dir).withColumn("g", F.col("z") % 10), by=["g"]), "loss")


@query("e8_multi_task_mse", "SELECT round(avg(CASE WHEN raw % 3 > 0 THEN (raw % 3) * (raw / 255.0::DOUBLE - x / 8.0::DOUBLE) * (raw / 255.0::DOUBLE - x / 8.0::DOUBLE) END) + 0.5 * avg(CASE WHEN raw / 255.0::DOUBLE > 0 THEN (raw / 255.0::DOUBLE) * (x / 8.0::DOUBLE - raw % 3) * (x / 8.0::DOUBLE - raw % 3) END), 6) AS loss FROM fx_raw")
def e8_multi_task_mse(spark, sf_dir):
    return rounded(E.multi_task_mse(_losses(spark, sf_dir), [("p", "t", "w"), ("t", "w", "p")], [1, 0.5]), "loss")


@query("e9_inverted_affinities", "SELECT volume_id, z, y, x, 255 - CAST(trunc(list_max(affs) * 255) AS INT) % 256 AS value FROM fx_affs")
def e9_inverted_affinities(spark, sf_dir):
    return E.inverted_affinities(fx.affs(spark, sf_dir))


@query("e10_export_indicator", "SELECT volume_id, z, y, x, CAST(trunc(indicator * 255) AS INT) % 256 AS value FROM fx_syn")
def e10_export_indicator(spark, sf_dir):
    return E.export_indicator(fx.syn(spark, sf_dir))


@query("e10_indicator_metadata", "SELECT DISTINCT volume_id, 'volumes/pred_syn_indicator' AS dataset, 'uint8' AS dtype, 255.0::DOUBLE AS scale FROM fx_syn")
def e10_indicator_metadata(spark, sf_dir):
    return E.output_metadata(fx.syn(spark, sf_dir), {"indicator": ("volumes/pred_syn_indicator", "uint8", 255.0)})


_CLIP = "CAST(trunc(greatest(-128, least(127, vec[{}] / 0.05::DOUBLE * 0.25::DOUBLE))) AS INT)"


@query("e11_export_vectors", f"SELECT volume_id, z, y, x, {_CLIP.format(1)} AS c0, {_CLIP.format(2)} AS c1, {_CLIP.format(3)} AS c2 FROM fx_syn")
def e11_export_vectors(spark, sf_dir):
    return spread(E.export_vectors(fx.syn(spark, sf_dir), to_nm=0.05), "vec", 3)


@query("e12_fuse_predictions", "WITH i AS MATERIALIZED (SELECT volume_id, z, y, x, indicator FROM fx_syn WHERE z % 3 <> 0), v AS MATERIALIZED (SELECT volume_id, z, y, x, vec[3] AS dx FROM fx_syn WHERE z % 4 <> 0), j AS MATERIALIZED (SELECT i.volume_id, i.z, i.y, i.x, indicator, dx FROM i LEFT JOIN v ON v.volume_id = i.volume_id AND v.z = i.z AND v.y = i.y AND v.x = i.x), k AS MATERIALIZED (SELECT v.volume_id, v.z, v.y, v.x, dx FROM v ANTI JOIN i ON v.volume_id = i.volume_id AND v.z = i.z AND v.y = i.y AND v.x = i.x) SELECT volume_id, z, y, x, round(indicator, 6) AS indicator, round(dx, 6) AS dx FROM j UNION ALL SELECT volume_id, z, y, x, NULL, round(dx, 6) FROM k")
def e12_fuse_predictions(spark, sf_dir):
    s = fx.syn(spark, sf_dir)
    both = E.fuse_predictions(s.where("z % 3 != 0").drop("vec"), s.where("z % 4 != 0").drop("indicator"), "full_outer")
    return both.select(*KEY, F.round("indicator", 6).alias("indicator"), F.round(F.get("vec", F.lit(2)), 6).alias("dx"))


@query("e13_output_properties", "SELECT volume_id, z, y, x, CAST(trunc(indicator * 255) AS INT) AS pred_syn_indicator FROM fx_syn")
def e13_output_properties(spark, sf_dir):
    return E.apply_output_properties(fx.syn(spark, sf_dir).drop("vec"), {"indicator": ("pred_syn_indicator", "int", 255.0)})


@query("f1_apply_mask", "SELECT volume_id, z, y, x, label * coalesce(mask, 0) AS label FROM fx_labels LEFT JOIN (SELECT volume_id, z, y, x, mask FROM fx_mask WHERE z % 3 <> 0) USING (volume_id, z, y, x)")
def f1_apply_mask(spark, sf_dir):
    return R.apply_mask(fx.labels(spark, sf_dir).drop("raw"), fx.mask(spark, sf_dir).where("z % 3 != 0"), "label").select(*KEY, "label")


@query("f2_affinity_range", "SELECT volume_id, z, y, x, round(raw / 255.0::DOUBLE, 6) AS value FROM fx_raw")
def f2_affinity_range(spark, sf_dir):
    df = fx.raw(spark, sf_dir)
    return df.select(*KEY, F.round(P.affinity_range(F.col("raw"), df.schema["raw"].dataType.simpleString()), 6).alias("value"))


@query("f3_boundary_mask", "SELECT volume_id, z, y, x, round((affs[1] + affs[2] + affs[3]) / 3, 9) > 0.5 AS whole, 0.5 * (affs[2] + affs[3]) > 0.5 AS section FROM fx_affs")
def f3_boundary_mask(spark, sf_dir):
    return fx.affs(spark, sf_dir).select(*KEY, P.boundary_mask(F.col("affs")).alias("whole"), P.boundary_mask(F.col("affs"), True).alias("section"))


def _inside(spark, sf_dir):
    return fx.affs(spark, sf_dir).select(*KEY, P.boundary_mask(F.col("affs"), True).cast("int").alias("mask"))


_INSIDE = "WITH m AS (SELECT volume_id, z, y, x, CASE WHEN 0.5 * (affs[2] + affs[3]) > 0.5 THEN 1 ELSE 0 END AS mask FROM fx_affs), dt AS (SELECT a.volume_id, a.z, a.y, a.x, sqrt(min((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x))::DOUBLE) AS distance FROM m a LEFT JOIN m b ON b.z = a.z AND b.mask = 0 GROUP BY 1, 2, 3, 4)"


@query("f4_distance_transform", _INSIDE + " SELECT volume_id, z, y, x, round(distance, 6) AS distance FROM dt")
def f4_distance_transform(spark, sf_dir):
    return rounded(R.distance_transform(_inside(spark, sf_dir), ("y", "x")), "distance")


@query("f5_lsd_distance", "WITH v AS (SELECT volume_id, z, y, x, list_sum(list_transform(lsds[1:3], lambda v: v * v)) AS value FROM fx_lsds), " + _gauss_sql("v", 0.8) + " SELECT volume_id, z, y, x, round((SELECT max(value) FROM gx) - value, 5) AS distance FROM gx")
def f5_lsd_distance(spark, sf_dir):
    return rounded(R.lsd_distance(fx.lsds(spark, sf_dir), 0.8, {"y": 8, "x": 8}), "distance", digits=5)


_SEEDS = _INSIDE + ", sd AS (SELECT a.volume_id, a.z, a.y, a.x, a.distance, CASE WHEN a.distance = max(b.distance) THEN 1 ELSE 0 END AS seed FROM dt a JOIN dt b ON b.z = a.z AND b.y BETWEEN a.y - 2 AND a.y + 1 AND b.x BETWEEN a.x - 2 AND a.x + 1 GROUP BY 1, 2, 3, 4, 5)"


@query("f6_seeds", _SEEDS + " SELECT volume_id, z, y, x, seed FROM sd")
def f6_seeds(spark, sf_dir):
    return R.seeds(R.distance_transform(_inside(spark, sf_dir), ("y", "x")), 4, ("y", "x")).select(*KEY, "seed")


@query("f7_label_seeds", _SEEDS + """, s AS (SELECT z, y * 8 + x AS i, x FROM sd WHERE seed = 1),
r AS (SELECT z, i, i AS reach FROM s UNION SELECT r.z, s.i, r.reach FROM r JOIN s ON s.z = r.z AND (s.i = r.i + 8 OR s.i = r.i - 8 OR (s.i = r.i + 1 AND s.x > 0) OR (s.i = r.i - 1 AND s.x < 7))),
c AS (SELECT z, i, min(reach) AS first FROM r GROUP BY 1, 2)
SELECT 0 AS volume_id, z, i // 8 AS y, i % 8 AS x, dense_rank() OVER (ORDER BY z, first) AS seed_id FROM c""", True)
def f7_label_seeds(spark, sf_dir):
    found = R.seeds(R.distance_transform(_inside(spark, sf_dir), ("y", "x")), 4, ("y", "x"))
    return R.label_seeds(found, ("y", "x"))


_FLOOD = _SEEDS + """, s AS (SELECT z, y * 8 + x AS i, x FROM sd WHERE seed = 1),
q(z, i, reach) AS (SELECT z, i, i FROM s UNION SELECT q.z, s.i, q.reach FROM q JOIN s ON s.z = q.z AND (s.i = q.i + 8 OR s.i = q.i - 8 OR (s.i = q.i + 1 AND s.x > 0) OR (s.i = q.i - 1 AND s.x < 7))),
sl AS MATERIALIZED (SELECT z, i, dense_rank() OVER (ORDER BY z, first) AS label FROM (SELECT z, i, min(reach) AS first FROM q GROUP BY 1, 2)),
v AS MATERIALIZED (SELECT z * 64 + y * 8 + x AS n, z // 25 AS block, z, y, x, -coalesce(CAST(round(distance * distance) AS INT), 0) AS h FROM sd),
nb AS MATERIALIZED (SELECT a.n, b.n AS m FROM (SELECT *, z + dz AS bz, y + dy AS bx_y, x + dx AS bx FROM v, (SELECT * FROM (VALUES (1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) t(dz, dy, dx))) a JOIN v b ON b.z = bz AND b.y = bx_y AND b.x = bx AND b.block = a.block),
r(n, block, h, label, seed) USING KEY (n) AS (SELECT z * 64 + i, z // 25, NULL::INT, label, true FROM sl
UNION (WITH cand AS (SELECT nb.m AS n, arg_min(o.label, o.n) AS label FROM recurring.r o JOIN nb ON nb.n = o.n LEFT JOIN recurring.r d ON d.n = nb.m WHERE d.n IS NULL AND EXISTS (SELECT 1 FROM r) GROUP BY nb.m),
  c AS (SELECT cand.n, v.block, v.h, label FROM cand JOIN v USING (n)), low AS (SELECT block, min(h) AS low FROM c GROUP BY block), top AS (SELECT block, max(h) AS top FROM recurring.r GROUP BY block)
  SELECT c.n, c.block, c.h, c.label, false FROM c JOIN low USING (block) JOIN top USING (block) WHERE c.h <= greatest(low, coalesce(top, low))))
SELECT 0 AS volume_id, v.block AS block_id, z, y, x, coalesce(label, 0) AS fragment FROM v LEFT JOIN r USING (n)"""


@query("f8_watershed", _FLOOD, True)
def f8_watershed(spark, sf_dir):
    d = R.distance_transform(_inside(spark, sf_dir), ("y", "x"))
    marks = R.label_seeds(R.seeds(d, 4, ("y", "x")), ("y", "x"))
    given = d.join(marks, KEY, "left").select(*KEY, "distance", F.coalesce("seed_id", F.lit(0)).cast("bigint").alias("seed_id"))
    return R.watershed(given, (0, 0, 0), (depth(spark, sf_dir), 8, 8), (25, 8, 8))


def _edge_list(spark, sf_dir):
    return fx.graph_edges(spark, sf_dir)


# recursion keeps one row a node, its smallest reachable one so far, so whole graphs stay cheap in SQL too
_REACH = """r(node, component) USING KEY (node) AS (SELECT node, node AS component FROM n UNION
  SELECT b.v, min(r.component) FROM r JOIN b ON b.u = r.node JOIN recurring.r o ON o.node = b.v WHERE r.component < o.component GROUP BY b.v)"""
_COMPONENTS = f"""WITH e AS (SELECT u, v FROM fx_rag_edges WHERE merge_score <= 0.01), n AS (SELECT u AS node FROM e UNION SELECT v FROM e), b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
{_REACH} SELECT node, component FROM r"""


@query("f9_components", _COMPONENTS, True)
def f9_components(spark, sf_dir):
    from cortexgrid.operators.components import components_of_edges

    return components_of_edges(_edge_list(spark, sf_dir).where("merge_score <= 0.01").select("u", "v"))


@query("f10_filter_fragments", "WITH k AS (SELECT label FROM fx_labels JOIN fx_affs USING (volume_id, z, y, x) GROUP BY label HAVING avg((affs[2] + affs[3]) / 2) < 0.45) SELECT volume_id, z, y, x, CASE WHEN label IN (SELECT label FROM k) THEN 0 ELSE label END AS label FROM fx_labels")
def f10_filter_fragments(spark, sf_dir):
    return R.filter_fragments(fx.labels(spark, sf_dir).drop("raw"), fx.affs(spark, sf_dir), 0.45, True, "label")


@query("f11_fragment_nodes", "SELECT label AS node, round(avg(z) * 40 + 100, 4) AS center_z, round(avg(y) * 4, 4) AS center_y, round(avg(x) * 4, 4) AS center_x FROM fx_labels WHERE label > 0 GROUP BY label")
def f11_fragment_nodes(spark, sf_dir):
    return rounded(H.fragment_nodes(fx.labels(spark, sf_dir), (40, 4, 4), (100, 0, 0)), "center_z", "center_y", "center_x", digits=4)


_HALF = "(SELECT * FROM (VALUES " + ", ".join(f"({z}, {y}, {x})" for z, y, x in H.half_neighbourhood(2)) + ") t(dz, dy, dx))"


@query("f12_rag_edges", f"WITH s AS MATERIALIZED (SELECT label, z + dz AS bz, y + dy AS bx_y, x + dx AS bx FROM fx_labels, {_HALF} WHERE label > 0), j AS MATERIALIZED (SELECT s.label AS la, b.label AS lb FROM s JOIN fx_labels b ON b.z = bz AND b.y = bx_y AND b.x = bx) SELECT DISTINCT least(la, lb) AS u, greatest(la, lb) AS v FROM j WHERE lb > 0 AND la <> lb")
def f12_rag_edges(spark, sf_dir):
    return H.rag_edges(fx.labels(spark, sf_dir))


_FACE_PAIRS = "(SELECT * FROM (VALUES (-1, 0, 0), (0, -1, 0), (0, 0, -1)) t(dz, dy, dx))"


@query("f12_rag_edges_faces", f"WITH s AS MATERIALIZED (SELECT label, z + dz AS bz, y + dy AS bx_y, x + dx AS bx FROM fx_labels, {_FACE_PAIRS} WHERE label > 0), j AS MATERIALIZED (SELECT s.label AS la, b.label AS lb FROM s JOIN fx_labels b ON b.z = bz AND b.y = bx_y AND b.x = bx) SELECT DISTINCT least(la, lb) AS u, greatest(la, lb) AS v FROM j WHERE lb > 0 AND la <> lb")
def f12_rag_edges_faces(spark, sf_dir):
    return H.rag_edges(fx.labels(spark, sf_dir), 1)


_CONTACTS = """WITH o AS (SELECT * FROM (VALUES (1, -1, 0, 0), (2, 0, -1, 0), (3, 0, 0, -1)) t(c, dz, dy, dx)),
s AS MATERIALIZED (SELECT label, c, z, y, x, z + dz AS bz, y + dy AS bx_y, x + dx AS bx FROM fx_labels, o WHERE label > 0),
j AS MATERIALIZED (SELECT s.label AS la, b.label AS lb, c, s.z, s.y, s.x FROM s JOIN fx_labels b ON b.z = bz AND b.y = bx_y AND b.x = bx),
met AS (SELECT least(la, lb) AS u, greatest(la, lb) AS v, f.affs[c] AS a FROM j JOIN fx_affs f ON f.z = j.z AND f.y = j.y AND f.x = j.x WHERE lb > 0 AND la <> lb)"""


def _bins(spark, sf_dir):
    return H.contact_bins(fx.labels(spark, sf_dir), fx.affs(spark, sf_dir))


@query("f13_score_edges", _CONTACTS + " SELECT u, v, count(*) AS contacts, round(1 - CAST(sum(CAST(round(a * 1000000000) AS BIGINT)) AS DOUBLE) / CAST(count(*) * 1000000000 AS DOUBLE), 9) AS merge_score FROM met GROUP BY u, v")
def f13_score_edges(spark, sf_dir):
    return H.score_bins(_bins(spark, sf_dir))


@query("f13_score_edges_quantile", _CONTACTS + """, h AS (SELECT u, v, CAST(floor(a * 255) AS INT) AS bin, count(*) AS n FROM met GROUP BY ALL), q AS (SELECT u, v, bin, sum(n) OVER (PARTITION BY u, v ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY u, v) AS total FROM h)
SELECT u, v, CAST(min(total) AS BIGINT) AS contacts, round(1 - min(bin) / 255.0::DOUBLE, 6) AS merge_score FROM q WHERE upto >= 0.25 * total GROUP BY u, v""")
def f13_score_edges_quantile(spark, sf_dir):
    return rounded(H.score_bins(_bins(spark, sf_dir), "quantile"), "merge_score")


@query("f14_edge_centers", "SELECT e.u, e.v, e.contacts, round((a.center_z + b.center_z) / 2, 4) AS center_z, round((a.center_y + b.center_y) / 2, 4) AS center_y, round((a.center_x + b.center_x) / 2, 4) AS center_x FROM fx_rag_edges e JOIN fx_rag_nodes a ON a.node = e.u JOIN fx_rag_nodes b ON b.node = e.v")
def f14_edge_centers(spark, sf_dir):
    out = H.edge_centers(_edge_list(spark, sf_dir).drop("merge_score"), fx.graph_nodes(spark, sf_dir))
    return rounded(out, "center_z", "center_y", "center_x", digits=4)


@query("f15_init_rag", "SELECT u, v, CAST(NULL AS DOUBLE) AS merge_score, 0 AS agglomerated, 1 AS labels FROM fx_rag_edges JOIN fx_rag_nodes ON node = u")
def f15_init_rag(spark, sf_dir):
    nodes, edges = H.init_rag(fx.graph_nodes(spark, sf_dir), _edge_list(spark, sf_dir).select("u", "v"))
    return edges.join(nodes, F.col("u") == F.col("node")).select("u", "v", "merge_score", "agglomerated", F.size("labels").alias("labels"))


@query("f16_rag_slice", "SELECT * FROM fx_rag_nodes WHERE center_z >= 10 AND center_z < 30 AND center_y >= 0 AND center_y < 1500 AND center_x >= 20 AND center_x < 60")
def f16_rag_slice(spark, sf_dir):
    return H.rag_slice(fx.graph_nodes(spark, sf_dir), (10, 0, 20), (20, 1500, 40))


def _whole_graph(spark, sf_dir):
    return fx.graph_nodes(spark, sf_dir), _edge_list(spark, sf_dir)


_GRAPH = f"""WITH e AS (SELECT * FROM fx_rag_edges), n AS (SELECT node FROM fx_rag_nodes), k AS (SELECT u, v FROM e WHERE merge_score <= 0.01), b AS (SELECT u, v FROM k UNION SELECT v, u FROM k),
{_REACH}, c AS (SELECT node, component FROM r)"""
_SEGMENT = _GRAPH + " SELECT node, dense_rank() OVER (ORDER BY component) AS segment FROM c"
_CONTRACT = _GRAPH + " SELECT least(p.component, q.component) AS u, greatest(p.component, q.component) AS v, CAST(NULL AS DOUBLE) AS merge_score, 0 AS agglomerated FROM e JOIN c p ON p.node = e.u JOIN c q ON q.node = e.v WHERE p.component <> q.component GROUP BY 1, 2"
_CONTRACT_NODES = _GRAPH + " SELECT component AS node, array_to_string(list_sort(list(node)), ',') AS labels FROM c GROUP BY component"


@query("f17_segment", _SEGMENT, True)
def f17_segment(spark, sf_dir):
    return H.segment(*_whole_graph(spark, sf_dir), 0.01)


@query("f18_contract", _CONTRACT, True)
def f18_contract(spark, sf_dir):
    return H.contract(*_whole_graph(spark, sf_dir), 0.01)[1]


@query("f18_contract_nodes", _CONTRACT_NODES, True)
def f18_contract_nodes(spark, sf_dir):
    return H.contract(*_whole_graph(spark, sf_dir), 0.01)[0].select("node", F.array_join(F.col("labels").cast("array<string>"), ",").alias("labels"))


@query("f19_relabel", "SELECT volume_id, z, y, x, CASE WHEN label % 3 = 1 THEN label + 1000 ELSE label END AS label FROM fx_labels")
def f19_relabel(spark, sf_dir):
    df = fx.labels(spark, sf_dir).drop("raw")
    return H.relabel(df, df.where("label % 3 = 1").select(F.col("label").alias("old"), (F.col("label") + 1000).alias("new")).distinct())


@query("f20_compact_ids", "WITH d AS (SELECT label, dense_rank() OVER (ORDER BY label) AS i FROM (SELECT DISTINCT label FROM fx_labels WHERE label > 0 AND label % 4 <> 2)) SELECT volume_id, z, y, x, coalesce(i, label) AS label FROM (SELECT volume_id, z, y, x, CASE WHEN label % 4 = 2 THEN 0 ELSE label END AS label FROM fx_labels) LEFT JOIN d USING (label)")
def f20_compact_ids(spark, sf_dir):
    df = fx.labels(spark, sf_dir).drop("raw").withColumn("label", F.when(F.col("label") % 4 == 2, F.lit(0)).otherwise(F.col("label")).cast("bigint"))
    return H.compact_ids(df)


def _rounds(start: str, score: str, merge: str, threshold: float) -> str:
    """Rounds of mutually best merges: each starts from the edges (kind 0) and places (kind 1) of the one before."""
    return f"""{_CONTACTS}, r AS (
SELECT 0 AS k, 0 AS kind, u, v, u AS ta, v AS tb, x, n FROM ({start})
UNION ALL SELECT DISTINCT 0, 1, label, label, 0, 0, 0.0::DOUBLE, 0.0::DOUBLE FROM fx_labels WHERE label > 0
UNION ALL (WITH e AS (SELECT * FROM r WHERE kind = 0), s AS (SELECT u, v, {{'score': score, 'a': tie.a, 'b': tie.b}} AS rank FROM ({score}) WHERE score <= {threshold}),
y AS (SELECT n, arg_min(u, rank) AS u, arg_min(v, rank) AS v FROM (SELECT u AS n, u, v, rank FROM s UNION ALL SELECT v, u, v, rank FROM s) GROUP BY n),
m AS (SELECT v AS old, u AS new FROM y GROUP BY u, v HAVING count(*) = 2),
z AS (SELECT coalesce(a.new, u) AS p, coalesce(b.new, v) AS q, ta, tb, x, n FROM e LEFT JOIN m a ON a.old = u LEFT JOIN m b ON b.old = v),
w AS (SELECT least(p, q) AS u, greatest(p, q) AS v, {{'a': ta, 'b': tb}} AS tie, x, n FROM z WHERE p <> q),
i AS (SELECT max(k) + 1 AS k FROM r)
SELECT k, 0, u, v, tie.a, tie.b, x, n FROM ({merge}), i WHERE EXISTS (SELECT 1 FROM m)
UNION ALL SELECT i.k, 1, r.u, coalesce(new, r.v), 0, 0, 0, 0 FROM r LEFT JOIN m ON old = r.v, i WHERE kind = 1 AND EXISTS (SELECT 1 FROM m)))
SELECT u AS node, v AS segment FROM r WHERE kind = 1 AND k = (SELECT max(k) FROM r)"""


_BY_MEAN = _rounds(
    "SELECT u, v, round(1 - CAST(sum(CAST(round(a * 1000000000) AS BIGINT)) AS DOUBLE) / CAST(count(*) * 1000000000 AS DOUBLE), 9) * count(*) AS x, CAST(count(*) AS DOUBLE) AS n FROM met GROUP BY u, v",
    "SELECT u, v, {'a': ta, 'b': tb} AS tie, round(x / n, 9) AS score FROM e",
    "SELECT u, v, max(tie) AS tie, sum(x) AS x, sum(n) AS n FROM w GROUP BY u, v", 0.55,
)
_BY_QUANTILE = _rounds(
    "SELECT u, v, CAST(least(255, floor(a * 255)) AS DOUBLE) AS x, CAST(count(*) AS DOUBLE) AS n FROM met GROUP BY ALL",
    "SELECT u, v, max({'a': ta, 'b': tb}) AS tie, 1 - min(x) FILTER (upto >= 0.25 * total) / 255.0::DOUBLE AS score FROM (SELECT *, sum(n) OVER (PARTITION BY u, v ORDER BY x) AS upto, sum(n) OVER (PARTITION BY u, v) AS total FROM e) GROUP BY u, v",
    "SELECT u, v, max(tie) AS tie, x, sum(n) AS n FROM w GROUP BY u, v, x", 0.75,
)


@query("f21_agglomerate", _BY_MEAN, True)
def f21_agglomerate(spark, sf_dir):
    nodes = H.fragment_nodes(fx.labels(spark, sf_dir))
    return H.agglomerate(nodes, H.score_bins(_bins(spark, sf_dir)), 0.55)


@query("f21_agglomerate_quantile", _BY_QUANTILE, True)
def f21_agglomerate_quantile(spark, sf_dir):
    nodes = H.fragment_nodes(fx.labels(spark, sf_dir))
    return H.agglomerate_quantile(nodes, _bins(spark, sf_dir), 0.75)


@query("f22_sweep", _CONTACTS + """, e AS (SELECT u, v, 1 - avg(a) AS s FROM met GROUP BY u, v), n AS (SELECT DISTINCT label AS node FROM fx_labels WHERE label > 0), t AS (SELECT 0.35 + 0.05 * unnest(range(0, 9)) AS t),
b AS (SELECT t, u, v FROM e, t WHERE s <= t + 1e-12 UNION SELECT t, v, u FROM e, t WHERE s <= t + 1e-12),
r AS (SELECT t, node, node AS reach FROM n, t UNION SELECT b.t, b.v, r.reach FROM r JOIN b ON b.u = r.node AND b.t = r.t WHERE r.reach < b.v)
SELECT 'segmentation_' || replace(CAST(CAST(round(t, 2) AS DOUBLE) AS VARCHAR), '.', '') AS name, node, min(reach) AS segment FROM r GROUP BY t, node""", True)
def f22_sweep(spark, sf_dir):
    return H.sweep(H.fragment_nodes(fx.labels(spark, sf_dir)), H.score_bins(_bins(spark, sf_dir)))


@query("g1_log_blocks", "SELECT block_id, worker, md5(worker || status) AS run_id FROM fx_done")
def g1_log_blocks(spark, sf_dir):
    return L.log_blocks(fx.done(spark, sf_dir), ["worker", "status"]).select("block_id", "worker", "run_id")


@query("g2_pending_blocks", "SELECT block_id FROM fx_log WHERE block_id NOT IN (SELECT block_id FROM fx_done)")
def g2_pending_blocks(spark, sf_dir):
    return L.pending_blocks(fx.log(spark, sf_dir).select("block_id"), fx.done(spark, sf_dir))


@query("g2_pending_overwrite", "SELECT block_id FROM fx_log")
def g2_pending_overwrite(spark, sf_dir):
    return L.pending_blocks(fx.log(spark, sf_dir).select("block_id"), fx.done(spark, sf_dir), overwrite=True)


@query("g3_pending_by_nodes", "WITH g AS (SELECT unnest(range(0, 10 * 20 * 10)) AS block_id) SELECT block_id FROM g WHERE block_id NOT IN (SELECT CAST((floor(center_z / 5) * 20 + floor(center_y / 100)) * 10 + floor(center_x / 10) AS BIGINT) FROM fx_rag_nodes WHERE center_z >= 0 AND center_z < 50 AND center_y >= 0 AND center_y < 2000 AND center_x >= 0 AND center_x < 100)")
def g3_pending_by_nodes(spark, sf_dir):
    grid = B.block_grid(spark, (0, 0, 0), (50, 2000, 100), (5, 100, 10)).select("block_id")
    return L.pending_by_nodes(grid, fx.graph_nodes(spark, sf_dir), (0, 0, 0), (5, 100, 10), (10, 20, 10))


@query("g5_progress", "SELECT worker, date_trunc('hour', start) AS bucket, count(*) AS blocks, round(sum(duration), 4) AS total_duration, round(avg(duration), 4) AS mean_duration FROM fx_done GROUP BY 1, 2")
def g5_progress(spark, sf_dir):
    return rounded(L.progress(fx.done(spark, sf_dir)), "total_duration", "mean_duration", digits=4)


@query("g6_incomplete", "SELECT count(*) AS pending FROM fx_log WHERE block_id NOT IN (SELECT block_id FROM fx_done)")
def g6_incomplete(spark, sf_dir):
    grid, log = fx.log(spark, sf_dir).select("block_id"), fx.done(spark, sf_dir)
    L.assert_complete(log.select("block_id").distinct(), log)
    try:
        L.assert_complete(grid, log)
        pending = 0
    except L.IncompleteError as e:
        pending = e.pending
    return spark.createDataFrame([(pending,)], "pending long")


@query("g11_dataset_pairs", "SELECT a.n_name AS source, b.n_name AS target FROM nation a JOIN nation b ON a.n_name <> b.n_name")
def g11_dataset_pairs(spark, sf_dir):
    return S.dataset_pairs(fx.table(spark, sf_dir, "nation"), "n_name")


def _container(spark, sf_dir) -> str:
    """The raw volume written as a chunked container in the shared folder."""
    path = scratch_path(spark, "volume") + ".zarr"
    V.write_volume(fx.raw(spark, sf_dir).withColumnRenamed("raw", "value"), path, "volumes/raw", (depth(spark, sf_dir), 8, 8), (32, 8, 8), "|u1", {"offset": [0, 0, 0], "resolution": [40, 4, 4]})
    return path


@query("a1_read_volume", f"WITH d AS {_N} SELECT z, y, x, CAST(raw AS BIGINT) AS value FROM fx_raw, d WHERE z >= 10 AND z < n - 5 AND x < 6")
def a1_read_volume(spark, sf_dir):
    n = depth(spark, sf_dir)
    return V.read_volume(spark, _container(spark, sf_dir), "volumes/raw", ((10, 0, 0), (n - 5, 8, 6))).drop("volume_id")


@query("a4_write_volume", "SELECT z, y, x, label AS value FROM fx_labels_bg")
def a4_write_volume(spark, sf_dir):
    path = scratch_path(spark, "volume") + ".zarr"
    V.write_volume(fx.labels_bg(spark, sf_dir).withColumn("value", F.col("label")), path, "volumes/labels/neuron_ids", (depth(spark, sf_dir), 8, 8), (64, 4, 8), "<u8")
    return V.read_volume(spark, path, "volumes/labels/neuron_ids").drop("volume_id")


@query("a5_list_datasets", "SELECT 'volumes/class_' || label AS dataset FROM embeddings WHERE label IS NOT NULL GROUP BY label")
def a5_list_datasets(spark, sf_dir):
    """A container with one array for each class of sections."""
    path = scratch_path(spark, "volume") + ".zarr"
    sections = fx.table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("z"), F.lit(0).alias("y"), F.lit(0).alias("x"), F.lit(1).alias("value"))
    for r in sections.select("label").distinct().where("label is not null").collect():
        V.write_volume(sections.where(F.col("label") == r.label), path, f"volumes/class_{r.label}", (depth(spark, sf_dir), 1, 1), (500, 1, 1))
    return V.list_datasets(spark, path)


@query("a6_read_volumes", "SELECT z, y, x, CAST(2 * raw AS BIGINT) AS total FROM fx_raw")
def a6_read_volumes(spark, sf_dir):
    both = V.read_volumes(spark, [_container(spark, sf_dir), _container(spark, sf_dir)], "volumes/raw")
    return both.groupBy("z", "y", "x").agg(F.sum("value").alias("total"))


@query("a7_copy_datasets", "SELECT z, y, x, CAST(raw AS BIGINT) AS value FROM fx_raw")
def a7_copy_datasets(spark, sf_dir):
    source = _container(spark, sf_dir)
    target = scratch_path(spark, "copies")
    V.copy_datasets(spark, [source], target, ["volumes/raw", "volumes/none"])
    return V.read_volume(spark, f"{target}/{source.rsplit('/', 1)[-1]}", "volumes/raw").drop("volume_id")


@query("f23_write_rag", "SELECT e.u, e.v, e.contacts FROM fx_rag_edges e JOIN fx_rag_nodes a ON a.node = e.u JOIN fx_rag_nodes b ON b.node = e.v WHERE (a.center_z + b.center_z) / 2 >= 5 AND (a.center_z + b.center_z) / 2 < 25 AND (a.center_y + b.center_y) / 2 >= 0 AND (a.center_y + b.center_y) / 2 < 4000 AND (a.center_x + b.center_x) / 2 >= 0 AND (a.center_x + b.center_x) / 2 < 50")
def f23_write_rag(spark, sf_dir):
    path = scratch_path(spark, "rag")
    nodes = fx.graph_nodes(spark, sf_dir)
    H.write_rag(nodes, H.edge_centers(_edge_list(spark, sf_dir), nodes), path, (5, 0, 0), (20, 4000, 50), (10, 2000, 50))
    return spark.read.parquet(f"{path}/edges").select("u", "v", "contacts")


@query("f16_rag_store", "SELECT e.u, e.v, e.contacts FROM fx_rag_edges e JOIN fx_rag_nodes a ON a.node = e.u JOIN fx_rag_nodes b ON b.node = e.v WHERE (a.center_z + b.center_z) / 2 >= 12 AND (a.center_z + b.center_z) / 2 < 31 AND (a.center_y + b.center_y) / 2 >= 100 AND (a.center_y + b.center_y) / 2 < 3000 AND (a.center_x + b.center_x) / 2 >= 7 AND (a.center_x + b.center_x) / 2 < 41")
def f16_rag_store(spark, sf_dir):
    """The whole graph written by block, then a box read."""
    path, block = scratch_path(spark, "rag"), (10, 2000, 50)
    nodes = fx.graph_nodes(spark, sf_dir)
    far = (-10**7,) * 3, (2 * 10**7,) * 3
    H.write_rag(nodes, H.edge_centers(_edge_list(spark, sf_dir), nodes), path, *far, block)
    return H.read_rag(spark, path, (12, 100, 7), (19, 2900, 34), block)[1].select("u", "v", "contacts")


@query("g4_pending_stream", "SELECT block_id FROM fx_log WHERE block_id NOT IN (SELECT block_id FROM fx_done)")
def g4_pending_stream(spark, sf_dir):
    done = fx.done(spark, sf_dir).select("block_id", F.col("start").cast("timestamp").alias("start"), F.col("duration").cast("double").alias("duration"), "worker")
    entries, out = scratch_path(spark, "entries"), scratch_path(spark, "finished")
    done.unionByName(done).write.parquet(entries)  # each row twice
    grid = fx.log(spark, sf_dir).select("block_id")
    pending_stream(grid, log_stream(spark, entries), out, scratch_path(spark, "stream")).awaitTermination()
    return pending_after(spark, grid, out)


@query("g4_block_states", "SELECT block_id, CASE WHEN block_id IN (SELECT block_id FROM fx_done) THEN 'finished' ELSE 'pending' END AS status, false AS overdue FROM (SELECT DISTINCT block_id FROM fx_log)")
def g4_block_states(spark, sf_dir):
    """All blocks planned and the log read as streams; the deadline is far off."""
    grid, entries, out = (scratch_path(spark, name) for name in ("grid", "entries", "states"))
    fx.log(spark, sf_dir).select("block_id").distinct().write.parquet(grid)
    done = fx.done(spark, sf_dir).select("block_id", F.col("duration").cast("double").alias("duration"))
    done.unionByName(done).write.parquet(entries)  # each row twice
    planned, log = spark.readStream.schema("block_id long").parquet(grid), spark.readStream.schema("block_id long, duration double").parquet(entries)
    running = states_stream(planned, log, out, scratch_path(spark, "stream"), 86_400_000, "1 second")
    try:
        wait_idle(running)
    finally:
        running.stop()
    return current_states(spark, out).select("block_id", "status", "overdue")


_BMP_ROWS = "z long, bytes long"


def _bitmap(pixels) -> bytes:
    """A 24-bit bitmap, bottom row first, rows padded to 4 bytes."""
    h, w = pixels.shape
    row = -(-3 * w // 4) * 4
    body = np.zeros((h, row), np.uint8)
    body[:, : 3 * w] = np.repeat(pixels[::-1], 3, axis=1)
    head = [54 + h * row, 0, 54, 40, w, h, 1 | 24 << 16, 0, 0, 0, 0, 0, 0]
    return b"BM" + np.array(head, "<u4").tobytes() + body.tobytes()


@query("a9_read_sections", "SELECT z AS section_id, y, x, raw AS value FROM fx_raw")
def a9_read_sections(spark, sf_dir):
    """A folder of grey images, one for each section; written to the shared folder first."""
    from pyarrow import fs

    folder = scratch_path(spark, "images")
    uri = folder if "://" in folder else f"file://{folder}"

    def put(pdf: pd.DataFrame) -> pd.DataFrame:
        z, y, x, raw = (pdf[c].to_numpy() for c in ("z", "y", "x", "raw"))
        z, pixels = int(z[0]), raw[np.lexsort((x, y))].astype(np.uint8).reshape(int(y.max()) + 1, -1)
        own, place = fs.FileSystem.from_uri(f"{uri}/s{z}.bmp")
        own.create_dir(place.rsplit("/", 1)[0], recursive=True)
        data = _bitmap(pixels)
        with own.open_output_stream(place) as f:
            f.write(data)
        return pd.DataFrame({"z": [z], "bytes": [len(data)]})

    fx.raw(spark, sf_dir).groupBy("z").applyInPandas(put, _BMP_ROWS).agg(F.sum("bytes")).collect()
    return V.read_sections(spark, folder).drop("name")
