"""Whole sections, masks and stacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cortexgrid.operators.graph import numbered
from cortexgrid.operators.grid import KEY


def concat_channels(raw: DataFrame, channels: DataFrame, value: str, array: str) -> DataFrame:
    """Value in front of the channel array, by voxel."""
    return raw.join(channels, KEY).withColumn(array, F.concat(F.array(F.col(value).cast("double")), F.col(array)))


def export_sections(df: DataFrame, mask: str = "mask", sections: tuple[int, int] | None = None) -> DataFrame:
    """Voxels of sections with a set mask, with section_id counted from 0; by default without the last section."""
    own = df if sections is None else df.where(F.col("z").between(sections[0], sections[1] - 1))
    if sections is None:
        last = df.groupBy("volume_id").agg(F.max("z").alias("_last"))
        own = df.join(last, "volume_id").where("z < _last").drop("_last")
    full = own.groupBy("volume_id", "z").agg(F.max(mask).alias("_m")).where("_m > 0")
    numbered = full.withColumn("section_id", (F.row_number().over(Window.partitionBy("volume_id").orderBy("z")) - 1).cast("bigint")).drop("_m")
    return own.join(numbered, ["volume_id", "z"])


def background_mask(df: DataFrame, background: int, label: str = "label") -> DataFrame:
    """mask = label differs from the background, which becomes 0; it is an error if it never occurs."""
    if df.where(F.col(label) == background).isEmpty():
        raise ValueError(f"background {background} doesn't occur in {label}")
    return df.withColumn("mask", (F.col(label) != background).cast("int")).withColumn(label, F.when(F.col(label) == background, F.lit(0)).otherwise(F.col(label)).cast("bigint"))


def drop_empty_sections(df: DataFrame, percent: float, mask: str = "mask") -> DataFrame:
    """C11: without int(percent / 100 * n) of a volume's n empty sections, the highest first."""
    empty = df.groupBy("volume_id", "z").agg(F.max(mask).alias("_m")).where("_m = 0")
    by = Window.partitionBy("volume_id")
    ranked = empty.withColumn("_r", F.row_number().over(by.orderBy(F.desc("z")))).withColumn("_n", F.count(F.lit(1)).over(by))
    return df.join(ranked.where(F.col("_r") <= F.floor(F.lit(percent) / 100 * F.col("_n"))).select("volume_id", "z"), ["volume_id", "z"], "left_anti")


def replace_sections(df: DataFrame, sections: list[int], value: str = "label") -> DataFrame:
    """Value 0 in the sections with these numbers."""
    return df.withColumn(value, F.when(F.col("z").isin(sections), F.lit(0)).otherwise(F.col(value)).cast(df.schema[value].dataType))


def check_sections(raw: DataFrame, labels: DataFrame) -> DataFrame:
    """C20: sections whose voxel counts differ between raw and labels, or that one of them lacks."""
    a, b = (d.groupBy("volume_id", "z").agg(F.count(F.lit(1)).alias(n)) for d, n in ((raw, "raw_voxels"), (labels, "label_voxels")))
    both = a.join(b, ["volume_id", "z"], "full_outer").na.fill(0, ["raw_voxels", "label_voxels"])
    return both.where("raw_voxels != label_voxels")


def min_sections(df: DataFrame) -> DataFrame:
    """The least number of sections that a volume has."""
    return df.groupBy("volume_id").agg(F.countDistinct("z").alias("n")).agg(F.min("n").alias("sections"))


def pair_sections(a: DataFrame, b: DataFrame, name: str = "name") -> DataFrame:
    """Two sorted listings side by side; the shorter one ends the pairing. Both are numbered by ranges of names."""
    number = lambda d, side: numbered(d.select(F.col(name).alias(f"{name}_{side}")), f"{name}_{side}").withColumnRenamed("_id", "pair")
    return number(a, "a").join(number(b, "b"), "pair")


def dataset_pairs(names: DataFrame, name: str = "dataset") -> DataFrame:
    """All ordered pairs of two different names; a listing of data sets is short."""
    a, b = (names.select(F.col(name).alias(n)).distinct() for n in ("source", "target"))
    return a.join(b, F.col("source") != F.col("target"))
