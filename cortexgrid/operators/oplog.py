"""Completion logs of blockwise jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def log_blocks(df: DataFrame, run_cols: Sequence[str]) -> DataFrame:
    """G1: finished blocks with run_id, the md5 of the configuration values put together."""
    return df.withColumn("run_id", F.md5(F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in run_cols))))


def pending_blocks(grid: DataFrame, log: DataFrame, overwrite: bool = False) -> DataFrame:
    """Blocks without a log row; all of them on overwrite."""
    return grid if overwrite else grid.join(log.select("block_id"), "block_id", "left_anti")


def pending_by_nodes(grid: DataFrame, nodes: DataFrame, begin: Sequence[float], block: Sequence[float], counts: Sequence[int]) -> DataFrame:
    """Blocks whose write box holds no node; a node's block is computed from its centre."""
    index = [F.floor((F.col(f"center_{a}") - b) / n) for a, b, n in zip("zyx", begin, block)]
    inside = F.lit(True)
    number = F.lit(0)
    for i, n in zip(index, counts):
        inside = inside & (i >= 0) & (i < n)
        number = number * n + i
    done = nodes.where(inside).select(number.cast("bigint").alias("block_id")).distinct()
    return grid.join(done, "block_id", "left_anti")


def progress(log: DataFrame, bucket: str = "1 hour") -> DataFrame:
    """Blocks and durations by worker and time bucket."""
    by = log.groupBy("worker", F.window("start", bucket).alias("w"))
    sums = by.agg(F.count(F.lit(1)).alias("blocks"), F.sum("duration").alias("total_duration"), F.avg("duration").alias("mean_duration"))
    return sums.select("worker", F.col("w.start").alias("bucket"), "blocks", "total_duration", "mean_duration")


class IncompleteError(RuntimeError):
    """Blocks are pending, so many."""

    def __init__(self, pending: int):
        super().__init__(f"{pending} blocks are pending")
        self.pending = pending


def assert_complete(grid: DataFrame, log: DataFrame) -> None:
    """An error if a block is pending."""
    if pending := pending_blocks(grid, log).count():
        raise IncompleteError(pending)
