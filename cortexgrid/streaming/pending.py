"""Pending blocks from a growing completion log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

LOG_SCHEMA = "block_id long, start timestamp, duration double, worker long"


def log_stream(spark: SparkSession, path: str, schema: str = LOG_SCHEMA) -> DataFrame:
    """The log's parquet files as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def first_entries(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first row of each block; repeats within the watermark are dropped.

    Rows older than the watermark are ignored, first ones too: a block whose only row comes so late stays pending in the
    stream, and pending_blocks over the whole log finds it finished.
    """
    return log.withWatermark("start", late).dropDuplicatesWithinWatermark(["block_id"])


def pending_stream(grid: DataFrame, log: DataFrame, out: str, checkpoint: str, late: str = "1 hour") -> StreamingQuery:
    """Writes newly finished blocks of grid to out (append-only, one batch each); grid minus out is what is pending.

    A batch that is run again after a failure replaces its own folder.
    """

    def take(batch: DataFrame, number: int) -> None:
        batch.join(grid.select("block_id"), "block_id", "left_semi").select("block_id").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return first_entries(log, late).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pending_after(spark: SparkSession, grid: DataFrame, out: str) -> DataFrame:
    """Blocks that no batch has finished."""
    return grid.join(spark.read.parquet(out).select("block_id"), "block_id", "left_anti")
