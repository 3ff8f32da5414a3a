"""G4 with state: each block of a grid is pending, overdue or finished while the completion log grows.

State is one row for each run of SPAN neighbouring block numbers, kept by Spark's state store beside the checkpoint: the
blocks of a run that have come, each with its flags, deadline and duration. A call of the processor takes all of a run's rows
at once, so that the store is asked once a run, not once a block; block numbers further apart than SPAN have a row each. A
deadline is a timer of the run. A first entry counts whenever it comes, since no watermark drops it, and repeats change
nothing. A restart goes on from the checkpoint.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STATES = "block_id long, status string, overdue boolean, duration double"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Block numbers of a row of state, 2^SPAN_BITS; a row has 25 bytes for each that has come.
SPAN_BITS = 10
#: Flags of a block: planned, finished, overdue (stays), and whether its entry has a duration.
PLANNED, FINISHED, OVERDUE, TIMED = 1, 2, 4, 8
_BLOCK = np.dtype([("block_id", "<i8"), ("flags", "u1"), ("deadline", "<i8"), ("duration", "<f8")])


class BlockStates(StatefulProcessor):
    """Rows of a run of blocks are planned ones, which start a block's deadline, and entries of the log."""

    def __init__(self, deadline_ms: int):
        self.deadline_ms = deadline_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("blocks", "blocks binary")

    def _blocks(self) -> np.ndarray:
        """The run's blocks, by number."""
        return np.frombuffer(self.state.get()[0], _BLOCK).copy() if self.state.exists() else np.zeros(0, _BLOCK)

    @staticmethod
    def _changes(blocks: np.ndarray) -> pd.DataFrame:
        flags = blocks["flags"]
        status = np.select([flags & FINISHED > 0, flags & OVERDUE > 0], ["finished", "overdue"], "pending")
        return pd.DataFrame({"block_id": blocks["block_id"], "status": status.astype(object), "overdue": flags & OVERDUE > 0, "timed": flags & TIMED > 0, "duration": blocks["duration"]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        given = None
        for part in rows:  # of repeats the first counts
            given = (part if given is None else pd.concat([given, part])).drop_duplicates(["block_id", "planned"])
        old, plan = self._blocks(), given["planned"].to_numpy(bool)
        ids = given["block_id"].to_numpy(np.int64)
        blocks = np.zeros(len(number := np.union1d(old["block_id"], ids)), _BLOCK)
        blocks["block_id"] = number
        blocks[np.searchsorted(number, old["block_id"])] = old
        flags, before = blocks["flags"], blocks["flags"].copy()
        at, entry = np.searchsorted(number, ids), given[~plan]
        flags[at[plan]] |= PLANNED
        first = before[at[~plan]] & FINISHED == 0
        done = at[~plan][first]
        flags[done] |= FINISHED
        flags[done] |= np.where(entry["timed"].to_numpy(bool)[first], TIMED, 0).astype(np.uint8)
        blocks["duration"][done] = entry["duration"].to_numpy(np.float64)[first]
        new = flags & ~before
        waits = (new & PLANNED > 0) & (flags & FINISHED == 0)
        if waits.any():
            deadline = timerValues.getCurrentProcessingTimeInMs() + self.deadline_ms
            blocks["deadline"][waits] = deadline
            self.handle.registerTimer(deadline)
        self.state.update((blocks.tobytes(),))
        # a block that nobody planned waits for its plan
        changed = (flags & PLANNED > 0) & (new & (PLANNED | FINISHED) > 0)
        if changed.any():
            yield self._changes(blocks[changed])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        blocks = self._blocks()
        late = (blocks["flags"] & (PLANNED | FINISHED | OVERDUE) == PLANNED) & (blocks["deadline"] <= expiredTimerInfo.getExpiryTimeInMs())
        if late.any():
            blocks["flags"][late] |= OVERDUE
            self.state.update((blocks.tobytes(),))
            yield self._changes(blocks[late])

    def close(self) -> None:
        pass


def block_states(planned: DataFrame, log: DataFrame, deadline_ms: int) -> DataFrame:
    """(block_id, status, overdue, duration), a row for each change: planned blocks start as pending.

    planned (block_id) and log (block_id, duration) are streams. A block without an entry deadline_ms after its plan was
    read is overdue; overdue stays true for one that is finished later. Blocks that aren't planned give no rows.
    """
    planned.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    duration = F.col("duration").cast("double")
    both = planned.select("block_id", F.lit(True).alias("planned"), F.lit(False).alias("timed"), F.lit(0.0).alias("duration")).unionByName(
        log.select("block_id", F.lit(False).alias("planned"), duration.isNotNull().alias("timed"), F.coalesce(duration, F.lit(0.0)).alias("duration"))
    )
    runs = both.where("block_id is not null").select(F.shiftright("block_id", SPAN_BITS).alias("run"), "block_id", "planned", "timed", "duration").groupBy("run")
    changes = runs.transformWithStateInPandas(BlockStates(deadline_ms), "block_id long, status string, overdue boolean, timed boolean, duration double", "update", "ProcessingTime")
    # pandas gives a duration that is not a number as null
    return changes.select("block_id", "status", "overdue", F.when(F.col("timed"), F.coalesce("duration", F.lit(float("nan")))).alias("duration"))


def states_stream(planned: DataFrame, log: DataFrame, out: str, checkpoint: str, deadline_ms: int, every: str = "10 seconds") -> StreamingQuery:
    """Writes changes to out, a folder for each batch; a batch that is run again after a failure replaces its own.

    The query looks for entries and deadlines every so often until it is stopped; started again, it goes on from checkpoint.
    """

    def take(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    changes = block_states(planned, log, deadline_ms)
    return changes.writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def wait_idle(query: StreamingQuery) -> None:
    """Until a batch without new rows has ended; with timers, batches go on without end, so processAllAvailable never returns."""
    while query.isActive:
        last = query.lastProgress
        if last is not None and last["batchId"] > 0 and last["numInputRows"] == 0:
            return
        time.sleep(0.2)
    if query.exception() is not None:
        raise query.exception()


def current_states(spark: SparkSession, out: str) -> DataFrame:
    """The latest of each block's changes: a block goes from pending to overdue to finished and never back."""
    rank = F.when(F.col("status") == "finished", 2).when(F.col("status") == "overdue", 1).otherwise(0)
    changes = spark.read.schema(STATES).parquet(out).withColumn("rank", rank)
    last = changes.groupBy("block_id").agg(F.max_by(F.struct("status", "overdue", "duration"), "rank").alias("s"))
    return last.select("block_id", "s.*")
