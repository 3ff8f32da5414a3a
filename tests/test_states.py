"""G4 with state: deadlines, late and repeated entries, restarts."""

import math
import os
import time

import pytest
from pyspark.sql import functions as F

from cortexgrid.streaming.states import SPAN_BITS, current_states, states_stream, wait_idle

LOG = "block_id long, duration double"


@pytest.fixture
def folders(tmp_path):
    return {name: str(tmp_path / name) for name in ("grid", "log", "out", "checkpoint")}


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folders, deadline_ms, until):
    """The states once until holds for them; the query is stopped then."""
    grid = spark.readStream.schema("block_id long").parquet(folders["grid"])
    log = spark.readStream.schema(LOG).parquet(folders["log"])
    query, states = states_stream(grid, log, folders["out"], folders["checkpoint"], deadline_ms, "1 second"), {}
    try:
        end = time.time() + 100
        while time.time() < end and query.exception() is None and not (states and until(states)):
            time.sleep(0.5)
            if os.path.isdir(folders["out"]):
                states = {r.block_id: (r.status, r.overdue, r.duration) for r in current_states(spark, folders["out"]).collect()}
        assert query.exception() is None
    finally:
        query.stop()
    return states


def test_blocks_go_pending_overdue_finished(spark, folders):
    put(spark, folders["grid"], [(i,) for i in range(5)], "block_id long")
    put(spark, folders["log"], [(0, 1.5), (0, 9.0), (7, 3.0)], LOG)  # a repeat, and a block that isn't planned yet
    states = run(spark, folders, 20_000, lambda s: len(s) == 5)
    assert {i: s[0] for i, s in states.items()} == {0: "finished", 1: "pending", 2: "pending", 3: "pending", 4: "pending"} and states[0][2] in (1.5, 9.0)
    # restarted from the checkpoint: deadlines go on, 0 comes again, 7 is planned now
    put(spark, folders["log"], [(0, 8.0), (1, 2.5)], LOG)
    put(spark, folders["grid"], [(7,)], "block_id long")
    again = run(spark, folders, 20_000, lambda s: 7 in s and all(s[i][0] == "overdue" for i in (2, 3, 4)))
    assert again[0] == states[0] and again[7] == ("finished", False, 3.0) and again[1][0] == "finished" and again[1][2] == 2.5
    assert {i: again[i] for i in (2, 3, 4)} == {i: ("overdue", True, None) for i in (2, 3, 4)}
    # a first entry that comes late is taken
    put(spark, folders["log"], [(2, 4.5)], LOG)
    last = run(spark, folders, 20_000, lambda s: s[2][0] == "finished")
    assert last[2] == ("finished", True, 4.5) and last[3] == ("overdue", True, None)


def test_state_is_kept_by_runs_of_blocks(spark, folders):
    """The store has a row for each run of numbers, not for each block, and every block its own state."""
    n, far = 40_000, [-3, 10**15, -(2**63), 2**63 - 1]
    numbers = spark.range(n).unionByName(spark.createDataFrame([(i,) for i in far], "id long")).select(F.col("id").alias("block_id"))
    numbers.write.parquet(folders["grid"])
    odd = [(10**15, None), (-3, math.nan), (None, 1.0), (n + 5, 2.0)]
    entries = spark.range(0, n, 3).select(F.col("id").alias("block_id"), (F.col("id") / 2).alias("duration")).unionByName(spark.createDataFrame(odd, LOG))
    entries.unionByName(entries).write.parquet(folders["log"])
    grid, log = spark.readStream.schema("block_id long").parquet(folders["grid"]), spark.readStream.schema(LOG).parquet(folders["log"])
    query = states_stream(grid, log, folders["out"], folders["checkpoint"], 86_400_000, "1 second")
    try:
        wait_idle(query)
        rows = max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"])
    finally:
        query.stop()
    got = {r.block_id: (r.status, r.overdue, r.duration) for r in current_states(spark, folders["out"]).collect()}
    assert math.isnan(got.pop(-3)[2]) and got.pop(10**15) == ("finished", False, None)
    want = {i: ("pending", False, None) if i % 3 else ("finished", False, i / 2) for i in range(n)}
    assert got == want | {i: ("pending", False, None) for i in far[2:]}
    assert rows <= 4 * ((n >> SPAN_BITS) + 1 + len(far))
