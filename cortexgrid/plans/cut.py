"""Cutting lineage through tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of a batch of rows that goes to a Python worker; the JVM and the worker of each running task hold one each.
BATCH_BYTES = 8 << 20


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; in local mode, where it is unset, a folder of our own (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone: the folder's owner clears it
        pass


_registered: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the driver ends."""
    top = f"{scratch_root(spark)}/tables-{spark.sparkContext.applicationId}"
    if top not in _registered:
        _registered.add(top)
        atexit.register(_remove, spark, top)
    return f"{top}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    Unlike a cached plan this survives the loss of executors, and Catalyst knows the table's size, so a later join
    broadcasts it only while it is under spark.sql.autoBroadcastJoinThreshold and shuffles it beyond. Shuffle files of the
    write are removed once it has ended: Spark would keep them until its driver collects garbage, and no later plan reads them.
    Unless the session names a size, batches for Python workers have BATCH_BYTES, not Spark's 64 MB, so that executors stay small.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = {key: spark.conf.get(key, None) for key in (_CLEANUP, _BATCH)}
    spark.conf.set(_CLEANUP, "true")
    if before[_BATCH] is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables of materialize that nothing reads any more; what was made from them must be written itself."""
    for table in tables:
        _remove(table.sparkSession, table._cut_path)
