"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the jobs are written for.  Shuffle partition counts are left to the
# cluster: adaptive execution coalesces them, so a generous number is right.
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Lookups of up to this many ids reach the Parquet scan as they are.
    "spark.sql.parquet.pushdown.inFilterThreshold": "200",
    # Recording a call site per column operation doubles the time to build a plan.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(master: str, name: str = "semcat", **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(name)
    for key, value in {**RECOMMENDED, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate tables, below the cluster's shared folder.

    The shared folder is ``spark.checkpoint.dir``.  Only a local session, where
    driver and executors are one machine, may go without that setting.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="semcat-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, size: str = "8m") -> None:
    """Arrow batches of at most so many bytes, beside one row: very long texts else come by the thousand.

    A setting of the session's own stays.
    """
    if spark.conf.get(_BATCH_BYTES, None) is None:
        spark.conf.set(_BATCH_BYTES, size)


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: computed once, of known size."""
    folder = work_dir(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def scan_bytes(df: DataFrame) -> int:
    """Bytes of all tables that the frame reads."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out evenly when the scan gives fewer tasks than there are cores.

    For work that is heavy per row.  Files are split by bytes, so a table that fills
    the cores, of however few files, is left as it is: what is shuffled here
    never exceeds one scan task's bytes per core.
    """
    if df.isStreaming:
        return df
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    # The count only: the names of a million files would all come to Python.
    if 0 < len(df._jdf.inputFiles()) < cores:
        split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
        if scan_bytes(df) < cores * split:
            return df.repartition(cores)
    return df
