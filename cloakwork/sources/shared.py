"""The folder jobs share for checkpoints and staged tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints, visible to every executor.

    Only a local session, where driver and executors are one process, may do
    without the setting; it gets a folder of its own.
    """
    named = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder all executors can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cloakwork-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make sure `DataFrame.checkpoint()` has somewhere to write."""
    folder = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_dir(spark: SparkSession, purpose: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """A freshly read table over all cores, when it has fewer splits than there are.

    Scanning text costs far more than moving it once, so one small file should
    not be scanned by one core.  A table with a split or more per core, as large
    ones have, is returned as it is and never shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


ROWS_PER_TASK = 50_000


def spread_rows(df: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """A freshly read table in tasks of about so many rows, and over all cores.

    For short rows that much work is done on: a split is a number of bytes, and of
    keys alone it holds millions.  Only the count is read beforehand.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = max(cores, -(-df.count() // rows_per_task))
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df
