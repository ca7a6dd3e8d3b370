"""The folder that driver and executors share, and tables kept there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TASK_ROWS = 50_000


def shared_folder(spark: SparkSession) -> str:
    """The folder named by the session for checkpoints and written tables; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder that the executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="logweave-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows as a checkpoint in the shared folder, which Spark removes when nothing refers to them."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def spread(scan: DataFrame, *by: str, rows: int = TASK_ROWS) -> DataFrame:
    """The rows of a plain scan in tasks of at most about so many, and at least as many tasks as there are cores; dealt by columns, or in turn.

    How many splits a scan has tells nothing of its rows: of a file with one row group all but one split are empty. Nor
    do the bytes by which Spark joins small tasks tell how much work a row is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(max(cores, -(-scan.count() // rows)), *by)
