"""Connected components of a distributed edge list."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


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


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a written table that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the actions inside go as soon as each action ends, not when the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """The rows as a checkpoint in the shared folder; what made them is freed."""
    shared_folder(df.sparkSession)
    with freeing_shuffles(df.sparkSession):
        return df.select("*").checkpoint()  # a new frame takes the setting


def _lowest_of_larger(e: DataFrame) -> DataFrame:
    """Large-star: every neighbour above a node is hung under the node's smallest neighbour."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _lowest_of_smaller(e: DataFrame) -> DataFrame:
    """Small-star: a node and its smaller neighbours are hung under the smallest of them."""
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 40) -> DataFrame:
    """Rows (node, root) for every node with an edge; root is the smallest node it can reach.

    Alternates large-star and small-star rounds (Kiveris et al., SoCC 2014) until the edge list is stable;
    the number of rounds grows with the logarithm of a component's size. A node with very many neighbours is
    only ever aggregated by min or joined on its own id, which adaptive execution may split. Self loops and
    null ends are ignored; no edges give no rows.
    """
    ends = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    e = cut(ends.where("u <> v").distinct())

    def state(x: DataFrame):
        return x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = state(e)
    for _ in range(max_rounds):
        e = cut(_lowest_of_smaller(_lowest_of_larger(e)))
        after = state(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
