"""Counters that remember only the most recently seen keys, over all rows at once.

A table of counters with room for a number of keys drops the key seen least recently when another one comes; a key that
comes back begins anew. Fed row by row this is sequential. Here rows are cut into blocks by their order. What a block
needs of those before it is which keys are remembered where it begins: the capacity most recently seen. These lists
are combined in a logarithmic number of steps, as the list of two blocks is made of the lists of both. Each block is
then walked on its own, and counts that reach into earlier blocks are added up per key and block.
"""

from __future__ import annotations

import math
from collections import OrderedDict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.sources.shared import cut

BLOCK_ROWS = 200_000
STATE = "key string, last long, count long"


def _newest(lists: DataFrame, capacity: int) -> DataFrame:
    """Of each block's list (block, key, last) the capacity keys seen last."""
    one = lists.groupBy("block", "key").agg(F.max("last").alias("last"))
    return one.withColumn("nth", F.row_number().over(Window.partitionBy("block").orderBy(F.desc("last"), "key"))).where(F.col("nth") <= capacity).drop("nth")


def _walk(capacity: int):
    """Of each row of a block: its key's count since the block began or the key was last forgotten, and whether it was."""

    def run(rows: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        held = OrderedDict((k, [False, 0]) for k in before.sort_values("last")["key"])
        rows = rows.sort_values("seq")
        counts, anew = [], []
        for k in rows["key"]:
            x = held.get(k)
            if x is None:
                x = held[k] = [True, 0]
                if len(held) > capacity:
                    held.popitem(last=False)
            else:
                held.move_to_end(k)
            x[1] += 1
            anew.append(x[0])
            counts.append(x[1])
        return rows.assign(local=counts, anew=anew)[["block", "seq", "key", "local", "anew"]]

    return run


def _key(keys: list[str]):
    return F.md5(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))


def recency_counts(rows: DataFrame, keys: list[str], capacity: int, name: str = "count", seq: str = "seq", start: DataFrame | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(seq, key, name): how often each row's key was seen up to it, since it was last forgotten.

    seq orders the rows and is unique. start has what earlier rows left (key, last, count), at most capacity keys with
    last below all seq here. A null in keys is a value like any other.
    """
    base = cut(rows.select(F.col(seq).cast("long").alias("seq"), _key(keys).alias("key")))
    n = max(1, math.ceil(base.count() / block_rows))
    blocks = cut(base.repartitionByRange(n, "seq").withColumn("block", F.spark_partition_id()))  # written once, so the blocks stand
    lists = _newest(blocks.select("block", "key", F.col("seq").alias("last")), capacity)
    if start is not None:
        lists = lists.unionByName(start.select(F.lit(-1).alias("block"), "key", "last"))
    lists = cut(lists)
    step = 1
    while step <= n:  # after it, each list is that of all blocks up to its own
        lists = cut(_newest(lists.unionByName(lists.withColumn("block", F.col("block") + step).where(F.col("block") < n)), capacity))
        step *= 2
    before = lists.select((F.col("block") + 1).alias("block"), "key", "last").where(F.col("block") < n)
    # An empty block in between has no list of its own but that of those before.
    walked = blocks.groupBy("block").cogroup(before.groupBy("block")).applyInPandas(_walk(capacity), "block int, seq long, key string, local long, anew boolean")
    walked = cut(walked)
    ends = walked.groupBy("key", "block").agg(F.max_by("local", "seq").alias("n"), F.max("anew").alias("anew"))
    if start is not None:
        ends = ends.unionByName(start.select("key", F.lit(-1).alias("block"), F.col("count").alias("n"), F.lit(True).alias("anew")))
    by_key = Window.partitionBy("key").orderBy("block")
    ends = ends.withColumn("life", F.sum(F.col("anew").cast("int")).over(by_key)).withColumn("total", F.sum("n").over(Window.partitionBy("key", "life").orderBy("block")))
    ends = ends.select("key", "block", F.lag("total").over(by_key).alias("before"))
    count = F.col("local") + F.when(F.col("anew"), 0).otherwise(F.coalesce("before", F.lit(0)))
    return walked.join(ends, ["key", "block"]).select("seq", "key", count.alias(name))


def left_over(counted: DataFrame, capacity: int, name: str = "count", start: DataFrame | None = None) -> DataFrame:
    """(key, last, count) that counted rows leave to those that follow: the capacity keys seen last."""
    last = counted.groupBy("key").agg(F.max("seq").alias("last"), F.max_by(name, "seq").alias("count"))
    if start is not None:
        last = last.unionByName(start.select("key", "last", "count").join(last.select("key"), "key", "left_anti"))
    return last.orderBy(F.desc("last"), "key").limit(capacity)


def with_recency(rows: DataFrame, keys: list[str], capacity: int, name: str, seq: str = "seq", **options) -> DataFrame:
    """The rows with recency_counts() as a column."""
    got = recency_counts(rows, keys, capacity, name, seq, **options).select(F.col("seq").alias("_seq"), name)
    return rows.join(got, F.col(seq) == F.col("_seq")).drop("_seq")
