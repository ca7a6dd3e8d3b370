"""Sharding by fixed virtual slots.

A record's key is hashed into one of n_slots slots; a versioned map, kept as a table, gives every slot a shard. Growing
or rebalancing reads a version and writes the next, edited one, so only the records of the moved slots change place.
Rebalancing rests on the bytes per slot, aggregated over all records. The map has one row per slot and version and is
bounded by n_slots, so it may pass through the driver and be broadcast; records never do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.llm.graph import cut, fresh_path

N_SLOTS = 4096
PARTS = 64  # tasks over which the rows of one virtual slot may be spread


def virtual_slot(key: str, n_slots: int = N_SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_slots)).cast("int")


def grow(slots: list[int], new_shard: int) -> list[int]:
    """The next version with one more shard: it takes an equal share of slots from each present one, nothing else moves."""
    out, old = list(slots), sorted(set(slots))
    share = len(slots) // (len(old) + 1)
    held = {s: [i for i, x in enumerate(slots) if x == s] for s in old}
    for k in range(share):
        give = max(old, key=lambda s: (len(held[s]), -s))
        out[held[give].pop()] = new_shard
    return out


def first_map(n_shards: int, n_slots: int = N_SLOTS) -> list[int]:
    """The map of n_shards shards: one shard, grown n_shards - 1 times; so a map of one more shard is this one grown."""
    slots = [0] * n_slots
    for new_shard in range(1, n_shards):
        slots = grow(slots, new_shard)
    return slots


def rebalance(slots: list[int], slot_bytes: dict[int, int], tolerance: float = 0.02) -> list[int]:
    """The next version, in which slots have moved from the fullest to the emptiest shard until the fullest is within
    tolerance of the mean or no single move helps. slot_bytes has one value per slot at most."""
    out = list(slots)
    load = {s: 0 for s in sorted(set(slots))}
    for i, s in enumerate(out):
        load[s] += slot_bytes.get(i, 0)
    mean = sum(load.values()) / len(load)
    for _ in range(len(slots)):
        hi, lo = max(load, key=load.get), min(load, key=load.get)
        gap = load[hi] - load[lo]
        if load[hi] <= mean * (1 + tolerance):
            break
        moves = [(abs(gap - 2 * slot_bytes.get(i, 0)), i) for i, s in enumerate(out) if s == hi and 0 < slot_bytes.get(i, 0) < gap]
        if not moves:
            break
        i = min(moves)[1]
        out[i] = lo
        load[hi] -= slot_bytes[i]
        load[lo] += slot_bytes[i]
    return out


def write_map(spark: SparkSession, path: str, version: int, slots: list[int]) -> None:
    """Adds a version to the map's table; a version already there is never changed."""
    frame = spark.createDataFrame(list(enumerate(slots)), "vslot int, shard int").coalesce(1)
    frame.write.mode("errorifexists").parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int | None = None) -> list[int]:
    """The slots' shards of a version, the newest by default."""
    rows = spark.read.option("basePath", path).parquet(path).select("vslot", "shard", F.col("version").cast("int").alias("version"))
    if version is None:
        version = rows.agg(F.max("version")).first()[0]
    return [r["shard"] for r in rows.where(F.col("version") == version).orderBy("vslot").collect()]


def slot_bytes(records: DataFrame, size: str = "size") -> DataFrame:
    """Bytes and rows per virtual slot; at most n_slots rows, pre-aggregated before the shuffle."""
    return records.groupBy("vslot").agg(F.sum(size).alias("bytes"), F.count("*").alias("rows"))


def assign(docs: DataFrame, n_shards: int = 16, n_slots: int = N_SLOTS, map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot, vslot_bytes, rebalanced_shard of every document, by the law "key".

    Three versions of the map are written under map_path (a new folder in the shared one by default) and read back:
    1 is that of n_shards shards, 2 adds a shard to 1 and so is that of n_shards + 1, 3 rebalances 1 by the bytes per slot. By the law,
    doc_id and the shard count alone decide shard (version 1) and grown_shard (version 2); rebalanced_shard is where
    the measured bytes would move the record. slot counts the records of a shard from 0 without gaps; its order
    within a virtual slot depends on how the input is partitioned, as a slot of very many rows (one key that repeats)
    is dealt into PARTS parts by that. size is UTF-8 bytes plus 1; a null text has no bytes and the checksum of an
    empty one. A null doc_id is a key like any other. Repeated rows each get a place of their own. An empty table
    gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), virtual_slot("doc_id", n_slots).alias("vslot")
    )
    part = F.pmod(F.xxhash64("text_crc32", "size", F.spark_partition_id()), F.lit(PARTS)).cast("int")
    rows = cut(rows.withColumn("part", part))  # texts are read once; what is kept has no text
    per_slot = {r["vslot"]: r["bytes"] for r in slot_bytes(rows).collect()}  # at most n_slots rows
    path = map_path or fresh_path(spark, "slot-map")
    write_map(spark, path, 1, first_map(n_shards, n_slots))
    write_map(spark, path, 2, grow(read_map(spark, path, 1), n_shards))
    write_map(spark, path, 3, rebalance(read_map(spark, path, 1), per_slot))
    versions = zip(*(read_map(spark, path, v) for v in (1, 2, 3)))
    maps = spark.createDataFrame([(v, *shards, per_slot.get(v, 0)) for v, shards in enumerate(versions)], "vslot int, shard int, grown_shard int, rebalanced_shard int, vslot_bytes long")
    # Places: rows of the shard before a part of a slot (at most n_slots * PARTS sums), then rows before it within the part.
    w = Window.partitionBy("shard").orderBy("vslot", "part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("vslot", "part").agg(F.count("*").alias("n")).join(F.broadcast(maps.select("vslot", "shard")), "vslot")
    before = counts.select("vslot", "part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    inside = Window.partitionBy("vslot", "part").orderBy(F.col("doc_id").asc_nulls_last(), "text_crc32", "size")
    return (
        rows.withColumn("place", F.row_number().over(inside) - 1)
        .join(F.broadcast(maps), "vslot")
        .join(before, ["vslot", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("place")).cast("long").alias("slot"), "grown_shard", "vslot", "vslot_bytes", "rebalanced_shard")
    )
