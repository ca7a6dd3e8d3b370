"""Drain over a stream: every leaf of its tree is keyed state, so clusters and their ids stand from batch to batch.

State is kept by Spark's state store (RocksDB, which transformWithState asks for); a view of it can be read while the
stream stands or runs, by the state store's own data source.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from logweave.functions.text import mask_line
from logweave.operators.mining import SIMILARITY, Leaf, with_leaf

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CLUSTER = "id long, template string, size long, first_seq long, last_seq long"
ASSIGNED = "masked string, seq long, n long, cluster_id long, template string"


class LeafProcessor(StatefulProcessor):
    """One leaf: its clusters by number, and the cluster of each masked line seen. Lines are forgotten days after they came, if days is given."""

    def __init__(self, similarity: float = SIMILARITY, days: int | None = None):
        self.similarity, self.days = similarity, days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clusters = handle.getMapState("clusters", "number int", CLUSTER)
        self.lines = handle.getMapState("lines", "masked string", "number int", *([self.days * 86_400_000] if self.days else []))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        lines = batch.groupby("masked").agg(seq=("seq", "min"), last=("seq", "max"), n=("seq", "size")).reset_index().sort_values("seq")
        held = dict(sorted((k[0], v) for k, v in self.clusters.iterator()))
        tree = Leaf(self.similarity)
        for v in held.values():
            tree.restore(v[1])
        before = len(held)
        homes = []
        for line in lines["masked"]:
            if self.lines.containsKey((line,)):
                tree.lines[line] = self.lines.getValue((line,))[0]
            else:
                self.lines.updateValue((line,), (tree.add(line),))
            homes.append(tree.lines[line])
        lines = lines.assign(home=homes)
        ids = {i: v[0] for i, v in held.items()}
        for home, part in lines.groupby("home"):
            first = int(part["seq"].iloc[0])
            old = held.get(home, (first, "", 0, first, first))
            ids[home] = old[0]
            self.clusters.updateValue((home,), (old[0], tree.template(home), old[2] + int(part["n"].sum()), old[3], max(old[4], int(part["last"].max()))))
        assert len(tree.tokens) >= before
        yield pd.DataFrame({"masked": lines["masked"], "seq": lines["seq"], "n": lines["n"], "cluster_id": [ids[h] for h in homes], "template": [tree.template(h) for h in homes]})

    def close(self) -> None:
        pass


def clusters_of(stream: DataFrame, similarity: float = SIMILARITY, days: int | None = None) -> DataFrame:
    """Of every batch's different masked lines of a stream (seq, raw): first seq, number, cluster and its template so far.

    Equal to one pass over all lines in order of seq within each batch, where a line that came before stays in its
    cluster. A cluster's id is the seq of the line that founded it.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = with_leaf(stream.select(mask_line(F.col("raw")).alias("masked"), F.col("seq").cast("long").alias("seq")).where("masked is not null"))
    return rows.groupBy("n_tokens", "leaf").transformWithStateInPandas(LeafProcessor(similarity, days), ASSIGNED, "update", "processingTime" if days else "none")


def cluster_view(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(cluster_id, template, size, first_seq, last_seq) of the state of a stream's last batch, as it stands."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "clusters").load()
    return rows.select(F.col("user_map_value.id").alias("cluster_id"), *(F.col(f"user_map_value.{c}").alias(c) for c in ("template", "size", "first_seq", "last_seq")))
