"""Masking, template mining and the quarantine of novel formats."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.functions.text import clip, mask_line
from logweave.operators.recency import with_recency
from logweave.sources.shared import cut

SIMILARITY, DEPTH = 0.5, 2
GRADUATE_AFTER, GRADUATE_REPEATS = 8, 5
#: Templates and lines that the quarantine's counters remember.
MOST_TEMPLATES, MOST_LINES = 500, 2000
SHOWN = 300
WILD = "<*>"


def mask_groups(lines: DataFrame, line: str = "line") -> DataFrame:
    """Templates by masking alone: rows (template, size)."""
    return lines.select(mask_line(F.col(line)).alias("template")).groupBy("template").agg(F.count("*").alias("size"))


class Leaf:
    """The clusters of one leaf of Drain's tree (He et al., ICWS 2017), fed with masked lines in order of arrival.

    A line joins the cluster with the most equal tokens, the oldest of several, if at least the share similarity of its
    tokens is equal, and turns the others into wildcards; else it founds one. Clusters are found by an index of their
    tokens by place, so a line is compared with those that share a token with it. A line that was fed before stays
    where it is.
    """

    def __init__(self, similarity: float = SIMILARITY):
        self.similarity = similarity
        self.tokens: list[list[str]] = []
        self.lines: dict[str, int] = {}
        self._at: dict[tuple[int, str], set[int]] = {}

    def restore(self, template: str) -> None:
        """Adds a cluster that was known before, after those restored already."""
        self._index(len(self.tokens), enumerate(template.split()))
        self.tokens.append(template.split())

    def _index(self, cluster: int, placed) -> None:
        for place in placed:
            self._at.setdefault(place, set()).add(cluster)

    def add(self, line: str) -> int:
        """The place of the line's cluster."""
        if line in self.lines:
            return self.lines[line]
        tokens = line.split()
        shared = Counter(c for place in enumerate(tokens) for c in self._at.get(place, ()))
        best = min(shared, key=lambda c: (-shared[c], c), default=None)
        if best is None or shared[best] / max(1, len(tokens)) < self.similarity:
            best = len(self.tokens)
            self.tokens.append(tokens)
            self._index(best, enumerate(tokens))
        else:
            for i, (a, b) in enumerate(zip(self.tokens[best], tokens)):
                if a != b:
                    self._at[i, a].discard(best)
                    self._index(best, [(i, WILD)])
                    self.tokens[best][i] = WILD
        self.lines[line] = best
        return best

    def template(self, cluster: int) -> str:
        return " ".join(self.tokens[cluster])


def with_leaf(lines: DataFrame, masked: str = "masked") -> DataFrame:
    """Adds n_tokens and leaf, the path to a leaf of the tree: the number of tokens and the first DEPTH, those with digits as wildcards."""
    words = F.filter(F.split(masked, r"\s+"), lambda w: w != "")
    path = F.transform(F.slice(words, 1, DEPTH), lambda w: F.when(w.rlike(r"\d"), WILD).otherwise(w))
    return lines.withColumn("n_tokens", F.size(words)).withColumn("leaf", F.array_join(path, " "))


MINED = "masked string, template string, cluster_id long, first_seq long, size long"


def mine(records: DataFrame, line: str = "raw", seq: str = "seq", similarity: float = SIMILARITY) -> DataFrame:
    """Rows (masked, template, cluster_id, first_seq, size): Drain's clusters of the distinct masked lines, in order of arrival.

    A cluster's id is the seq of the line that founded it, so ids stand when more lines come. Leaves are independent,
    each a group of its own. Masked lines are first pre-aggregated, so a task sees each different one once.
    """
    masked = records.select(mask_line(F.col(line)).alias("masked"), F.col(seq).cast("long").alias("seq")).where("masked is not null").groupBy("masked").agg(F.min("seq").alias("first_seq"), F.count("*").alias("size"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("first_seq")
        tree, ids = Leaf(similarity), []
        homes = [tree.add(m) for m in pdf["masked"]]
        for home, first in zip(homes, pdf["first_seq"]):
            if home == len(ids):
                ids.append(first)
        return pdf[["masked", "first_seq", "size"]].assign(template=[tree.template(h) for h in homes], cluster_id=[ids[h] for h in homes])[["masked", "template", "cluster_id", "first_seq", "size"]]

    return with_leaf(masked).groupBy("n_tokens", "leaf").applyInPandas(run, MINED)


def with_clusters(records: DataFrame, mined: DataFrame, line: str = "raw") -> DataFrame:
    """Adds cluster_id and template to records by their masked line."""
    found = mined.select("masked", "cluster_id", "template")
    return records.withColumn("masked", mask_line(F.col(line))).join(found, "masked", "left").drop("masked")


def template_view(mined: DataFrame, most: int = 100, ruled: DataFrame | None = None) -> DataFrame:
    """The largest clusters with their number of records, and has_rule: whether ruled (cluster_id) holds them."""
    one = mined.groupBy("cluster_id").agg(F.max_by("template", "first_seq").alias("template"), F.sum("size").alias("size"), F.min("first_seq").alias("first_seq"))
    if ruled is None:
        one = one.withColumn("has_rule", F.lit(False))
    else:
        one = one.join(ruled.select("cluster_id").distinct().withColumn("has_rule", F.lit(True)), "cluster_id", "left").withColumn("has_rule", F.coalesce("has_rule", F.lit(False)))
    return one.orderBy(F.desc("size"), "first_seq").limit(most)


def mining_stats(mined: DataFrame, ruled: DataFrame | None = None) -> DataFrame:
    """One row: clusters, records mined, and how many clusters have a rule."""
    rows = mined.select("cluster_id", "size")
    if ruled is None:
        return rows.agg(F.count_distinct("cluster_id").alias("clusters"), F.coalesce(F.sum("size"), F.lit(0)).alias("mined"), F.lit(0).cast("long").alias("rules_learned"))
    known = ruled.select("cluster_id").distinct().withColumn("_known", F.lit(True))
    return rows.join(known, "cluster_id", "left").agg(
        F.count_distinct("cluster_id").alias("clusters"), F.coalesce(F.sum("size"), F.lit(0)).alias("mined"), F.count_distinct(F.when(F.col("_known"), F.col("cluster_id"))).alias("rules_learned")
    )


def quarantine(novel: DataFrame, graduate_after: int = GRADUATE_AFTER, graduate_repeats: int = GRADUATE_REPEATS, templates: int = MOST_TEMPLATES, lines: int = MOST_LINES, template: str = "template") -> DataFrame:
    """Adds count, occurrences and kind to novel records (seq, template, raw, family_guess) in order.

    Counters remember the templates and lines seen last, at most so many of either; what was forgotten begins anew.
    A record is quarantined until its template was seen graduate_after times or its line graduate_repeats times; the
    latter escalates; the first record of a template over the former is discovered and graduates it, later ones are
    discovered.
    """
    novel = cut(novel)
    rows = with_recency(with_recency(novel, [template], templates, "count"), ["raw", "family_guess"], lines, "occurrences")
    able = (F.col("count") >= graduate_after) & (F.col("occurrences") < graduate_repeats)
    kind = F.when(F.col("occurrences") >= graduate_repeats, "escalated").when(F.col("count") < graduate_after, "quarantined").otherwise("discover")
    rows = rows.withColumn("kind", kind)
    first = rows.where(able).groupBy(F.col(template).alias("_t")).agg(F.min("seq").alias("_first"))
    return rows.join(first, F.col(template) == F.col("_t"), "left").withColumn("graduates", F.coalesce(F.col("seq") == F.col("_first"), F.lit(False))).drop("_t", "_first")


def quarantine_view(novel: DataFrame, most: int = 100) -> DataFrame:
    """Per template: count, first and last record, and its first three different samples."""
    once = novel.groupBy("template", clip(F.col("raw"), SHOWN).alias("sample")).agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"))
    nth = F.row_number().over(Window.partitionBy("template").orderBy("first"))
    rows = once.withColumn("nth", nth).groupBy("template").agg(
        F.sum("n").alias("count"), F.min("first").alias("first_seq"), F.max("last").alias("last_seq"), F.array_sort(F.collect_list(F.when(F.col("nth") <= 3, F.struct("nth", "sample")))).alias("s")
    )
    return rows.select("template", "count", "first_seq", "last_seq", F.col("s.sample").alias("samples")).orderBy(F.desc("count"), "first_seq").limit(most)
