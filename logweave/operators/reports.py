"""Reports over processed records, and what an explorer of them needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.functions.quantiles import exact_quantile
from logweave.sources.shared import cut

MODES = ("Cached", "Discovery", "Quarantined", "Error")
PAGE = 200


def mode_pivot(records: DataFrame) -> DataFrame:
    """Records per family and mode."""
    return records.groupBy("family").agg(*(F.count_if(F.col("mode") == m).alias(m.lower()) for m in MODES))


def family_summary(records: DataFrame, value: str = "latency_ms") -> DataFrame:
    """Lines, mean and median of a value, novelty rate and share of right guesses per family, to four places.

    The median is exact and no task holds a family's values.
    """
    rows = cut(records.select("family", value, "gate_novel", "gate_family"))  # read by every round of the median
    middle = exact_quantile(rows, F.col(value), 0.5, by=("family",)).select(F.col("family").alias("_family"), F.round("quantile", 4).alias("p50_ms"))
    means = rows.groupBy("family").agg(
        F.count("*").alias("lines"),
        F.round(F.avg(value), 4).alias("mean_ms"),
        F.round(F.avg(F.col("gate_novel").cast("double")), 4).alias("novel_rate"),
        F.round(F.avg((F.col("gate_family") == F.col("family")).cast("double")), 4).alias("fam_acc"),
    )
    return means.join(middle, F.col("family").eqNullSafe(F.col("_family")), "left").select("family", "lines", "mean_ms", "p50_ms", "novel_rate", "fam_acc")


def summary_with_modes(records: DataFrame) -> DataFrame:
    return family_summary(records).join(mode_pivot(records), "family", "left")


def mode_share(records: DataFrame) -> DataFrame:
    """Share of each mode in per cent, to two places."""
    n = records.groupBy("mode").agg(F.count("*").alias("n"))
    return n.select("mode", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2).alias("share"))


def share(hit: Column, copies: Column) -> Column:
    """The mean of a condition over rows that stand for copies records; null ones are left out, as in a mean."""
    return F.sum(F.when(hit, copies).when(~hit, 0)) / F.sum(F.when(hit.isNotNull(), copies))


def precision_recall(records: DataFrame, unknown: Column, copies: Column | None = None) -> DataFrame:
    """Recall on unknown families, precision, false-alarm rate; null where there is nothing to divide by. A row stands for copies records."""
    copies = F.lit(1) if copies is None else copies
    count_if = lambda c: F.coalesce(F.sum(F.when(c, copies)), F.lit(0))
    hit, known = F.col("gate_novel"), ~unknown
    tp, fp = count_if(hit & unknown), count_if(hit & known)
    return records.agg((tp / F.nullif(count_if(unknown), F.lit(0))).alias("recall"), (tp / F.nullif(tp + fp, F.lit(0))).alias("precision"), (fp / F.nullif(count_if(known), F.lit(0))).alias("false_alarm"))


def top_values(records: DataFrame, column: str, most: int = 5) -> DataFrame:
    """The most frequent values; of equal counts the first seen."""
    return records.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"), F.min("seq").alias("first_seq")).orderBy(F.desc("n"), "first_seq").limit(most)


def run_summary(records: DataFrame, most: int = 5) -> DataFrame:
    """Rows (kind, name, value): records in all and by mode, the most frequent formats and families (of equal counts the first seen), mean latency."""
    groups = cut(records.groupBy("mode", "format", "family").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.sum("latency_ms").alias("sum"), F.count("latency_ms").alias("values")))  # records are read once
    counted = lambda kind: groups.groupBy(F.lit(kind).alias("kind"), F.col(kind).alias("name")).agg(F.sum("n").cast("double").alias("value"), F.min("first_seq").alias("first_seq"))
    top = lambda kind: counted(kind).orderBy(F.desc("value"), "first_seq").limit(most)
    mean = F.sum("sum") / F.nullif(F.sum("values"), F.lit(0))
    whole = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("total"), F.coalesce(F.round(mean, 2), F.lit(0.0)).alias("avg_latency_ms"))
    whole = whole.select(F.stack(F.lit(2), F.lit("total"), F.col("total"), F.lit("avg_latency_ms"), F.col("avg_latency_ms")).alias("kind", "value")).select("kind", F.lit(None).cast("string").alias("name"), "value")
    rows = counted("mode").unionByName(top("format")).unionByName(top("family")).drop("first_seq")
    return rows.unionByName(whole)


def console(records: DataFrame) -> DataFrame:
    """Known, new and problematic records, and the share answered from rules."""
    n = F.count("*")
    known = F.count_if(F.col("mode") == "Cached")
    return records.agg(
        known.alias("known"), F.count_if(F.col("mode") == "Discovery").alias("fresh"), F.count_if(F.col("mode").isin("Error", "Quarantined")).alias("issues"),
        F.coalesce(F.round(100 * known / F.nullif(n, F.lit(0))), F.lit(0.0)).cast("long").alias("saved_pct"),
    )


def facets(records: DataFrame) -> DataFrame:
    """Non-zero counts per mode in fixed order."""
    place = F.array_position(F.array(*map(F.lit, MODES)), F.col("mode"))
    return records.groupBy("mode").agg(F.count("*").alias("n")).withColumn("place", place).orderBy("place")


def search(records: DataFrame, text: str, mode: str = "All") -> DataFrame:
    """Records whose JSON holds the text in any case, of one mode or all."""
    rows = records if mode == "All" else records.where(F.col("mode") == mode)
    return rows.where(F.lower(F.to_json(F.struct("*"))).contains(text.lower()))


def pages(records: DataFrame, shown: int = 1, size: int = PAGE) -> DataFrame:
    """The first pages in order of arrival."""
    return records.orderBy("seq").limit(shown * size)


def flat_fields(extracted: str = "extracted", extra: str = "extra") -> Column:
    """One map of both, extra first, without empty values and the raw message."""
    left = F.map_filter(extracted, lambda k, v: ~F.map_contains_key(F.col(extra), k))
    return F.map_filter(F.map_concat(left, F.col(extra)), lambda k, v: v.isNotNull() & (v != "") & (k != "raw_message"))


def loudness(severity: str = "severity") -> Column:
    return F.when(F.col(severity).isin("critical", "error"), "loud").when(F.col(severity) == "warning", "warm").otherwise("quiet")


def note() -> Column:
    """Why a record is held back, else what went wrong with discovery."""
    held = F.format_string("Held for review: seen %d of %d times", F.col("quarantine_count"), F.col("graduate_after"))
    return F.when(F.col("quarantine_count").isNotNull(), held).otherwise(F.col("llm_error"))
