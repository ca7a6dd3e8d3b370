"""First-rule-wins state and the cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.functions import fixed
from logweave.functions.text import clean, settled
from logweave.operators import detect
from logweave.operators.normalize import normalize
from logweave.operators.parse import parse

MOST_FINGERPRINTS = 500


def with_family(records: DataFrame, now: Column, raw: str = "raw") -> DataFrame:
    return records.withColumn("_c", clean(F.col(raw))).withColumn("family", detect.family(F.col("_c"), now)).drop("_c")


def with_rule(records: DataFrame, now: Column, raw: str = "raw") -> DataFrame:
    """Adds fingerprint and the rule each record would give by itself."""
    rows = records.withColumn("_c", clean(F.col(raw)))
    rows = rows.withColumn("fingerprint", detect.fingerprint(F.col("_c"), F.col("family"), now)).drop("_c")
    return rows.withColumn("own_rule", detect.heuristic_rule(F.col(raw), F.col("fingerprint")))


def family_rules(records: DataFrame, now: Column, seq: str = "seq", raw: str = "raw") -> DataFrame:
    """One rule per family, that of its first record; at most one row for each of the 17 families."""
    first = records.groupBy("family").agg(F.min_by(raw, seq).alias(raw), F.min(seq).alias("first_seq"))
    return with_rule(first, now, raw).select("family", "first_seq", F.col("own_rule").alias("rule"))


def apply_rules(records: DataFrame, rules: DataFrame, seq: str = "seq") -> DataFrame:
    """Adds rule and mode; the rule table has at most 17 rows and is broadcast."""
    return records.join(F.broadcast(rules), "family").withColumn("mode", F.when(F.col(seq) == F.col("first_seq"), "Discovery").otherwise("Cached")).drop("first_seq")


def known_families() -> tuple[str, ...]:
    return fixed.FAMILIES


def kept_fingerprints(rules: DataFrame, most: int = MOST_FINGERPRINTS, seq: str = "first_seq") -> DataFrame:
    """The newest fingerprints by the place of their first record, as a first-in-first-out cache would keep them."""
    return rules.orderBy(F.desc(seq)).limit(most)


def unseen_families(records: DataFrame, known: DataFrame) -> DataFrame:
    """First record of every family without a stored rule: what discovery has to look at."""
    new = records.join(F.broadcast(known.select("family").distinct()), "family", "left_anti")
    return new.groupBy("family").agg(F.min_by("raw", "seq").alias("raw"), F.min("seq").alias("seq"))


def numbered(rows: DataFrame, keys: list[str], name: str, seq: str = "seq", width: int = 100_000) -> DataFrame:
    """Adds name: how many rows of the same keys there are up to each one in order of seq.

    Rows are numbered within ranges of width of seq, and the ranges' counts summed up, so a key of very many rows is
    numbered by many tasks.
    """
    rows = rows.withColumn("_range", F.floor(F.col(seq) / F.lit(width)))
    theirs = {k: f"_of_{k}" for k in [*keys, "_range"]}
    w = Window.partitionBy(*(theirs[k] for k in keys)).orderBy("_of__range").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(*(F.col(k).alias(v) for k, v in theirs.items())).agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    nth = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(seq))
    got = rows.join(before, [F.col(k).eqNullSafe(F.col(v)) for k, v in theirs.items()])
    return got.withColumn(name, (F.col("_before") + nth).cast("int")).drop("_range", "_before", *theirs.values())


def with_repeats(records: DataFrame, *keys: str, seq: str = "seq") -> DataFrame:
    """Adds nth: how many times the same keys were seen up to this record."""
    return numbered(records, list(keys), "nth", seq)


def cascade(records: DataFrame, now: Column, raw: str = "raw", seq: str = "seq") -> DataFrame:
    """Family, rule, mode and the normalised record of every (seq, raw)."""
    rows = with_family(records, now, raw)
    rows = apply_rules(rows, family_rules(rows, now, seq, raw), seq)
    rows = rows.withColumn("method", F.col("rule.method")).withColumn("delimiter", F.col("rule.delimiter")).withColumn("format", F.col("rule.signature")).withColumn("inferred_by", F.col("rule.inferred_by"))
    return normalize(settled(parse(settled(rows), now, raw)), now, raw).drop("rule", "method", "delimiter")
