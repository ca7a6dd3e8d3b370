"""The whole cascade over stored and new rules: family, fingerprint, template, gate with quarantine, discovery, and error rows.

A record of a family that has a rule is answered from it. The first record of each other family decides for the rest:
it is discovered, or takes the rule stored for its template. Where novel formats are held back, records are
quarantined until one of their family may decide: it is not novel, its template or its very text has been seen
often enough, or its template has a rule. So each family has one deciding record, a minimum over the family's
records, and what follows is a join with at most 17 rows. Counts are needed up to the limits only; row numbers are
taken under a limit that Spark applies before the shuffle, so a template of very many records is no hot group.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.functions import fixed
from logweave.functions.text import mask_line, settled
from logweave.operators import rules
from logweave.operators.detect import fingerprint_key
from logweave.operators.discovery import discover
from logweave.operators.mining import GRADUATE_AFTER, GRADUATE_REPEATS, MOST_LINES, MOST_TEMPLATES
from logweave.operators.normalize import normalize
from logweave.operators.parse import parse
from logweave.operators.recency import left_over, recency_counts
from logweave.operators.reports import share
from logweave.sources.readers import rule_key
from logweave.sources.shared import cut

RULE = "struct<method:string,delimiter:string,signature:string,inferred_by:string>"


def _up_to(rows: DataFrame, keys: list[str], most: int, name: str) -> DataFrame:
    """The first rows of each key, at most most, with their number."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("seq"))
    return rows.withColumn(name, nth).where(F.col(name) <= most)


@dataclass
class Quarantine:
    """Counters of held back records (recency.STATE): those that earlier records left, and after decide() those that these leave."""

    templates: DataFrame | None = None
    lines: DataFrame | None = None
    most_templates: int = MOST_TEMPLATES
    most_lines: int = MOST_LINES


def decide(
    records: DataFrame, now: Column, *, known: DataFrame | None = None, templates: DataFrame | None = None, gate: Callable[[DataFrame], DataFrame] | None = None, enforce: bool = False,
    failed: Column | None = None, template: Column | None = None, graduate_after: int = GRADUATE_AFTER, graduate_repeats: int = GRADUATE_REPEATS,
    providers: dict[str, Callable[[str], str]] | None = None, quarantine: Quarantine | None = None,
) -> DataFrame:
    """Adds family, mode, tier, rule, template, novel, distance, family_guess, quarantine_count, occurrences and error to (seq, raw).

    known has stored rules (family, rule) of at most 17 families; the one of generic stands for the fingerprint cache,
    in which any fingerprint of a family is that family's. templates has rules (key, rule) by rule_key(template). gate
    turns different masked texts (masked) into (masked, novel, distance, family_guess); without one nothing is novel.
    failed gives what is wrong with a record; such records, and those without text, get mode Error and teach nothing.
    template is the masked line unless given. Without enforce nothing is held back. providers are asked, in turn, for
    the rules of deciding records that have none by template, and llm_error says what was wrong with their replies;
    such records are one for a family at most and go through the driver. With quarantine, counters remember so many
    templates and lines seen last and go on from what earlier records left; seq must go on too. Other columns are kept.
    """
    error = F.when(F.col("raw").isNull(), "no text") if failed is None else F.coalesce(F.when(F.col("raw").isNull(), "no text"), failed)
    rows = rules.with_family(records.withColumn("error", error), now)
    rows = rows.withColumn("family", F.when(F.col("error").isNull(), F.col("family")).otherwise("unknown"))
    masked = F.when(F.col("error").isNull(), mask_line(F.col("raw")))
    # Used by all that follows. Masked lines are only where a gate is asked about all; else those of the few deciding records are made when they are needed.
    rows = cut(rows if gate is None else rows.withColumn("masked", masked))
    if template is None:
        template = masked if gate is None else F.col("masked")
    known = rows.sparkSession.createDataFrame([], f"family string, rule {RULE}") if known is None else known.select("family", F.col("rule").cast(RULE).alias("rule"))
    open_ = rows.where("error is null").join(F.broadcast(known), "family", "left_anti")
    if gate is not None:
        judged = cut(gate(open_.select("masked").distinct()).select("masked", "novel", "distance", "family_guess"))
        open_ = open_.join(judged, "masked", "left")
    else:
        open_ = open_.withColumn("novel", F.lit(False)).withColumn("distance", F.lit(None).cast("double")).withColumn("family_guess", F.lit(None).cast("string"))
    if templates is None:
        ruled = lambda rows: rows.withColumn("own", F.lit(None).cast(RULE))
    else:
        ruled = lambda rows: rows.withColumn("key", rule_key("template")).join(templates.select("key", F.col("rule").cast(RULE).alias("own")), "key", "left").drop("key")
    if enforce:  # a record whose template has a rule is not held back; else only deciding records ask for theirs
        open_ = ruled(open_.withColumn("template", template))
    open_ = open_.withColumn("novel", F.coalesce("novel", F.lit(False)))
    held = F.col("novel") & F.col("own").isNull() if enforce else F.lit(False)
    waiting = open_.where(held).select("seq", "family", (F.col("template") if enforce else template).alias("template"), "raw", "family_guess")
    if quarantine is None:
        by_template = _up_to(waiting, ["family", "template"], graduate_after, "quarantine_count").select("seq", "family", "quarantine_count")
        by_line = _up_to(waiting, ["family", "raw", "family_guess"], graduate_repeats, "occurrences").select("seq", "family", "occurrences")
    else:
        waiting = cut(waiting)
        of_family = waiting.select("seq", "family")
        by_template, by_line = (
            cut(recency_counts(waiting, keys, most, name, start=before).join(of_family, "seq"))
            for keys, most, name, before in ((["template"], quarantine.most_templates, "quarantine_count", quarantine.templates), (["raw", "family_guess"], quarantine.most_lines, "occurrences", quarantine.lines))
        )
    able = open_.where(~held).select("family", "seq").unionByName(by_template.where(F.col("quarantine_count") >= graduate_after).select("family", "seq"))
    able = able.unionByName(by_line.where(F.col("occurrences") >= graduate_repeats).select("family", "seq"))
    first = cut(able.groupBy("family").agg(F.min("seq").alias("decided")))
    if quarantine is not None:  # records after the deciding one are answered by its rule and not counted
        still = lambda rows: rows.join(F.broadcast(first), "family", "left").where(F.col("decided").isNull() | (F.col("seq") <= F.col("decided")))
        quarantine.templates = left_over(still(by_template), quarantine.most_templates, "quarantine_count", quarantine.templates)
        quarantine.lines = left_over(still(by_line), quarantine.most_lines, "occurrences", quarantine.lines)
        by_template, by_line = by_template.drop("key"), by_line.drop("key")
    # The deciding records, one for a family, with the rule each gives.
    heads = open_.join(F.broadcast(first), (open_["family"] == first["family"]) & (open_["seq"] == first["decided"])).drop(first["family"])
    heads = heads if enforce else ruled(heads.withColumn("template", template))
    heads = rules.with_rule(heads.select("family", "decided", "raw", "own"), now)
    if providers:
        heads = _asked(cut(heads), providers)
    else:
        heads = heads.withColumn("llm_error", F.lit(None).cast("string"))
    heads = heads.select("family", "decided", F.coalesce("own", F.col("own_rule").cast(RULE)).alias("rule"), F.col("own").isNotNull().alias("by_template"), "llm_error")
    stored = known.select("family", F.lit(None).cast("long").alias("decided"), "rule", F.lit(False).alias("by_template"), F.lit(None).cast("string").alias("llm_error"))
    given = F.broadcast(heads.withColumn("decided", F.col("decided").cast("long")).unionByName(stored))
    facts = open_.where("error is null").select("seq", "novel", "distance", "family_guess") if gate is not None else None
    out = rows.join(given, "family", "left")
    if facts is not None:
        out = out.join(facts, "seq", "left")
    else:
        out = out.withColumn("novel", F.lit(None).cast("boolean")).withColumn("distance", F.lit(None).cast("double")).withColumn("family_guess", F.lit(None).cast("string"))
    if enforce:
        out = out.join(by_template.drop("family"), "seq", "left").join(by_line.drop("family"), "seq", "left")
    else:
        out = out.withColumn("quarantine_count", F.lit(None).cast("int")).withColumn("occurrences", F.lit(None).cast("int"))
    seq, decided = F.col("seq"), F.col("decided")
    waits = F.col("error").isNull() & ((decided.isNull() & F.col("rule").isNull()) | (seq < decided))
    stage = F.when(F.col("family").isin(*fixed.FAMILIES), "family").otherwise("fingerprint")
    out = out.withColumn(
        "tier",
        F.when(F.col("error").isNotNull(), "error").when(waits, "quarantine").when(seq == decided, F.when(F.col("by_template"), "template").when(F.col("occurrences") >= graduate_repeats, "escalated").otherwise("discovery")).otherwise(stage),
    )
    mode = F.when(F.col("tier") == "error", "Error").when(F.col("tier") == "quarantine", "Quarantined").when(F.col("tier").isin("discovery", "escalated"), "Discovery").otherwise("Cached")
    seen = F.col("tier").isin("quarantine", "template", "discovery", "escalated")
    of_tier = ("novel", "distance", "family_guess", "quarantine_count", "occurrences")
    out = out.withColumn("llm_error", F.when(seq == decided, F.col("llm_error"))) if providers else out.drop("llm_error")
    out = out.withColumns({"mode": mode, "template": F.when(seen, template)} | {c: F.when(seen, F.col(c)) for c in of_tier})
    if enforce:  # a record held back is parsed by the rule it would give itself, which is not kept
        own = rules.with_rule(out.where("tier = 'quarantine'"), now).withColumn("rule", F.col("own_rule").cast(RULE)).drop("fingerprint", "own_rule")
        out = out.where("tier <> 'quarantine'").unionByName(own)
    return out.drop("masked", "decided", "by_template")


def _asked(heads: DataFrame, providers: dict[str, Callable[[str], str]]) -> DataFrame:
    """The deciding records with the rules that providers give in place of their own, and what was wrong."""
    found = [(r["family"], (r["method"], r.get("delimiter"), r["signature"], r["inferred_by"]), r["llm_error"]) for r in discover(heads.where("own is null").select("family", "raw", F.col("own_rule").cast(RULE).alias("own_rule")), providers)]
    given = heads.sparkSession.createDataFrame(found, f"family string, given {RULE}, llm_error string")
    return heads.join(F.broadcast(given), "family", "left").withColumn("own_rule", F.coalesce("given", F.col("own_rule").cast(RULE)))


def process(decided: DataFrame, now: Column) -> DataFrame:
    """The normalised record of every decided one; those in error have empty fields and keep their text."""
    rows = decided.withColumn("method", F.col("rule.method")).withColumn("delimiter", F.col("rule.delimiter"))
    rows = rows.withColumn("format", F.coalesce("rule.signature", F.lit("n/a"))).withColumn("inferred_by", F.col("rule.inferred_by")).drop("rule")
    good = normalize(settled(parse(settled(rows.where("error is null")), now)), now)
    none = {"timestamp": "string", "message": "string", "ts": "timestamp"}
    bad = rows.where("error is not null").withColumns({c: F.lit(None).cast(t) for c, t in none.items()})
    bad = bad.withColumns({c: F.lit("unknown") for c in ("source", "event_type", "severity")}).withColumn("extra", F.create_map().cast("map<string,string>"))
    return good.unionByName(bad).drop("method", "delimiter")


def _counts(graduate_after: int) -> list[Column]:
    seen = F.col("tier").isin("quarantine", "template", "discovery", "escalated")
    asked = seen & (F.col("tier") != "template")
    return [
        F.count_if(seen).alias("mined"), F.count_if(F.col("tier") == "template").alias("template_rule_hits"), F.count_distinct(F.when(asked, F.struct("family", "template"))).alias("novel_templates"),
        F.count_if((F.col("tier") == "discovery") & (F.col("quarantine_count") >= graduate_after)).alias("graduated_now"), F.count_if(F.col("tier") == "template").alias("kv_backed_rules"),
        F.count_if(F.col("tier") == "escalated").alias("escalated"),
    ]


def tier_stats(decided: DataFrame, graduate_after: int = GRADUATE_AFTER) -> DataFrame:
    """One row: what the template tier has seen and done."""
    return decided.agg(*_counts(graduate_after))


def learned_families(decided: DataFrame) -> DataFrame:
    """(family, rule, first_seq) that a run adds to the stored rules."""
    return decided.where(F.col("tier").isin("template", "discovery", "escalated")).select("family", "rule", F.col("seq").alias("first_seq"))


def learned_templates(decided: DataFrame, at: Column) -> DataFrame:
    """(key, template, rule, learned_at) that a run adds to the shared rule table; a rule that came from it is not written again."""
    new = decided.where(F.col("tier").isin("discovery", "escalated") & F.col("template").isNotNull())
    return new.select(rule_key("template").alias("key"), "template", "rule", at.alias("learned_at"))


def replace_rules(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Family rules after a run: the first one stays, unless a discovered one (inferred by a provider) replaces a heuristic one; generic has none here."""
    both = stored.select("family", "rule", F.lit(0).alias("turn")).unionByName(found.select("family", "rule", F.lit(1).alias("turn")))
    best = F.min_by("rule", F.struct((F.col("rule.inferred_by") != "llm").alias("a"), F.col("turn")))
    return both.where(F.col("family") != "generic").groupBy("family").agg(best.alias("rule"))


def cache_view(decided: DataFrame, now: Column, most: int = rules.MOST_FINGERPRINTS) -> DataFrame:
    """The stored fingerprints of a run with their rules, the newest most."""
    heads = decided.where(F.col("tier").isin("template", "discovery", "escalated")).select("seq", "raw", "family", F.col("rule").alias("inferred_rule"))
    rows = rules.with_rule(heads, now).select("seq", "family", fingerprint_key(F.col("fingerprint")).alias("fingerprint_features"), "inferred_rule")
    return rules.kept_fingerprints(rows, most, "seq")


def health(decided: DataFrame, gate_reason: str | None = None, threshold: float | None = None, enforce: bool = False, graduate_after: int = GRADUATE_AFTER) -> DataFrame:
    """One row: families with a rule, counts of the template tier, and the gate's state."""
    ruled = F.col("tier").isin("template", "discovery", "escalated", "family") & (F.col("family") != "generic")
    got = decided.agg(F.array_sort(F.collect_set(F.when(ruled, F.col("family")))).alias("families"), *_counts(graduate_after))
    state = {"enforce_mode": F.lit(enforce), "gate_loaded": F.lit(gate_reason is None and threshold is not None), "gate_reason": F.lit(gate_reason).cast("string"), "gate_threshold": F.lit(threshold).cast("double")}
    return got.select(F.lit("healthy").alias("status"), F.size("families").alias("families_learned"), "*", *(c.alias(k) for k, c in state.items()))


def accuracy(records: DataFrame, copies: Column | None = None) -> DataFrame:
    """One row: share of lines whose family the gate guesses, and the number of different families. A row stands for copies lines."""
    return records.agg(share(F.col("gate_family") == F.col("family"), F.lit(1) if copies is None else copies).alias("accuracy"), F.count_distinct("family").alias("families"))
