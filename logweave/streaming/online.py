"""The cascade as a stream: rules are kept in a small table, records normalised batch by batch."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from logweave.functions import fixed
from logweave.operators import tiers
from logweave.operators.recency import STATE
from logweave.sources import commits
from logweave.sources.readers import load_state, upsert_rules
from logweave.sources.shared import cut

RULE_DAYS, OBSERVED = 7, "arrived"
STATS = "mined long, template_rule_hits long, novel_templates long, graduated_now long, kv_backed_rules long, escalated long"
FAMILIES = f"family string, rule {tiers.RULE}"
TEMPLATES = f"key string, template string, rule {tiers.RULE}, learned_at timestamp"


def online(batch: DataFrame, now: Column, state: str, sink: Callable[[DataFrame], None], batch_id: int | None = None, **options) -> None:
    """Gives sink the normalised records of one batch (seq, raw), by the rules kept under state and those its records give.

    Kept are rules, one for each of 17 families at most and one for each discovered template, forgotten after
    RULE_DAYS; the counters of held back records, as many as they remember; and sums of the tiers. All of it changes
    in one commit after the sink is done, with the batch's number: a batch that failed before is decided alike again,
    and one that was committed is left alone. A sink that adds output under that number (write_records) adds it once.
    Parsing is not keyed, so a batch stays spread as it was read. options go to tiers.decide().
    """
    spark = batch.sparkSession
    if batch_id is not None and (done := commits.last_batch(spark, state)) is not None and batch_id <= done:
        return
    known, templates = load_state(spark, state, "families", FAMILIES), load_state(spark, state, "templates", TEMPLATES)
    held = None
    if options.get("enforce"):
        held = tiers.Quarantine(load_state(spark, state, "q_templates", STATE), load_state(spark, state, "q_lines", STATE))
    decided = cut(tiers.decide(batch, now, known=known, templates=templates.where(_lives(F.col("learned_at"), now)), quarantine=held, **options))
    first = decided.where(F.col("tier").isin("template", "discovery", "escalated")).select("seq", "raw", "family", "template", "tier", "rule")
    heads = spark.createDataFrame(first.limit(len(fixed.FAMILIES) + 1).collect(), first.schema)  # a row for each new family
    sink(tiers.process(decided, now))
    sums = tiers.tier_stats(decided).unionByName(load_state(spark, state, "stats", STATS))
    tables = {"stats": sums.agg(*(F.sum(c).alias(c) for c in sums.columns))}
    if held is not None:
        tables |= {"q_templates": held.templates, "q_lines": held.lines}
    if not heads.isEmpty():
        learned = tiers.learned_families(heads).select("family", "rule")
        generic = known.where("family = 'generic'").unionByName(learned.where("family = 'generic'")).limit(1)
        tables |= {"families": tiers.replace_rules(known, learned).unionByName(generic), "templates": upsert_rules(templates, tiers.learned_templates(heads, now), now, RULE_DAYS)}
    commits.commit(spark, state, tables, batch_id)


def _lives(learned: Column, now: Column) -> Column:
    return learned > now - F.make_dt_interval(F.lit(RULE_DAYS))


def counts_by_window(records: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Records per window and severity by event time, with late ones within a watermark."""
    return records.withWatermark("ts", late).groupBy(F.window("ts", width), "severity").agg(F.count("*").alias("n"))


class Totals(StreamingQueryListener):
    """Sums of a stream's observed metrics over its batches, by name and column."""

    def __init__(self, name: str = OBSERVED):
        self.name, self.sums, self.batches = name, Counter(), set()

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        seen = event.progress.observedMetrics.get(self.name)
        key = (str(event.progress.runId), event.progress.batchId)
        if seen is not None and key not in self.batches:
            self.batches.add(key)
            self.sums.update({k: v for k, v in seen.asDict().items() if v})

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


def run(stream: DataFrame, now: Column, checkpoint: str, sink: Callable[[DataFrame, int], None], once: bool = False, state: str | None = None, **options):
    """Starts the stream (seq, raw); sink gets each batch of normalised records. State is kept beside the checkpoint by default.

    Every batch observes how many lines came and how many had no text, which Totals sums up.
    """
    seen = stream.observe(OBSERVED, F.count("*").alias("lines"), F.count_if(F.col("raw").isNull()).alias("without_text"))
    writer = seen.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, i: online(batch, now, state or f"{checkpoint}/rules", lambda got: sink(got, i), i, **options))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()
