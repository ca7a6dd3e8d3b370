"""Assembling physical lines into logical records."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.functions import fixed
from logweave.functions.text import matches, strip

MOST_LINES = 500
_RECORD = "batch_id long, rec_no long, raw string, n_lines int"


def _fold(pdf: pd.DataFrame) -> pd.DataFrame:
    """Line by line, for batches in which a record reaches MOST_LINES lines and starts anew."""
    out, open_, depth, traced = [], [], 0, False
    for r in pdf.sort_values("line_no").itertuples(index=False):
        joins = bool(open_) and (depth > 0 or r.prefix)
        if open_ and not joins and traced and r.error:
            joins, traced = True, False
        if joins and len(open_) < MOST_LINES:
            open_.append(r.line)
        else:
            if open_:
                out.append(open_)
            open_, depth, traced = [r.line], 0, False
        low = min(0, depth + r.lowest)
        depth = 0 if r.cut else max(0, depth + r.delta) if low == 0 or depth + r.delta >= 0 else 0
        traced = traced or r.traces
    if open_:
        out.append(open_)
    return pd.DataFrame({"batch_id": pdf["batch_id"].iloc[0] if len(pdf) else [], "rec_no": range(1, len(out) + 1), "raw": ["\n".join(x) for x in out], "n_lines": [len(x) for x in out]})


def line_features(lines: DataFrame) -> DataFrame:
    """Adds what decides whether a line continues a record: net braces outside quotes, an open quote, and its opening."""
    line = F.col("line")
    bare = F.regexp_replace(line, r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"', "")
    cut = bare.contains('"')
    head = F.when(cut, F.substring_index(bare, '"', 1)).otherwise(bare)
    s = strip(line)
    return (
        lines.where(s != "")
        .withColumn("cut", cut)
        .withColumn("delta", F.length(F.regexp_replace(head, r"[^{]", "")) - F.length(F.regexp_replace(head, r"[^}]", "")))
        .withColumn("lowest", F.lit(0))
        .withColumn("prefix", line.rlike(r"^[ \t]") | line.startswith("Caused by:") | line.startswith("... ") | (s.startswith("at ") & line.rlike(r"[(.]")))
        .withColumn("error", matches(line, fixed.SHAPES["exception"]))
        .withColumn("traces", line.contains("Traceback (most recent call last):") | line.contains("Exception in thread"))
    )


def assemble(lines: DataFrame) -> DataFrame:
    """Records (batch_id, rec_no, raw, n_lines) from lines (batch_id, line_no, line).

    A line continues the open record inside braces, after an indent or a stack-trace opening, or as the error line
    that ends a traceback. Depth is a running sum of braces reflected at zero, reset where a quote stays open, so
    windows over a batch express it: reset groups, running minimum, lag. Only batches with a record of more than
    MOST_LINES lines are folded line by line, each by its own task.
    """
    rows = line_features(lines)
    by_batch = Window.partitionBy("batch_id").orderBy("line_no")
    so_far = by_batch.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("g", F.sum(F.col("cut").cast("int")).over(so_far))
    in_group = Window.partitionBy("batch_id", "g").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("level", F.sum(F.when(F.col("cut"), 0).otherwise(F.col("delta"))).over(in_group))
    rows = rows.withColumn("depth", F.col("level") - F.least(F.lit(0), F.min("level").over(in_group)))
    rows = rows.withColumn("soft", F.coalesce(F.lag("depth").over(by_batch), F.lit(0)) > 0)
    rows = rows.withColumn("first", F.row_number().over(by_batch) == 1)
    rows = rows.withColumn("soft", ~F.col("first") & (F.col("soft") | F.col("prefix")))
    # A traceback is open from the record's last tracing line until one error line has used it up.
    rows = rows.withColumn("grp", F.sum((~F.col("soft")).cast("int")).over(so_far))
    group = Window.partitionBy("batch_id", "grp")
    rows = rows.withColumn("has_trace", F.max(F.col("traces").cast("int")).over(group))
    before = rows.select("batch_id", F.col("grp").alias("grp"), "has_trace").distinct().withColumn("grp", F.col("grp") + 1).withColumnRenamed("has_trace", "trace_before")
    rows = rows.join(before, ["batch_id", "grp"], "left")
    rows = rows.withColumn("joins", F.col("soft") | (~F.col("first") & F.col("error") & (F.coalesce("trace_before", F.lit(0)) == 1)))
    rows = rows.withColumn("rec_no", F.sum((~F.col("joins")).cast("int")).over(so_far))
    sizes = rows.groupBy("batch_id", "rec_no").agg(F.count("*").alias("n"))
    long_ = sizes.where(F.col("n") > MOST_LINES).select("batch_id").distinct()
    plain = (
        rows.join(long_, "batch_id", "left_anti")
        .groupBy("batch_id", "rec_no")
        .agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
        .select("batch_id", F.col("rec_no").cast("long").alias("rec_no"), F.array_join(F.col("l.line"), "\n").alias("raw"), F.size("l").alias("n_lines"))
    )
    folded = rows.join(long_, "batch_id", "left_semi").select("batch_id", "line_no", "line", "cut", "delta", "lowest", "prefix", "error", "traces").groupBy("batch_id").applyInPandas(_fold, _RECORD)
    return plain.unionByName(folded)
