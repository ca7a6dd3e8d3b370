"""Sources and sinks."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.sources import commits

LONGEST_LINE, LARGEST_BATCH = 10_000, 1000


def read_lines(spark: SparkSession, path: str, batch_lines: int = LARGEST_BATCH) -> DataFrame:
    """Lines (batch_id, line_no, line, file, block_start, batch) of text files.

    A file is read in blocks, each by one task in the order of its bytes; batches are runs of lines within a block, so
    numbering never takes more than a block into a task. (file, block_start, batch, line_no) is the files' order.
    """
    rows = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block_start"), F.monotonically_increasing_id().alias("id"))
    nth = F.row_number().over(Window.partitionBy("file", "block_start").orderBy("id")) - 1
    rows = rows.withColumn("nth", nth).withColumn("batch", F.floor(F.col("nth") / batch_lines))
    return rows.select(F.xxhash64("file", "block_start", "batch").alias("batch_id"), (F.col("nth") % batch_lines + 1).alias("line_no"), "line", "file", "block_start", "batch")


def within_limits(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused): a batch with a line that is too long, or with too many lines, is refused as a whole."""
    bad = lines.groupBy("batch_id").agg(F.max(F.length("line")).alias("longest"), F.count("*").alias("n")).where((F.col("longest") > LONGEST_LINE) | (F.col("n") > LARGEST_BATCH)).select("batch_id")
    return lines.join(bad, "batch_id", "left_anti"), lines.join(bad, "batch_id", "left_semi")


def split_lines(df: DataFrame, text: str = "text", *keys: str) -> DataFrame:
    """One row per line that is not blank, with its place."""
    rows = df.select(*keys, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return rows.where(F.regexp_replace("line", r"(?U)^\s+|\s+$", "") != "")


def read_tail(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A growing directory as a stream of lines that are not empty, with their arrival."""
    rows = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return rows.where("value <> ''").select(F.col("value").alias("line"), F.current_timestamp().alias("arrived"))


def write_records(df: DataFrame, path: str, partition_by: str = "family", batch: int | None = None) -> bool:
    """Adds records to a table; those of a numbered batch once only, however often it comes (read by commits.read_batches)."""
    if batch is not None:
        return commits.add_batch(df, path, batch, partition_by)
    df.write.mode("append").partitionBy(partition_by).parquet(path)
    return True


def write_ndjson(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def newest_runs(runs: DataFrame, keep: int = 3, most_bytes: int | None = 3_500_000) -> DataFrame:
    """The newest runs (id, at, bytes), at most keep of them and most_bytes together (None: of any size); the newest always stays."""
    top = runs.orderBy(F.desc("at"), F.desc("id")).limit(keep)
    if most_bytes is None:
        return top
    w = Window.orderBy(F.desc("at"), F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    newest = Window.orderBy(F.desc("at"), F.desc("id"))
    summed = top.withColumn("total", F.sum("bytes").over(w)).withColumn("nth", F.row_number().over(newest))
    return summed.where((F.col("total") <= most_bytes) | (F.col("nth") == 1)).drop("total", "nth")


def trimmed_runs(records: DataFrame, runs: DataFrame, most_bytes: int = 3_500_000, most_records: int = 500) -> DataFrame:
    """Records (id, seq, ...) of the newest runs as a store of most_bytes keeps them.

    Where the newest run alone is larger, it is the only one, and only its first most_records records stay.
    """
    kept = newest_runs(runs, most_bytes=most_bytes).select("id", "at", "bytes")
    large = kept.where(F.col("bytes") > most_bytes).select(F.col("id").alias("_id"))  # none or the only one
    rows = records.join(F.broadcast(kept.select("id")), "id")
    whole = rows.join(F.broadcast(large), F.col("id") == F.col("_id"), "left_anti")
    return whole.unionByName(rows.join(F.broadcast(large), F.col("id") == F.col("_id"), "left_semi").orderBy("seq").limit(most_records))


def rule_key(template: str = "template"):
    """Key of a template's rule in a shared rule table."""
    return F.concat(F.lit("sih:rule:"), F.substring(F.sha1(F.col(template).cast("binary")), 1, 16))


def upsert_rules(known: DataFrame, learned: DataFrame, now, days: int = 7) -> DataFrame:
    """Rule table (key, rule, learned_at) with newer rules in place of older ones, and without those past their days."""
    w = Window.partitionBy("key").orderBy(F.desc("learned_at"))
    rows = known.unionByName(learned).withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")
    return rows.where(F.col("learned_at") > now - F.make_dt_interval(F.lit(days)))


def load_gate(path: str, version: int = 2) -> tuple[PipelineModel | None, str | None]:
    """The saved model, or None and why there is none; without a model nothing is novel."""
    try:
        spark = SparkSession.active()
        meta = spark.read.json(f"{path}/meta").first()
        if meta["gate_version"] != version:
            return None, f"feature version {meta['gate_version']} is not {version}"
        return PipelineModel.load(f"{path}/model"), None
    except Exception as e:  # any failure leaves the gate open
        return None, f"{type(e).__name__}: {str(e)[:120]}"


def save_gate(model: PipelineModel, path: str, accuracy: float, caught: float, threshold: float, least_accuracy: float = 0.95, least_caught: float = 0.9) -> bool:
    """Saves a model if it meets the quality floors; tells whether it does."""
    if accuracy < least_accuracy or caught < least_caught:
        return False
    spark = SparkSession.active()
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(2, threshold, accuracy, caught)], "gate_version int, threshold double, accuracy double, caught double").write.mode("overwrite").json(f"{path}/meta")
    return True


def load_state(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    """A table of the kept state (families, templates, quarantine); empty with that schema where there is none."""
    return commits.load(spark, path, table, schema)


def save_state(df: DataFrame, path: str, table: str) -> None:
    """Replaces a table of the state, which it may be made from: a new version is valid as a whole or not at all."""
    commits.commit(df.sparkSession, path, {table: df})


def clear_state(spark: SparkSession, path: str, tables: tuple[str, ...] = ("families", "fingerprints", "templates", "quarantine")) -> DataFrame:
    """Forgets all kept rules: rows (table, cleared) with what each table held. A second call finds nothing.

    The counters of held back records go with the quarantine.
    """
    held = [(t, commits.count(spark, path, t)) for t in tables]
    commits.commit(spark, path, dict.fromkeys([*tables, *(("q_templates", "q_lines") if "quarantine" in tables else ())]))
    return spark.createDataFrame(held, "table string, cleared long")
