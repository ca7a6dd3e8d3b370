"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm.graph import cut

BUCKETS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, budget: float, max_epochs: float = 3.0) -> DataFrame:
    """Adds target to rows (source, source_size, weight): shares of budget by weight, none above max_epochs times its size.

    Sources above their cap are clamped and the excess goes to the rest by weight, again and again until none is
    above; if all are clamped the rest of the budget stays unused. Each round brings three sums to the driver.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level = 0.0
    clamped = F.lit(False)
    n = -1
    while True:
        got = sources.agg(
            F.sum(F.when(~clamped, F.col("weight"))).alias("weight"), F.sum(F.when(clamped, cap)).alias("used"), F.count(F.when(clamped, 1)).alias("n")
        ).first()
        if got["n"] == n or not got["weight"]:
            break
        n = got["n"]
        level = max(0.0, (budget - (got["used"] or 0.0)) / got["weight"])
        clamped = F.col("weight") * F.lit(level) > cap
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)).cast("double"))


def ranked_weights(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0)) -> DataFrame:
    """Weights dealt in turn to the sources in code point order, null last. One row per source is ordered, never documents."""
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    return sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))


def repetitions(sized: DataFrame, targets: DataFrame, seed: int = 17) -> DataFrame:
    """Adds target, source_size and times (whole copies of the document in the mix) to rows with doc_id, size, source, _t.

    target / source_size gives each document its whole repetitions; the fraction is sampled: documents are ordered
    by a seeded hash and taken while their words fit what is missing, the one on the edge if that comes nearer.
    The running sum is taken over BUCKETS hash ranges of a source first and inside the one range on the edge, so
    no task holds a source. Equal seeds give equal mixes.
    """
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(str(seed)))), 1, 8), 16, 10).cast("long")
    rows = sized.withColumn("_h", key).withColumn("_b", F.pmod("_h", F.lit(BUCKETS)).cast("int"))
    t = targets.select(
        F.col("source").alias("_s"),
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("_whole"),
    ).withColumn("_extra", F.col("target") - F.col("_whole") * F.col("source_size"))
    w = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy(F.col("source").alias("_s"), "_b").agg(F.sum("size").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    plan = ranges.join(t, ranges["_s"].eqNullSafe(t["_s"])).select(
        ranges["_s"].alias("_src"),
        F.col("_b").alias("_pb"),
        "source_size",
        "target",
        "_whole",
        (F.col("_extra") - F.col("_before")).alias("_left"),
        ((F.col("_before") < F.col("_extra")) & (F.col("_before") + F.col("_n") > F.col("_extra"))).alias("_edge"),
    )
    inside = Window.partitionBy("_src", "_pb", "_edge").orderBy("_h", "doc_id", "size", "_t").rowsBetween(Window.unboundedPreceding, -1)
    got = rows.join(plan, rows["source"].eqNullSafe(plan["_src"]) & (rows["_b"] == plan["_pb"]))
    edge = got.where("_edge").withColumn("_at", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    edge = edge.withColumn("times", F.col("_whole") + (F.col("_at") + F.col("size") / 2 <= F.col("_left")).cast("long")).drop("_at")
    plain = got.where("not _edge").withColumn("times", F.col("_whole") + (F.col("_left") > 0).cast("long"))
    return plain.unionByName(edge).withColumn("times", F.col("times").cast("long")).drop("_h", "_b", "_t", "_src", "_pb", "_whole", "_left", "_edge")


def mix(docs: DataFrame, max_epochs: float = 3.0, seed: int = 17, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, times and the columns named in keep, for every document.

    Null text has size 0; a null source is a source of its own, last in order. Sources without words have target 0
    and their documents no copies. Repeated rows count each time. An empty table gives no rows.
    """
    sized = docs.select("doc_id", "source", word_count().alias("size"), F.xxhash64("text").alias("_t"), *keep)  # the hash only orders ties
    if not keep:
        sized = cut(sized)  # words are counted once, and rows without texts are small
    sizes = cut(sized.select("source", "size").groupBy("source").agg(F.sum("size").alias("source_size")))
    total = sizes.agg(F.sum("source_size")).first()[0] or 0
    targets = water_fill(ranked_weights(sizes), float(total), max_epochs)
    return repetitions(sized, targets, seed)


def repeated(docs: DataFrame, max_epochs: float = 3.0, seed: int = 17) -> DataFrame:
    """The documents, all columns kept, each as many times as the mix takes it.

    Null and empty texts have size 0 and are repeated as often as their source's whole repetitions say. A null source is
    one of its own. Repeated rows count each time; an empty table gives no rows.
    """
    inner = docs.select(F.col("doc_id"), F.col("source"), F.col("text"), F.struct(*(F.col(c).alias(f"c_{c}") for c in docs.columns if c not in ("doc_id", "source", "text"))).alias("_row"))
    times = mix(inner, max_epochs, seed, keep=("text", "_row")).where("times > 0")
    out = times.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return out.select(*(F.col(c) if c in ("doc_id", "source", "text") else F.col(f"_row.c_{c}").alias(c) for c in docs.columns))
