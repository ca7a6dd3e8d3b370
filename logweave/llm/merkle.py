"""Document fingerprints: a Merkle tree over paragraphs and sections, in SQL functions only.

Paragraphs (the leaves) tile the text: each ends after a line break, a punctuation mark and space or an ideographic
punctuation mark; where there is none within 120 characters, at the first space after 32, or after 120 at the latest. A section ends after a paragraph whose hash begins with 0-3, so an edit moves no
boundary beyond its own paragraph. A section's hash is taken over its paragraphs' hashes, the root over the
sections'. The fingerprint is the root, a colon and the paragraphs' hash prefixes with a dot after each section.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARAGRAPH = r"(?s).{1,120}?(?:\n|[.!?,;|] |[、。！，？；]|\z)|.{32,119}? |.{120}"


def paragraphs(text: Column) -> Column:
    """Hashes of the paragraphs; none for an empty text."""
    return F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.md5(p))


def _closed(h: Column, shown: Column) -> Column:
    return F.when(h < "4", F.concat(shown, F.lit("."))).otherwise(shown)


def sections(leaves: Column) -> Column:
    """Hashes of the sections, from the paragraphs' hashes."""
    return F.transform(F.split(F.array_join(F.transform(leaves, lambda h: _closed(h, h)), ""), "[.]"), lambda s: F.md5(s))


def fingerprint(leaves: Column, branches: Column) -> Column:
    root = F.md5(F.array_join(branches, ""))
    return F.concat(root, F.lit(":"), F.array_join(F.transform(leaves, lambda h: _closed(h, F.substring(h, 1, 8))), ""))


def short(leaves: Column) -> Column:
    return F.array_distinct(F.transform(leaves, lambda h: F.substring(h, 1, 8)))


def likeness(a: Column, b: Column) -> Column:
    """Share of the two trees' different paragraphs that both have; 1 for two empty trees."""
    both = F.size(F.array_intersect(a, b))
    whole = F.size(a) + F.size(b) - both
    return F.when(whole == 0, F.lit(1.0)).otherwise(both / whole)


def edited_branches(sa: Column, sb: Column) -> Column:
    """Positions (from 0) of the sections of one tree that the other lacks: where an edit lies."""
    return F.filter(F.transform(sa, lambda s, i: F.when(~F.array_contains(sb, s), i)), lambda i: i.isNotNull())


def _chunk(bounds: list[int], key: str) -> Column:
    """How many of the sorted bounds are <= key, by binary search; 0 for null."""
    top = 1
    while top <= len(bounds):
        top *= 2
    padded = F.array(*[F.lit(b).cast("long") for b in bounds]) if len(bounds) < 200 else F.from_json(F.lit("[" + ",".join(map(str, bounds)) + "]"), "array<long>")
    steps = F.array(*[F.lit(top >> i) for i in range(1, top.bit_length())]) if top > 1 else F.array().cast("array<int>")
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.try_element_at(padded, at + s) <= F.col(key), at + s).otherwise(at))


def with_next(docs: DataFrame, rows_per_chunk: int = 1000, max_chunks: int = 20_000) -> DataFrame:
    """Adds next_text: the text of the document with the next lower doc_id, the highest one's for the lowest.

    Documents are dealt once by ranges of doc_id; each range also gets the first text of the next range, so no
    global window is needed. Null ids come last; equal ids follow their texts.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = docs.count()
    k = min(max_chunks, n // rows_per_chunk)
    bounds = docs.agg(F.percentile_approx("doc_id", [i / (k + 1) for i in range(1, k + 1)], 10 * max(k, 1000))).first()[0] or [] if k else []
    rows = docs.withColumn("chunk", _chunk(sorted(set(bounds)), "doc_id"))
    # One head per range: at most max_chunks + 1 small rows are ordered, their texts only joined.
    top = rows.groupBy("chunk").agg(F.max("doc_id").alias("top"))
    turn = Window.orderBy(F.col("chunk").desc())
    ring = top.select(
        F.col("chunk").alias("head"), "top", F.coalesce(F.lag("chunk").over(turn), F.first("chunk").over(Window.orderBy("chunk"))).alias("to")
    )
    heads = (
        rows.join(F.broadcast(ring), (rows["chunk"] == ring["head"]) & rows["doc_id"].eqNullSafe(ring["top"]))
        .groupBy(F.col("to").alias("chunk"))
        .agg(F.min("text").alias("text"))
        .select(F.lit(None).cast("long").alias("doc_id"), "text", "chunk", F.lit(1).alias("last"))
    )
    order = Window.partitionBy("chunk").orderBy("last", F.col("doc_id").desc_nulls_last(), "text")
    return rows.withColumn("last", F.lit(0)).unionByName(heads).withColumn("next_text", F.lead("text").over(order)).where("last = 0").drop("chunk", "last")


def compare_with_edit(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and edited_sections of every document.

    edited_sections has the numbers (from 0, comma-joined) of the sections that the edited text lacks; equal roots
    have none. The edited text has its last third replaced by the start of the next document. A null text counts as empty; an
    empty text has a root but no paragraphs; a table of one document has itself for the next. Repeated rows are kept.
    """
    cut = F.floor(F.length("text") / 3).cast("int")
    rows = with_next(docs).select(
        "doc_id", "text", "next_text", F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 3) as int))"), F.col("next_text").substr(F.lit(1), cut)).alias("edited")
    )
    trees = rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        paragraphs(F.col("text")).alias("a"),
        paragraphs(F.col("edited")).alias("b"),
        paragraphs(F.col("next_text")).alias("c"),
    )
    seen = trees.select("*", *(short(F.col(x)).alias(f"s{x}") for x in "abc"), *(sections(F.col(x)).alias(f"t{x}") for x in "ab"))
    return seen.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("a"), F.col("ta")).alias("fingerprint"),
        fingerprint(F.col("b"), F.col("tb")).alias("edited_fingerprint"),
        likeness(F.col("sa"), F.col("sb")).alias("near_edited"),
        likeness(F.col("sa"), F.col("sc")).alias("near_next"),
        F.array_join(edited_branches(F.col("ta"), F.col("tb")), ",").alias("edited_sections"),
    )
