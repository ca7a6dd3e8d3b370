"""The subpackage's queries over whole tables and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm import alignment, embedding_dedup, jaccard_join, lexical, merkle, mixing, oracles, pii, quality, segmentation, sharding, substring_dedup, toxicity, urls


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document. Null texts count 0 words; a null source is the last; an empty table gives no rows."""
    got = mixing.mix(_read(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("size") * F.col("times")).alias("taken"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and head of every vector at cosine 0.98. Vectors that are null, zero or not finite, and null labels, link with nothing."""
    return embedding_dedup.link(_read(spark, sf_dir, "embeddings"), threshold=0.98).drop("recall")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page. A null url has empty parts and no rule."""
    return urls.filter_urls(_read(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text; empty and null ones are scored by the constant. Without labels of both kinds all scores are 0."""
    return toxicity.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every text: ids, digest, probability and inclusion. Null and empty texts have one without ids."""
    return segmentation.encode(_read(spark, sf_dir, "documents"), k=2, with_ids=True)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text: counts, a digest of the base spans, and all spans with disclosing terms. Null texts have none."""
    return pii.report(pii.find(_read(spark, sf_dir, "documents")))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document, how many of them repeat earlier windows of 20, and a digest of the others. Null texts have none."""
    return substring_dedup.parse(_read(spark, sf_dir, "documents")).drop("factors")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle fingerprints of every text and its edited form, their likeness, and the sections edited. Null texts are empty."""
    return merkle.compare_with_edit(_read(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and place of every document by doc_id, and its shard after one more is added and after rebalancing. Null texts have size 1."""
    return sharding.assign(_read(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every document's set of four-word shingles and its component at 0.85. Documents without words are their own."""
    return jaccard_join.join(_read(spark, sf_dir, "documents"), size=4, num=17, den=20).drop("class_id")


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text; null and empty ones are scored as an empty text. Without labels of both kinds all are kept."""
    return quality.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents of every benchmark item. Null texts match nothing; items without terms have no rows."""
    return lexical.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers' tokens in every document. Null and empty texts have none."""
    return alignment.align(_read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_embedding_dedup, op3_url_filter, op4_toxicity, op5_sentencepiece, op6_pii, op7_substring_dedup, op8_fingerprints, op9_sharding, op10_jaccard_join, op11_quality, op12_lexical_search, op13_token_alignment)}
ORACLES = oracles.SQL
