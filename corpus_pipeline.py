"""A corpus pipeline of five stages: toxic documents go, near-duplicates go, personal data is rewritten, sources are mixed to weight, texts are encoded.

Each stage is (spark, docs, sf_dir) -> DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logweave.llm import jaccard_join, mixing, pii, segmentation, toxicity
from logweave.llm.graph import fresh_path, remove
from logweave.ship import ship

#: The stages rest on hashes and fitted models that SQL lacks; tests hold run() against a brute-force version.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic by the model fitted on the labelled ones among them.

    Each row is judged by its own text: null and empty ones by the constant, repeated ones alike, whatever their
    doc_id. Without labels of both kinds, or of an empty table, all stay.
    """
    ship(spark)
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates (five-word shingles, similarity 0.8) the smallest doc_id; of its repeated rows the one of least text.

    Documents without words and rows with a null doc_id all stay. An empty table stays empty.
    """
    ship(spark)
    return jaccard_join.one_of_each(docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that disclose it replaced in every text; n_chars follows.

    Null and empty texts stay as they are, repeated rows get equal texts. An empty table stays empty.
    """
    ship(spark)
    return pii.sanitise(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes.

    A null source is one of its own. Documents without words are as long as nothing and repeated with their source's
    others. An empty table stays empty.
    """
    ship(spark)
    return mixing.repeated(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of one sampled segmentation of each document, another for each of its copies, and what tells its samples apart.

    Null and empty texts have no ids; all rows are returned. An empty table stays empty.
    """
    ship(spark)
    return segmentation.encode(docs, k=2, with_ids=True, copies=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("PII", sanitise),
    ("mixing", mix_sources),
    ("SentencePiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next.

    Every call writes to a folder of its own in the shared one. What a stage wrote goes once the next has written; the
    last stage is computed when the result is read, so its input stays.
    """
    home, docs = fresh_path(spark, "corpus-pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for i, (_, stage) in enumerate(STAGES[:-1]):
        path = f"{home}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
