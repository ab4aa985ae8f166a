"""From raw documents to token statistics of a clean corpus, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and sets the session's batches to smaller bounds. All but
the last return the columns of documents. SQL cannot express the model's perplexity, so ORACLE_SQL is None.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual.llm import decontaminate, near_dups, pii, quality_model, trie_bpe
from punctual.llm.common import bounded_batches, stored, table
from punctual.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model of trusted text doesn't reject."""
    bounded_batches(spark)
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality_model.filtered(docs, trusted).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    bounded_batches(spark)
    return near_dups.deduplicated(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than 5 % of the words stand in benchmark windows."""
    bounded_batches(spark)
    return decontaminate.cleaned(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and what discloses it replaced."""
    bounded_batches(spark)
    return pii.redacted(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of all documents, encoded and decoded again."""
    bounded_batches(spark)
    return trie_bpe.round_trip_digest(docs, tokenizer_path())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("privacy", privacy), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
