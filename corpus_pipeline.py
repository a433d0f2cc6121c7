"""A corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

Language identification and quality rules drop the documents that they reject,
the Jaccard join keeps one document of each group of near-duplicates (five-word
shingles, a similarity of 0.8 or more), personal data is replaced by its kind,
and what is left is packed into training sequences.  Rows with a null text have
no language and go at the first stage; rows without an id are never duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm import jaccard, language, packing, pii, quality
from sessionloom.llm.common import settle, table
from sessionloom.llm.queries import tokenizer_path


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a clear language; the dictionaries come from a bounded labelled sample of the same documents."""
    return language.keep_known(docs, language.learn(language.sample_of(docs)))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep."""
    return quality.keep_good(docs)


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates."""
    return jaccard.keep_one(docs)


def privacy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data replaced; n_chars counts the new text."""
    text = pii.redacted(F.col("text"))
    return docs.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("language", language_stage), ("quality", quality_stage), ("duplicates", duplicate_stage),
          ("privacy", privacy_stage), ("packing", packing_stage)]

#: Compression, the trees and the packing plan have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
