"""From raw documents to token ids: toxic documents go, one of each group of near-duplicates stays, sources are mixed to
target weights, and what is left is encoded. Every stage is written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from planloom.llm import bpe, mixing, near_dedup, toxicity
from planloom.llm.common import table
from planloom.llm.queries import VOCABULARY
from planloom.staging import Stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fits on the labelled documents that are not held out and drops the documents of a score of 0.3 or more."""
    return toxicity.clean_only(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each class: five-word shingles, similarity 0.8 or more."""
    return near_dedup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples the documents so that tokens by source, language and topic come in the target proportions."""
    return mixing.sample(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text, and the ids themselves (32-bit little-endian)."""
    encoded = bpe.encode(docs, VOCABULARY, decoded=True)
    return bpe.digests(encoded, "ids")


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("mixing", mix_sources), ("bpe", encode)]

#: Training, connected components and BPE are not expressible in SQL; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage, docs = Stage(spark, "pipeline"), table(spark, sf_dir, "documents")
    for _, step in STAGES:
        docs = stage.write(step(spark, docs, sf_dir))
    return docs
