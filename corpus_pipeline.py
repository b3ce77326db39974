"""Corpus pipeline: quality rules, near-dedup, pseudonyms, mixing and tokens over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spikeloom.llm import minhash, mixing, pieces, pii, quality
from spikeloom.llm.warc import shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and the classifier, which is fitted on the labelled ones among them; null texts fail."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of least doc_id, of each class of near-duplicates; rows without a doc_id are in no class and stay."""
    return minhash.keep_one(docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data replaced; null texts stay null."""
    return pii.pseudonymised(docs, count=None)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each document and pass over it, with the words taken; texts without a word are never taken."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their piece ids, off the relational lattice; null and empty texts have none."""
    return pieces.encoded_relational(docs)


STAGES = [("quality", quality_rules), ("near_dedup", near_dedup), ("pii", pseudonyms), ("mix", mix), ("tokens", tokens)]

#: The classifier, the hashed bands and the draws of the mix are no SQL: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what each returns is written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
