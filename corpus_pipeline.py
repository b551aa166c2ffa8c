"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stylotrace.llm import bpe, curriculum, exact, jaccard, quality
from stylotrace.llm.queries import WORD_BPE
from stylotrace.session import shared_dir


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact.drop_copies(docs, exact.half_of_ids())


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: shingles of five words, similarity of 0.8 or more."""
    return jaccard.one_of_each(docs, width=5, threshold=80)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix of sources reads them, in the order of training."""
    return curriculum.mixed(docs)


def encode_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens of every document, with the digests of the ids and of their decoded text."""
    return bpe.round_trip(docs, bpe.load_model(WORD_BPE))


STAGES = [
    ("quality", good_documents),
    ("exact_dedup", without_copies),
    ("near_copies", without_near_copies),
    ("mix", mixed_documents),
    ("bpe", encode_documents),
]

# Token ids and the quality model cannot be computed in SQL. tests/llm holds the run against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_dir(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
    return docs
