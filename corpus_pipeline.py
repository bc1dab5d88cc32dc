"""A training corpus from documents: judge quality, drop copies and near copies, mix sources, and tokenise."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from emberline.llm import exact_dedup, mixing, quality, simhash
from emberline.llm.common import ensure_checkpoint_dir
from emberline.llm.queries import learnable, table, tokens


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.drop_rejected(docs, table(spark, sf_dir, "labels"), learnable)


def no_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_exact_copies(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose sets of five-word shingles have a similarity of 0.8 or more."""
    return simhash.drop_near_copies(docs, width=5, similarity=0.8)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.take_mix(docs)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document, and whether decoding gives its text."""
    return tokens(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", no_exact_copies),
    ("SimHash near-dedup", no_near_copies),
    ("mixing sources", mixed_sources),
    ("SentencePiece", tokenised),
]

#: SQL can't express the classifier, the fingerprints and the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet in the shared checkpoint folder and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
