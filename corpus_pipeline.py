"""A corpus pipeline of five stages over documents; each stage's rows are the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import byte_bpe, mixing, quality_rules, simhash, suffix_dedup
from tessera.session import cut, ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null and empty texts go, an empty table gives none."""
    ship(spark)
    return quality_rules.quality_rules(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest doc_id; rows without one give way to any that has."""
    ship(spark)
    return simhash.simhash_dedup(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without long strings that an earlier one has; null texts become empty."""
    ship(spark)
    return suffix_dedup.suffix_dedup(docs)


#: Factors of the shares of tokens that the stage's own input has: half of what reads toxic, the rest in proportion.
SCALE = {"toxic": 0.5}


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights ask. Without labels all documents stay as they are."""
    ship(spark)
    return mixing.mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), SCALE, relative=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids) of every row, repeated ones too; null and empty texts have no ids."""
    ship(spark)
    return byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_dedup),
    ("suffix_dedup", repeats),
    ("mixing", mixing_stage),
    ("byte_bpe", encode),
]

#: Hashes, covering codes and token merges are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
