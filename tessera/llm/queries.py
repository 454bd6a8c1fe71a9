"""The queries of this subpackage, over the test tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import alignment, bm25, byte_bpe, collocations, licenses, masked_lm, mixing, quality_rules, simhash, suffix_dedup, token_frames, toxicity, warc
from tessera.session import ship


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = mixing.mixing_rates(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rates.select("doc_id", *mixing.ADDED)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.remove_repeats(_documents(spark, sf_dir)))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality_rules.quality_scores(_documents(spark, sf_dir))
    return scores.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_bm25_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.search_documents(_documents(spark, sf_dir))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_documents(spark, sf_dir)).select("doc_id", *licenses.ADDED)


def op7_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_frames.write_tokens(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), 2, token_frames.new_folder(spark))
    return token_frames.digests(token_frames.read_tokens(files))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = byte_bpe.encode_documents(_documents(spark, sf_dir), ranks, public_tokenizers.PATTERN)
    return byte_bpe.digests(byte_bpe.decode_documents(encoded, ranks))


def op9_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.score_documents(_documents(spark, sf_dir))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_documents(spark, sf_dir))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record a page in a content-addressed archive, read back, rebuilt by joins and parsed."""
    ship(spark)
    archive = warc.write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), warc.new_folder(spark))
    return warc.digests(warc.resolved(warc.parsed(warc.records(archive))))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tokenizers over every text, cut where tokens of both end, with counts of linked ids."""
    found = alignment.link_statistics(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of two to four words of each language."""
    return collocations.collocations(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_mixing, op3_suffix_dedup, op4_quality_rules, op5_bm25_top_k, op6_license_scan, op7_token_frames, op8_byte_bpe, op9_masked_lm, op10_simhash_near_dedup, op11_warc, op12_alignment, op13_collocations)}


def oracle_sql() -> dict[str, str]:
    return {"op4_quality_rules": quality_rules.oracle_sql(), "op6_license_scan": licenses.oracle_sql(), "op11_warc": warc.oracle_sql(), "op13_collocations": collocations.oracle_sql()}
