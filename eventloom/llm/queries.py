"""The registered queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from eventloom.llm import bpe_codec, embedding_dedup, exact_dedup, filter_audit, jaccard_join, language_model, license_scan, packing, prefix_trie, quality, quotation, substring_dedup, token_counts
from eventloom.llm.oracles import ORACLES

#: Folder of the public tokenizer files; the same on every machine of the cluster.
TOKENIZERS = os.path.dirname(public_tokenizers.path("word_bpe_49k.json"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.per_document(jaccard_join.ngram_jaccard_join(table(spark, sf_dir, "documents")))


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.per_document(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.per_document(table(spark, sf_dir, "documents"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.per_vector(table(spark, sf_dir, "embeddings"))


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.per_document(table(spark, sf_dir, "documents"))


def op7_quotation_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotation.format_chat(table(spark, sf_dir, "conversations"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.per_document(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.per_document(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.per_document(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.per_node(table(spark, sf_dir, "conversations"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.per_document(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_bpe_codec": op2_bpe_codec,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_license_scan": op4_license_scan,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_language_model": op6_language_model,
    "op7_quotation_chat": op7_quotation_chat,
    "op8_quality": op8_quality,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_token_counts": op13_token_counts,
}

__all__ = ["ORACLES", "QUERIES", "TOKENIZERS", "table"]
