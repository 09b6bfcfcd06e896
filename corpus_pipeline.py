"""Cleaning and packing a corpus: quality filter, exact dedup, near dedup, substring dedup,
packing. Each stage takes what the one before kept and returns documents again, the last
returns packed pieces. Needs eventloom.llm.

Defined results, of every stage: an empty table gives no rows; columns beyond those of documents
are left out, whatever their names; rows without an id are rows like others, and of rows to choose
from they come last; rows of one id stand or fall each by its own text. Null and blank texts
are empty ones: the classifier scores them, exact dedup keeps one of them, near dedup and
substring dedup leave them, and packing gives them their end mark. Without usable labels the
classifier keeps every row. Texts of any length are worked on whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import exact_dedup, jaccard_join, packing, quality, substring_dedup
from eventloom.llm.common import written
from eventloom.llm.queries import TOKENIZERS

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns as in op8 and scores every text. Rows
    of an id with several texts stand or fall each by its own text."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.accepted(docs, labels).select(*COLUMNS)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal normalised texts."""
    return exact_dedup.kept_rows(docs).select(*COLUMNS)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, that of the smallest id."""
    return jaccard_join.kept_rows(docs).select(*COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages; texts that lose nothing stay as they are, those that
    lose every word go."""
    return substring_dedup.cleaned_rows(docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    return packing.pack_documents(docs, f"{TOKENIZERS}/byte_bpe_50k.json")


STAGES = [("quality", keep_good), ("exact_dedup", drop_exact), ("near_dedup", drop_near), ("substring_dedup", drop_repeats), ("packing", pack)]

#: The quality model and the packing plan are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
