"""The cleaning pipeline: five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is
written as Parquet and read again as the next one's documents.

Defined cases: a null text has no words, so the quality rules reject it; an empty table stays
empty through all stages; without labels only the base rule rejects; rows with one id are
judged each by the quality rules and together by all later stages; other columns of the
documents, whatever their names, stay up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storyloom.llm import blocks, decontamination, line_dedup, quality_rules, simhash
from storyloom.llm.queries import pack_documents, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules accept."""
    return quality_rules.accepted(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that several of them share."""
    return line_dedup.without_shared_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: fingerprints of five-word shingles that agree in 58 of 64 bits or more."""
    return simhash.one_of_each(docs, words=5, most=6)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences."""
    return pack_documents(docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: SQL can't tokenize; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = blocks.stored(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
