"""The corpus pipeline: quality, exact copies, near copies, mixture, sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next stage's documents.  All stages but the last return the columns of ``documents``; the last returns
the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gameline.llm import banded_jaccard, factor_machine, mixing, packing, radix_dedup
from gameline.llm.common import ship, stored, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine, fitted on the labels of these documents, does not reject."""
    machine = factor_machine.train(docs, table(spark, sf_dir, "labels"))
    return factor_machine.keep_good(docs, machine)


def no_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest doc_id."""
    return radix_dedup.deduplicate(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents linked by a 5-gram Jaccard similarity of 0.8 or more, the one with the smallest doc_id."""
    return banded_jaccard.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture draws them, in the order of the mixture."""
    order = ["mix_key", "mix_pass", "doc_id"]
    return mixing.mix(docs).repartitionByRange("mix_key").sortWithinPartitions(*order).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens, in the order of the mixture."""
    return packing.digested(packing.pack(docs))


STAGES = [("quality", good_quality), ("exact_dedup", no_copies), ("near_dedup", no_near_copies), ("mix", mixed), ("pack", packed)]

# A fitted classifier and a tokenizer are not expressible in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(ship(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
