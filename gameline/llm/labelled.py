"""A bounded sample of labelled rows to fit a classifier on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gameline.llm.common import fold, texts


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, label and extra columns of at most ``rows`` labelled ids, chosen by a hash of the id.

    Only ids whose crc32 modulo 5 is not 0 are taken; null ids and labels are not labelled rows, and of
    several labels of an id the largest counts.
    """
    known = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold(F.col("doc_id")) != 0))
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("_label"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *extra)
    return given.join(F.broadcast(known), "doc_id")  # at most ``rows`` rows


def collected(rows: DataFrame, features: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> list[dict]:
    """Features of the training rows, in an order that does not depend on the partitioning."""
    found = rows.mapInArrow(features, schema).toArrow().to_pylist()
    return sorted(found, key=lambda r: (r["doc_id"], r["part"]))


def scored(docs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """What a scoring task reads: doc_id, text and extra columns of every row."""
    return texts(docs) if not extra else docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *extra)
