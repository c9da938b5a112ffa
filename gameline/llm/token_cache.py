"""Token counts through a digest cache.

The cache is a table ``tokenizer_digest, content_digest, n_tokens``: the SHA-256 of the tokenizer
file and of the text in UTF-8.  A run joins the digests of its texts to the cache, encodes each
distinct text that is missing once, appends the new counts, and joins again.  A count depends on
every byte, so content is normalised no further than null to empty.

Appending is a plain Spark append: a failed run adds nothing, and two runs that miss the same text
at the same time append equal rows, which reading folds into one.

Every row of the input comes back, repeated rows and null ids included; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gameline.llm.common import new_folder, stored, table, texts
from gameline.llm.encoding import encoder, tokenizer_path

CACHE = "tokenizer_digest string, content_digest binary, n_tokens long"


def _count(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
        sizes = [len(ids) // 4 for ids in encoder(tokenizer).encode(batch.column("text").to_pylist())]
        yield pa.record_batch([batch.column("content_digest"), pa.array(np.array(sizes, dtype=np.int64))],
                              names=["content_digest", "n_tokens"])


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def read_cache(spark: SparkSession, cache: str, tokenizer_digest: str) -> DataFrame:
    """The counts stored for one tokenizer, one row per text."""
    rows = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer_digest") == tokenizer_digest)
    return rows.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, cache: str, tokenizer: str | None = None, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row; ``cache`` is the folder of the cache table, made when absent."""
    spark, tokenizer = docs.sparkSession, tokenizer or tokenizer_path()
    version = file_digest(tokenizer)
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)  # so that there is a table to read
    rows = texts(docs, id_col, text_col)
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("content_digest")
    missing = (rows.select(digest, "text")
               .join(read_cache(spark, cache, version), "content_digest", "left_anti")
               .dropDuplicates(["content_digest"]))
    new = missing.mapInArrow(partial(_count, tokenizer=tokenizer), "content_digest binary, n_tokens long")
    (new.select(F.lit(version).alias("tokenizer_digest"), "content_digest", "n_tokens")
     .write.mode("append").parquet(cache))
    sized = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), digest)
    # a plain table on this side lets Spark split a digest that many rows share
    known = stored(read_cache(spark, cache, version), "known-counts")
    return (sized.join(known, "content_digest", "left")
            .select("doc_id", "n_bytes", "n_tokens", "content_digest"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(table(spark, sf_dir, "documents"), new_folder(spark, "token-cache"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


QUERIES = {"op6_token_cache": (op6, None)}
