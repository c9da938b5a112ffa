"""Exact duplicates by most-significant-digit radix partitioning; no digest decides equality.

Texts are told apart by their length in bytes and then by successive bytes, taken in digits of a few
bytes.  A group whose texts have ended, or that has one text left, needs no further digit.

1. Inside each batch of the scan, texts are split down to groups of equal ones.  One row of each such
   group goes on, so a text that fills a third of the table goes on once per batch.
2. The rows are shuffled by length and first digit.  A task meets each group in order and splits it in
   memory down to equal texts.  A group of more than ``GROUP_BYTES`` is not held: its rows go to the
   next round, which shuffles them by the next, longer digit.  Texts that have ended are equal, however
   many they are.
3. The row with the largest id of each group is found by a plain aggregation, and every row gets it by
   two joins in which a key has at most as many rows as a scan batch.

Null and empty texts are equal.  Among rows of equal text and id one stays; a null id is smaller than
any other.  Every row of the input comes back; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gameline.llm.common import stored, table

DIGIT = 64
GROUP_BYTES = 32 << 20
ROWS_A_TASK = 1 << 40


def equal_groups(texts: Sequence[bytes], depth: int = 0, digit: int = 16) -> list[list[int]]:
    """Positions of equal texts, by successive digits of growing width; texts agree up to ``depth``."""
    by_length: dict[int, list[int]] = {}
    for i, text in enumerate(texts):
        by_length.setdefault(len(text), []).append(i)
    done, open_groups = [], [(g, n, depth, digit) for n, g in by_length.items()]
    while open_groups:
        group, length, at, width = open_groups.pop()
        if len(group) == 1 or at >= length:
            done.append(group)
            continue
        parts: dict[bytes, list[int]] = {}
        for i in group:
            parts.setdefault(texts[i][at:at + width], []).append(i)
        open_groups += [(g, length, at + width, width * 2) for g in parts.values()]
    return done


def _collapse(batches: Iterator[pa.RecordBatch], carry: list[str]) -> Iterator[pa.RecordBatch]:
    """Name every row, and keep the text only on one row of each group of equal texts of the batch."""
    first = TaskContext.get().partitionId() * ROWS_A_TASK
    for batch in batches:
        texts, ids = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
        stands_for, alike, kept = np.empty(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64), [None] * len(texts)
        for group in equal_groups(texts):
            best = max(group, key=lambda i: (ids[i] is not None, ids[i] or 0, i))
            stands_for[group] = first + best
            alike[best], kept[best] = len(group), texts[best]
        columns = [np.arange(first, first + len(texts)), batch.column("doc_id"), stands_for, alike,
                   pa.array(kept, pa.binary()), *[batch.column(c) for c in carry]]
        yield pa.record_batch(columns, names=["row_no", "doc_id", "stands_for", "alike", "text", *carry])
        first += len(texts)


_PENDING = "row_no long, set_row long, group long, text binary"


def _split(batches: Iterator[pa.RecordBatch], depth: int, digit: int, group_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of (group, length, digit) to sets of equal texts, or to smaller groups for the next round."""
    out: list[tuple] = []
    key, first, held, size, over = None, None, [], 0, False

    def close() -> None:
        for equal in equal_groups([t for _, t in held], depth):
            out.extend((held[i][0], held[equal[0]][0], None, None) for i in equal)
        held.clear()

    def rows() -> pa.RecordBatch:
        found = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                                names=["row_no", "set_row", "group", "text"])
        out.clear()
        return found

    waiting = 0
    for batch in batches:
        for row, group, text in zip(*(batch.column(c).to_pylist() for c in ("row_no", "group", "text"))):
            here = (group, len(text), text[depth:depth + digit])
            if here != key:
                close()
                key, first, size, over = here, row, 0, False
            if depth + digit >= len(text):  # ended: all rows of this key are equal
                out.append((row, first, None, None))
            elif over:
                out.append((row, None, first, text))
                waiting += len(text)
            else:
                held.append((row, text))
                size += len(text)
                if size > group_bytes and len(held) > 1:
                    over = True
                    out.extend((r, None, first, t) for r, t in held)
                    waiting += size
                    held.clear()
            if len(out) >= 5000 or waiting > 8 << 20:
                yield rows()
                waiting = 0
    close()
    if out:
        yield rows()


def radix_sets(rows: DataFrame, group_bytes: int = GROUP_BYTES, digit: int = DIGIT) -> DataFrame:
    """row_no, set_row of rows (row_no, text as bytes): rows of one set, and only they, have equal texts."""
    pending, depth, found = rows.select("row_no", F.lit(0).cast("long").alias("group"), "text"), 0, []
    while True:
        key = ["group", F.octet_length("text"), F.substring("text", depth + 1, digit)]
        ordered = pending.repartition(*key).sortWithinPartitions(*key)
        split = stored(ordered.mapInArrow(partial(_split, depth=depth, digit=digit, group_bytes=group_bytes), _PENDING),
                       "radix-round")
        found.append(split.where(F.col("set_row").isNotNull()).select("row_no", "set_row"))
        pending = split.where(F.col("set_row").isNull()).select("row_no", "group", "text")
        if pending.isEmpty():
            return reduce(DataFrame.unionByName, found)
        depth, digit = depth + digit, digit * 4


def _grouped(docs: DataFrame, carried: dict[str, str], id_col: str, text_col: str, group_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Every row with its group, and the stored rows, whose text is null on some that do not stay; ``carried``: new name to old."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"),
                       *[F.col(c).alias(n) for n, c in carried.items()])
    kinds = "".join(f", {n} {rows.schema[n].dataType.simpleString()}" for n in carried)
    named = stored(rows.mapInArrow(partial(_collapse, carry=list(carried)),
                                   "row_no long, doc_id long, stands_for long, alike long, text binary" + kinds), "radix-rows")
    first = named.where(F.col("alike") > 0)
    sets = (radix_sets(first.select("row_no", "text"), group_bytes)
            .join(first.select("row_no", "doc_id", "alike"), "row_no"))
    best = sets.groupBy("set_row").agg(F.max(F.struct("doc_id", "row_no")).alias("best"), F.sum("alike").alias("group_size"))
    answer = (sets.select("row_no", "set_row").join(best, "set_row")
              .select(F.col("row_no").alias("stands_for"), F.col("best.doc_id").alias("keep_id"),
                      F.col("best.row_no").alias("keep_row"), "group_size"))
    marked = named.join(answer, "stands_for").select(
        "row_no", "doc_id", "keep_id", "group_size", (F.col("row_no") == F.col("keep_row")).alias("kept"), *carried)
    return marked, named.select("row_no", F.col("text").cast("string").alias("text"), "doc_id", *carried)


def duplicates(docs: DataFrame, carry: Sequence[str] = (), id_col: str = "doc_id", text_col: str = "text",
               group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept and the carried columns of every row."""
    carried = {f"_carry{i}": c for i, c in enumerate(carry)}
    marked, _ = _grouped(docs, carried, id_col, text_col, group_bytes)
    return marked.select("doc_id", "keep_id", "group_size", "kept", *[F.col(n).alias(c) for n, c in carried.items()])


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns; a null text comes back empty."""
    carried = {f"_carry{i}": c for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    marked, rows = _grouped(docs, carried, "doc_id", "text", GROUP_BYTES)
    stay = rows.where(F.col("text").isNotNull()).join(marked.where("kept").select("row_no"), "row_no", "left_semi")
    return stay.select("doc_id", "text", *[F.col(n).alias(c) for n, c in carried.items()]).select(docs.columns)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return duplicates(docs.withColumn("text_sha256", digest), ["text_sha256"])


OP5_SQL = """SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"""

QUERIES = {"op5_radix_dedup": (op5, OP5_SQL)}
