"""Exact top-k by inner product over a vector-approximation file.

The index is a table of blocks.  A block holds up to ``BLOCK_ROWS`` vectors of integers, the bounds of
``2^BITS`` equally filled cells in each dimension, and for each component the number of its cell: one
byte where the vector has eight.  For a query and a cell the largest and smallest product with any value
of the cell are known, and their sums over the dimensions bound the score.

A task gets one block of vectors and one block of queries.  It scans the cells for the bounds of every
pair, takes the k-th largest lower bound of each query as a floor, and reads exact vectors in descending
order of the upper bound (for distances: ascending lower bound) until the k-th exact score is above the
next upper bound; equal bounds are read on, since ties go to the smaller id.  The best k of each block
are merged by rank.  Every vector is indexed and every pair of blocks is met: nothing is sampled.

Vectors are ``floor(scale * x)`` of each component as a double.  Null vectors and vectors that hold null
or non-finite components take no part, nor do rows with a null id; vectors of another length than a
query's are no candidates for it.  Repeated rows are separate candidates.  An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gameline.llm.common import stored, table

SCALE = 256
BITS = 6
BLOCK_ROWS = 4096
QUERY_ROWS = 1024

INDEX = "block long, size int, rows int, vec_ids binary, cells binary, edges binary, exact binary, kind string"
FOUND = "query_id long, vec_id long, score long"


def integer_vectors(vectors: DataFrame, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v: array of longs, of the rows that take part."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")))
    return (vectors.where(x.isNotNull() & F.col(id_col).isNotNull() & finite & (F.size(x) > 0))
            .select(F.col(id_col).cast("long").alias("vec_id"),
                    F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v")))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.int64)


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of equal keys in rows that come in order."""
    now, held = None, []
    for batch in batches:
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        if not batch.num_rows:
            continue
        change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        for a, b in zip([0, *change], [*change, batch.num_rows]):
            key = tuple(int(c[a]) for c in columns)
            if key != now and held:
                yield now, pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


def _index(batches: Iterator[pa.RecordBatch], bits: int, block_rows: int) -> Iterator[pa.RecordBatch]:
    """Blocks of one vector length each, from rows in order of (size, block)."""
    for (size, block), rows in _groups(batches, ("size", "block")):
        rows = rows.combine_chunks()
        exact, ids = _matrix(rows.column("v").chunk(0)), rows.column("vec_id").to_numpy()
        for at in range(0, len(ids), 2 * block_rows):  # a block is uneven by chance only; it is halved if twice as full
            v, own = exact[at:at + 2 * block_rows], ids[at:at + 2 * block_rows]
            cuts = np.sort(v, axis=0)[np.linspace(0, len(v) - 1, 2 ** bits + 1).astype(int)].T  # size x (cells + 1)
            kind = next(t for t in ("<i2", "<i4", "<i8") if np.iinfo(t).min <= v.min() and v.max() <= np.iinfo(t).max)
            cells = np.empty(v.shape, dtype=np.uint8)
            for d in range(size):
                cells[:, d] = np.clip(np.searchsorted(cuts[d], v[:, d], side="right") - 1, 0, 2 ** bits - 1)
            yield pa.record_batch([pa.array([block]), pa.array([size], pa.int32()), pa.array([len(own)], pa.int32()),
                                   pa.array([own.astype("<i8").tobytes()], pa.binary()), pa.array([cells.tobytes()], pa.binary()),
                                   pa.array([cuts.astype("<i8").tobytes()], pa.binary()),
                                   pa.array([v.astype(kind).tobytes()], pa.binary()), pa.array([kind])],
                                  names=["block", "size", "rows", "vec_ids", "cells", "edges", "exact", "kind"])


def build(vectors: DataFrame, bits: int = BITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The index of integer vectors (vec_id, v), one row per block, written to the shared folder."""
    counts = F.broadcast(vectors.groupBy(F.size("v").alias("size")).agg(  # one row per vector length
        F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).alias("blocks")))
    dealt = (vectors.withColumn("size", F.size("v")).join(counts, "size")
             .withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks"))))
    rows = dealt.select("size", "block", "vec_id", "v").repartition("size", "block").sortWithinPartitions("size", "block", "vec_id")
    return stored(rows.mapInArrow(partial(_index, bits=bits, block_rows=block_rows), INDEX), "va-file")


def scan_block(queries: np.ndarray, own: np.ndarray, ids: np.ndarray, cells: np.ndarray, edges: np.ndarray,
               exact: np.ndarray, k: int) -> tuple[list[tuple[int, int, int]], int]:
    """The k best of a block for each query as (row of the query, id, score), and how many vectors were read."""
    low, high = (np.take_along_axis(e, cells.astype(np.int64).T, axis=1).T.astype(np.float64)
                 for e in (edges[:, :-1], edges[:, 1:]))
    plus, minus = np.maximum(queries, 0).astype(np.float64), np.minimum(queries, 0).astype(np.float64)
    # sums of integers far below 2^53, so the bounds are exact
    upper = plus @ high.T + minus @ low.T
    floor = plus @ low.T + minus @ high.T
    same = own[:, None] == ids[None, :]
    upper[same], floor[same] = -np.inf, -np.inf
    out, read, least = [], 0, min(k, len(ids))
    starts = np.partition(floor, len(ids) - least, axis=1)[:, len(ids) - least]
    for q in range(len(queries)):
        near = np.flatnonzero((upper[q] >= starts[q]) & (upper[q] > -np.inf))
        near = near[np.argsort(-upper[q, near], kind="stable")]
        best: list[tuple[int, int]] = []
        for at in range(0, len(near), 32):
            if len(best) == k and upper[q, near[at]] < best[-1][0]:
                break
            some = near[at:at + 32]
            read += len(some)
            best += zip((exact[some] @ queries[q]).tolist(), ids[some].tolist())
            best = sorted(best, key=lambda x: (-x[0], x[1]))[:k]
        out += [(q, i, score) for score, i in best]
    return out, read


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Pairs of a query block and an index block; the index row comes first."""
    for _, rows in _groups(batches, ("size", "block", "query_block")):
        rows = rows.combine_chunks()
        is_index = rows.column("rows").is_valid()
        index, asked = rows.filter(is_index).to_pylist(), rows.filter(pc.invert(is_index))
        if not index or not asked.num_rows:
            continue
        queries, own = _matrix(asked.column("v").combine_chunks()), asked.column("vec_id").to_numpy()
        for part in index:
            n, size = part["rows"], part["size"]
            ids = np.frombuffer(part["vec_ids"], dtype="<i8")
            cells = np.frombuffer(part["cells"], dtype=np.uint8).reshape(n, size)
            edges = np.frombuffer(part["edges"], dtype="<i8").reshape(size, -1)
            exact = np.frombuffer(part["exact"], dtype=part["kind"]).reshape(n, size).astype(np.int64)
            for at in range(0, len(own), 256):
                found, _ = scan_block(queries[at:at + 256], own[at:at + 256], ids, cells, edges, exact, k)
                if found:
                    q, i, s = zip(*found)
                    yield pa.record_batch([pa.array(own[at:at + 256][list(q)]), pa.array(i, pa.int64()), pa.array(s, pa.int64())],
                                          names=["query_id", "vec_id", "score"])


def top_k(index: DataFrame, queries: DataFrame, k: int = 5, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of the indexed vectors for each query (vec_id, v).

    Vectors with the query's own id are left out; of several queries with one id the largest vector is asked.
    """
    queries = queries.groupBy("vec_id").agg(F.max("v").alias("v"))
    sizes = queries.groupBy(F.size("v").alias("size")).agg(
        F.ceil(F.count(F.lit(1)) / F.lit(query_rows)).alias("query_blocks"))
    blocks = index.select("size", "block").distinct()
    asked = (queries.withColumn("size", F.size("v")).join(F.broadcast(sizes), "size")  # one row per vector length
             .withColumn("query_block", F.pmod(F.xxhash64("vec_id"), F.col("query_blocks"))).drop("query_blocks"))
    # every pair of blocks is met once: the queries go to each block, the blocks to each group of queries
    spread = blocks.groupBy("size").agg(F.max("block").alias("last"))
    asked = (asked.join(F.broadcast(spread), "size")
             .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last")))).drop("last"))
    parts = (index.join(F.broadcast(sizes), "size")
             .withColumn("query_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("query_blocks") - 1))).drop("query_blocks"))
    pairs = parts.unionByName(asked, allowMissingColumns=True)
    key = ["size", "block", "query_block"]
    found = pairs.repartition(*key).sortWithinPartitions(*key).mapInArrow(partial(_search, k=k), FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (found.withColumn("rank", rank).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def is_query(id_col: Column) -> Column:
    return id_col % 50 == 0


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(build(vectors), vectors.where(is_query(F.col("vec_id"))))


OP4_SQL = """WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""

QUERIES = {"op4_va_file": (op4, OP4_SQL)}
