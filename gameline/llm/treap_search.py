"""Ranked lexical search over K2-treaps of the term-document grid.

The index is a table of blocks.  A block holds the grid of its documents: a row for each term, a column for
each document, and in each cell that is not empty the impact of the term in the document.  The grid is a
square cut into four again and again.  A square keeps the largest impact inside it; empty squares are not
stored, and a square with one point is a leaf however large it is, so chains of single squares collapse.
Squares stand level by level, the children of a square side by side: a mask of four bits for each square
and the count of bits before it lead to them, and maxima are stored as what they lack to their parent's.

A search follows, for each term of an item, the path of the term's row.  All rows of an item descend
together over ranges of documents: a range is as good as the sum of its terms' maxima times their weights,
the best ranges are halved first, and a range of one document has its exact score.  It ends when no range
left reaches the k-th best score known; ranges that equal it are read on, since ties go to the smaller id.
The k best of an item so far are the bound for the next blocks of a task.

Impacts do not depend on the items: with tf occurrences in a document of length factor m they are
``SCALE * tf div (1000 tf + 8 m)``, and a term adds its weight times its impact, all in 64-bit integers.

The blocks are cut from the rows as they are read, so no text is shuffled; one pass finds terms and counts,
totals give the length factors, a second pass builds the squares.  Items are packed into groups, which meet
the blocks in an equi-join on the group's number: by broadcast where all items are measured to be at most
``BROADCAST_BYTES``, else by a shuffle that deals each group over ``SPREAD`` parts.

Null texts hold no terms, null ids are ids of their own and come last among ties.  Repeated rows are
candidates of their own, and repeated items too.  Empty tables give an empty result.  A document of any
length is one column; terms of a text are found in its bytes, where A-Z alone are lowered.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gameline.llm.common import stored, table, texts

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
BETWEEN = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
AT_ONCE = 1 << 20
K = 10
BLOCK_DOCS = 4096
BLOCK_BYTES = 4 << 20
SCALE = 1_000_000_000
GROUP_ITEMS = 256
SPREAD = 64
ROW_GROUP_BYTES = 16 << 20  # of an index file: a few blocks, so that several tasks can read it
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20  # of an Arrow batch between Spark and a task of this index
BROADCAST_BYTES = 8 << 20
WIDE = 64  # ranges halved at once
KEPT_ITEMS = 50_000  # items a task keeps its best documents of before it hands them on
NO_ID = np.iinfo(np.int64).max  # stands for a null id inside a block

GRID = "doc_ids binary, lengths binary, terms array<string>, dfs array<int>, rows binary, cols binary, tfs binary, n_docs long, n_terms long"
BLOCK = "doc_ids binary, terms array<string>, levels binary, masks binary, lacks binary, top long, leaf_rows binary, leaf_cols binary"
HITS = "item long, item_id long, doc_id long, score long"


def terms_of(text: str, at_once: int = AT_ONCE) -> Counter[bytes]:
    """The terms of a text with their numbers, a part of it at a time."""
    data, at = text.encode().lower(), 0
    found: Counter[bytes] = Counter()
    while len(data) - at > at_once:
        cut = BETWEEN.search(data, at + at_once)
        if cut is None:
            break
        found.update(TERM.findall(data, at, cut.start()))
        at = cut.end()
    found.update(TERM.findall(data, at))
    return found


class Points:
    """The points of a block as its documents are read: small arrays for each document, no counter outlives its text."""

    def __init__(self) -> None:
        self.ids: list[int] = []
        self.number: defaultdict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.terms: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held = 0

    def add(self, i: int | None, text: str) -> None:
        found = terms_of(text)
        self.ids.append(NO_ID if i is None else i)
        self.terms.append(np.fromiter(map(self.number.__getitem__, found), np.uint32, len(found)))
        self.counts.append(np.fromiter(found.values(), np.uint32, len(found)))
        self.held += len(text)

    def grid(self) -> dict:
        """Documents in order of their ids, terms in order of their bytes."""
        order = sorted(range(len(self.ids)), key=self.ids.__getitem__)
        sizes = np.array([len(self.terms[i]) for i in order], dtype=np.int64)
        cols = np.repeat(np.arange(len(order), dtype=np.uint32), sizes)
        names = sorted(self.number)
        place = np.empty(len(names), dtype=np.uint32)
        place[np.fromiter((self.number[t] for t in names), np.int64, len(names))] = np.arange(len(names))
        rows = place[np.concatenate([self.terms[i] for i in order])]
        return {"doc_ids": np.array([self.ids[i] for i in order], dtype="<i8"),
                "lengths": np.array([self.counts[i].sum(dtype=np.int64) for i in order], dtype="<i8"), "terms": names,
                "dfs": np.bincount(rows, minlength=len(names)), "rows": rows, "cols": cols,
                "tfs": np.concatenate([self.counts[i] for i in order])}


def _grids(batches: Iterator[pa.RecordBatch], docs: int, size: int) -> Iterator[pa.RecordBatch]:
    points = Points()

    def block() -> pa.RecordBatch:
        g = points.grid()
        terms = pa.array(g["terms"], pa.binary()).cast(pa.string())
        return pa.record_batch([
            pa.array([g["doc_ids"].tobytes()], pa.binary()), pa.array([g["lengths"].tobytes()], pa.binary()),
            pa.ListArray.from_arrays([0, len(terms)], terms), pa.ListArray.from_arrays([0, len(terms)], pa.array(g["dfs"].astype(np.int32))),
            *[pa.array([g[c].astype("<u4", copy=False).tobytes()], pa.binary()) for c in ("rows", "cols", "tfs")],
            pa.array([int((g["lengths"] > 0).sum())], pa.int64()), pa.array([int(g["lengths"].sum())], pa.int64())],
            names=["doc_ids", "lengths", "terms", "dfs", "rows", "cols", "tfs", "n_docs", "n_terms"])

    for batch in batches:
        for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            points.add(i, text.as_py())
            if len(points.ids) == docs or points.held >= size:
                yield block()
                points = Points()
    if points.ids:
        yield block()


def written(df: DataFrame, name: str) -> DataFrame:
    """``stored`` with a few blocks in a row group and in a batch: a task has some of them in memory, however many it works on."""
    conf = df.sparkSession.conf
    before = conf.get(BATCH_SETTING)
    conf.set(BATCH_SETTING, str(BATCH_BYTES))
    try:
        # Parquet's writer would look at the size only after a hundred rows
        return stored(df, name, **{"parquet.block.size": ROW_GROUP_BYTES, "parquet.page.size.row.check.min": 1})
    finally:
        conf.set(BATCH_SETTING, before)


def grids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_docs: int = BLOCK_DOCS,
          block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The points of each block with their counts, written to the shared folder."""
    return written(texts(docs, id_col, text_col).mapInArrow(partial(_grids, docs=block_docs, size=block_bytes), GRID), "grids")


def _interleaved(x: np.ndarray, bits: int) -> np.ndarray:
    """The bits of a number with a zero before each."""
    out = np.zeros(len(x), dtype=np.uint64)
    for b in range(bits):
        out |= ((x >> np.uint64(b)) & np.uint64(1)) << np.uint64(2 * b)
    return out


def treap(rows: np.ndarray, cols: np.ndarray, impacts: np.ndarray) -> dict:
    """The squares of a grid, from the whole to single points."""
    bits = max(1, int(max(rows.max(initial=0), cols.max(initial=0))).bit_length())
    code = (_interleaved(rows.astype(np.uint64), bits) << np.uint64(1)) | _interleaved(cols.astype(np.uint64), bits)
    order = np.argsort(code, kind="stable")
    code, rows, cols, impacts = code[order], rows[order], cols[order], impacts[order]
    starts, ends = np.zeros(1, dtype=np.int64), np.array([len(code)])  # points of the squares of a level
    best = np.array([impacts.max(initial=0)], dtype=np.int64)
    levels, masks, lacks, leaves = [], [], [np.zeros(1, dtype=np.int64)], []
    for level in range(bits + 1):
        open_ = (ends - starts > 1) & (level < bits)
        levels.append(len(starts))
        leaves.append(starts[~open_ & (ends > starts)])
        mask = np.zeros(len(starts), dtype=np.uint8)
        a, b = starts[open_], ends[open_]
        if not len(a):
            masks.append(mask)
            break
        # a point begins a child where its quarter, or its square, is another than that of the point before
        quarter = (code >> np.uint64(2 * (bits - 1 - level))) & np.uint64(3)
        inside = np.repeat(np.arange(len(a)), b - a)
        points = np.arange(len(inside)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)
        q = quarter[points].astype(np.int64)
        first = np.flatnonzero(np.diff(inside * 4 + q, prepend=-1))
        np.bitwise_or.at(mask, np.flatnonzero(open_)[inside[first]], (1 << q[first]).astype(np.uint8))
        top = np.maximum.reduceat(impacts[points], first)
        lacks.append(best[open_][inside[first]] - top)
        masks.append(mask)
        starts, best = points[first], top
        ends = starts + np.diff(np.append(first, len(points)))
    leaf = np.concatenate(leaves)
    return {"levels": np.array([bits, *levels]), "masks": np.concatenate(masks), "lacks": np.concatenate(lacks),
            "top": int(impacts.max(initial=0)), "leaf_rows": rows[leaf], "leaf_cols": cols[leaf]}


def _column_type(n_docs: int) -> str:
    return "<u2" if n_docs <= 1 << 16 else "<u4"


def _build(batches: Iterator[pa.RecordBatch], n_docs: int, n_terms: int, scale: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(batch.num_rows):
            g = {c: batch.column(c)[at].as_py() for c in ("doc_ids", "lengths", "rows", "cols", "tfs")}
            lengths = np.frombuffer(g["lengths"], dtype="<i8")
            rows, cols, tf = (np.frombuffer(g[c], dtype="<u4").astype(np.int64) for c in ("rows", "cols", "tfs"))
            m = np.array([10 + 90 * n * n_docs // max(1, n_terms) for n in lengths.tolist()], dtype=np.int64)
            t = treap(rows, cols, scale * tf // (1000 * tf + 8 * m[cols]))
            yield pa.record_batch(
                [pa.array([g["doc_ids"]], pa.binary()), batch.column("terms").slice(at, 1), pa.array([t["levels"].astype("<i8").tobytes()], pa.binary()),
                 pa.array([t["masks"].tobytes()], pa.binary()), pa.array([t["lacks"].astype("<i8" if scale > 1 << 31 else "<i4").tobytes()], pa.binary()),
                 pa.array([t["top"]], pa.int64()),
                 pa.array([t["leaf_rows"].astype("<u4").tobytes()], pa.binary()),
                 pa.array([t["leaf_cols"].astype(_column_type(len(lengths))).tobytes()], pa.binary())],
                names=["doc_ids", "terms", "levels", "masks", "lacks", "top", "leaf_rows", "leaf_cols"])


def build(grid: DataFrame, n_docs: int, n_terms: int, scale: int = SCALE) -> DataFrame:
    """The index: one treap for each block, written to the shared folder."""
    return written(grid.mapInArrow(partial(_build, n_docs=n_docs, n_terms=n_terms, scale=scale), BLOCK), "treaps")


class Block:
    """A block of the index, opened for searching."""

    def __init__(self, doc_ids: bytes, terms: list[str], levels: bytes, masks: bytes, lacks: bytes, top: int, leaf_rows: bytes,
                 leaf_cols: bytes, scale: int = SCALE):
        self.doc_ids = np.frombuffer(doc_ids, dtype="<i8")
        self.rows = {t: i for i, t in enumerate(terms)}
        bits, *counts = np.frombuffer(levels, dtype="<i8").tolist()
        self.bits = bits
        self.masks = np.frombuffer(masks, dtype=np.uint8)
        ones = _ONES[self.masks]
        self.child = np.cumsum(ones, dtype=np.int32) - ones + 1  # where the children of a square begin
        lacks = np.frombuffer(lacks, dtype="<i8" if scale > 1 << 31 else "<i4")
        best = np.full(len(self.masks), top, dtype=lacks.dtype)
        above, at = 0, 1
        for m, n in zip(counts, counts[1:]):  # a level's maxima come from the level above
            best[at:at + n] = np.repeat(best[above:above + m], ones[above:above + m]) - lacks[at:at + n]
            above, at = at, at + n
        # the last square stands for none: a leaf without impact, in a row that no term has
        self.masks, self.best, self.child = (np.append(x, np.zeros(1, x.dtype)) for x in (self.masks, best, self.child))
        self.leaf = np.cumsum(self.masks == 0, dtype=np.int32) - 1
        wide = np.int32 if bits < 31 else np.int64
        self.leaf_rows = np.append(np.frombuffer(leaf_rows, dtype="<u4").astype(wide), -1)
        self.leaf_cols = np.append(np.frombuffer(leaf_cols, dtype=_column_type(len(self.doc_ids))).astype(wide), 0)

    def _own(self, node: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Squares with one point that lies in another row than the term's are none (-1)."""
        return np.where((self.masks[node] == 0) & (self.leaf_rows[self.leaf[node]] != rows), -1, node)

    def search(self, terms: list[str], weights: list[int], k: int, floor: int = 0) -> list[tuple[int, int]]:
        """The k best documents by (score, smaller id) that score at least ``floor`` and above 0, as (score, column)."""
        asked = [(self.rows[t], w) for t, w in zip(terms, weights) if w > 0 and t in self.rows]
        if not asked:
            return []
        rows, weight = np.array([r for r, _ in asked], dtype=np.int64), np.array([w for _, w in asked], dtype=np.int64)
        # ranges that wait: bound, level, first column, one square for each term
        level, first = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
        node = self._own(np.zeros((1, len(rows)), dtype=np.int64), rows)
        bound = self.best[node] @ weight
        found: list[tuple[int, int]] = []
        while len(bound):
            wait = np.flatnonzero(bound >= max(floor, 1))
            if len(wait) > WIDE:  # the best ranges first
                wait = wait[np.argsort(-bound[wait], kind="stable")]
            take, rest = wait[:WIDE], wait[WIDE:]
            if not len(take):
                break
            done = level[take] == self.bits
            found += zip(bound[take[done]].tolist(), first[take[done]].tolist())
            found = sorted(found, key=lambda x: (-x[0], x[1]))[:k]
            if len(found) == k:
                floor = max(floor, found[-1][0])
            take = take[~done]
            halves = self._halves(level[take], first[take], node[take], rows, weight)
            bound, level, first, node = (np.concatenate([old[rest], new]) for old, new in zip((bound, level, first, node), halves))
        return found

    def _halves(self, level: np.ndarray, first: np.ndarray, node: np.ndarray, rows: np.ndarray, weight: np.ndarray):
        """Both halves of some ranges of documents, one level down each row's path."""
        shift = (self.bits - 1 - level)[:, None]
        mask = self.masks[node]
        row_half = (rows >> shift) & 1
        quarter = 2 * row_half + _HALVES
        inner = np.where((mask >> quarter) & 1, self.child[node] + _ONES[mask & ((1 << quarter) - 1)], -1)
        # a single point goes on in the half that holds its document
        point_half = (self.leaf_cols[self.leaf[node]] >> shift) & 1
        down = np.where(mask == 0, np.where(point_half == _HALVES, node, -1), inner)
        down = self._own(down, rows).reshape(-1, len(rows))
        begins = np.concatenate([first, first + (1 << shift[:, 0])])
        return self.best[down] @ weight, np.concatenate([level, level]) + 1, begins, down


_HALVES = np.array([0, 1])[:, None, None]
_ONES = np.array([bin(m).count("1") for m in range(16)], dtype=np.int32)


def _search(batches: Iterator[pa.RecordBatch], k: int, scale: int, kept: int) -> Iterator[pa.RecordBatch]:
    """The k best documents of a task's blocks for each item; an item's best so far bounds the next block."""
    best: dict[int, list[tuple[int, int]]] = {}
    name: dict[int, int | None] = {}
    group, items = None, []

    def handed() -> pa.RecordBatch:
        hits = [(i, name[i], None if d == NO_ID else d, s) for i, found in best.items() for s, d in found]
        best.clear()
        name.clear()
        return pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*hits) if hits else [[]] * 4)],
                               names=["item", "item_id", "doc_id", "score"])

    for batch in batches:
        for at in range(batch.num_rows):
            row = {c: batch.column(c)[at].as_py() for c in batch.schema.names if c != "items"}
            if row.pop("group_no") != group or not items:
                group, items = batch.column("group_no")[at].as_py(), batch.column("items")[at].as_py()
            block = Block(**row, scale=scale)
            for item in items:
                so_far = best.get(item["item"], [])
                floor = so_far[-1][0] if len(so_far) == k else 0
                found = block.search(item["terms"], item["weights"], k, floor)
                if found:
                    found = [(s, int(block.doc_ids[c])) for s, c in found]
                    best[item["item"]] = sorted(so_far + found, key=lambda x: (-x[0], x[1]))[:k]
                    name[item["item"]] = item["item_id"]
            if len(best) > kept:
                yield handed()
    yield handed()


def weighted_items(grid: DataFrame, items: DataFrame, n_docs: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, item_id, terms, weights: the different terms of each item that documents hold, with their weights."""
    wanted = (items.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).cast("long").alias("item_id"),
                           F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
              .mapInArrow(_asked, "item long, item_id long, term string"))
    wanted = stored(wanted, "item-terms")
    counted = grid.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.dfs").alias("df"))
    # only the words that are asked for are added up
    df = counted.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(F.lit(1000) * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1))).cast("long")
    return (wanted.join(df.select("term", weight.alias("weight")), "term").groupBy("item").agg(
        F.first("item_id").alias("item_id"), F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights")))


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, i, text in zip(*(batch.column(c).to_pylist() for c in ("item", "item_id", "text"))):
            terms = sorted({t.decode() for t in terms_of(text)})
            yield pa.record_batch([pa.array([item] * len(terms), pa.int64()), pa.array([i] * len(terms), pa.int64()), pa.array(terms, pa.string())],
                                  names=["item", "item_id", "term"])


def search(index: DataFrame, asked: DataFrame, k: int = K, scale: int = SCALE, group_items: int = GROUP_ITEMS, spread: int = SPREAD,
           broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item (item, item_id, terms, weights)."""
    asked = stored(asked, "items")
    n, size = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.array_join("terms", " ")) + 8 * F.size("weights") + 16), F.lit(0))).first()
    groups, small = max(1, math.ceil(n / group_items)), size <= broadcast_bytes
    parts = 1 if small else spread
    packed = (asked.groupBy(F.pmod(F.xxhash64("item"), F.lit(groups)).alias("group_no"))
              .agg(F.collect_list(F.struct("item", "item_id", "terms", "weights")).alias("items"))
              .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))))
    blocks = (index.withColumn("part", (F.monotonically_increasing_id() % parts).cast("int"))
              .withColumn("group_no", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))))
    pairs = blocks.join(F.broadcast(packed) if small else packed, ["group_no", "part"]).drop("part")
    hits = written(pairs.mapInArrow(partial(_search, k=k, scale=scale, kept=KEPT_ITEMS), HITS), "hits")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = K, block_docs: int = BLOCK_DOCS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The k best documents of each item, over an index of all documents."""
    grid = grids(docs, block_docs=block_docs, block_bytes=block_bytes)
    n_docs, n_terms = grid.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    asked = weighted_items(grid, items, n_docs)
    return search(build(grid, n_docs, n_terms), asked, k)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERM_SQL = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
_LOW_SQL = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11_SQL = f"""WITH words AS (
  SELECT row, doc_id, unnest(regexp_extract_all({_LOW_SQL.format('text')}, {_TERM_SQL})) AS term
  FROM (SELECT row_number() OVER () AS row, doc_id, text FROM documents WHERE text IS NOT NULL)),
docs AS (SELECT row, doc_id, count(*) AS n FROM words GROUP BY row, doc_id),
totals AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM docs),
lengths AS (SELECT row, doc_id, 10 + (90 * n * big_n) // big_l AS m FROM docs, totals),
tfs AS (SELECT row, term, count(*) AS tf FROM words GROUP BY row, term),
asked AS (SELECT DISTINCT item, item_id, unnest(regexp_extract_all({_LOW_SQL.format('text')}, {_TERM_SQL})) AS term
          FROM (SELECT row_number() OVER () AS item, item_id, text FROM benchmark WHERE text IS NOT NULL)),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * max(big_n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
            FROM tfs JOIN (SELECT DISTINCT term FROM asked) USING (term), totals GROUP BY term),
scored AS (SELECT item, item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS score
           FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN lengths USING (row) GROUP BY item, item_id, row, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
WHERE rank <= {K}"""

QUERIES = {"op11_treap_search": (op11, OP11_SQL)}
