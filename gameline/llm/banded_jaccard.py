"""Join of documents whose word n-gram sets have a Jaccard similarity of ``threshold`` or more.

* An n-gram is five lower-case words in a row (a shorter text is one n-gram of all its words), held as a
  64-bit number.  A text without words has no n-grams and no links.
* Documents with equal n-gram sets form one text class; only one of each class goes on, weighted.
* ``choose_bands`` takes the most rows per band that reach the target recall at the threshold within a
  number of hash functions.  Texts are shuffled on the hashes of their bands.
* Texts that meet in a band, directly or through others, form a candidate set.  Each set is dealt into
  blocks of ``BLOCK`` texts; a task gets two blocks with their full n-gram sets and counts, exactly, how
  many n-grams each two texts share.  So every text of a set is compared to every other, no pair is
  written down, and no task holds more than two blocks.
* A task gives back the number of links of each text and a spanning forest of the links; the classes are
  the connected components of the forests.

The result has one row per document: doc_id, class_id (smallest doc_id of its component), set_id
(smallest doc_id with the same n-gram set), n_links (documents other than itself with a similarity at or
above the threshold, copies included).  Null texts are empty.  A row with a null id gets null ids and no
links.  Repeated rows count as documents.  Work grows with the square of the number of *different* texts
in a candidate set, since every link among them is counted.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gameline.llm.common import stored, table
from gameline.llm.components import components

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9995
HASHES = 160
BLOCK = 512

_BYTE_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BYTE_BASE, -1, 1 << 64)


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows per band with 1 - (1 - t^rows)^bands >= recall and bands * rows <= hashes."""
    best = None
    for rows in range(1, hashes + 1):
        meet = threshold ** rows
        bands = 1 if meet >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-meet))
        if bands * rows <= hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError(f"{hashes} hash functions cannot reach a recall of {recall} at {threshold}")
    return best


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class NGrams:
    """Sorted distinct n-gram numbers of texts, a polynomial of the bytes they span."""

    def __init__(self, words: int = WORDS):
        self.words = words
        self.up, self.down = _powers(_BYTE_BASE, 1 << 16), _powers(_BASE_INVERSE, 1 << 16)

    def of(self, text: str) -> np.ndarray:
        data = np.frombuffer((" ".join(text.lower().split()) + " ").encode("utf-8", "surrogatepass"), dtype=np.uint8)
        n = len(data)
        if n < 2:
            return np.empty(0, dtype=np.uint64)
        if n >= len(self.up):
            self.up, self.down = _powers(_BYTE_BASE, 2 * n), _powers(_BASE_INVERSE, 2 * n)
        ends = np.flatnonzero(data == 32)
        starts = np.concatenate([[0], ends[:-1] + 1])
        k = min(self.words, len(ends))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(data.astype(np.uint64) * self.up[:n], dtype=np.uint64)])
        first, last = starts[:len(ends) - k + 1], ends[k - 1:]
        return np.unique(_mix((sums[last] - sums[first]) * self.down[first] + (last - first).astype(np.uint64)))


class Bands:
    """Band hashes of an n-gram set, by minima under multiplicative permutations of 32-bit numbers."""

    def __init__(self, bands: int, rows: int):
        seeds = _mix(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64) * np.uint64(_BYTE_BASE))
        self.flip = (seeds[::2] >> np.uint64(32)).astype(np.uint32)[:, None]
        self.times = (seeds[1::2] >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1)
        self.bands, self.rows = bands, rows

    def of(self, grams: np.ndarray) -> np.ndarray:
        low = np.full(self.bands * self.rows, 0xFFFFFFFF, dtype=np.uint32)
        short = (grams >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(short), 1024):
            np.minimum(low, ((short[at:at + 1024] ^ self.flip) * self.times).min(axis=1), out=low)
        joined = np.arange(1, self.bands + 1, dtype=np.uint64)
        for row in low.reshape(self.bands, self.rows).T:
            joined = _mix(joined * np.uint64(_BYTE_BASE) + row)
        return joined


def _sketch(batches: Iterator[pa.RecordBatch], words: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    ngrams, banded = NGrams(words), Bands(bands, rows)
    for batch in batches:
        sets, hashes = [], []
        for text in batch.column("text").to_pylist():
            grams = ngrams.of(text)
            sets.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None)
            hashes.append(banded.of(grams).view(np.int64) if len(grams) else None)
        yield pa.record_batch([batch.column("row_no"), batch.column("doc_id"), pa.array(sets, pa.binary()),
                               pa.array(hashes, pa.list_(pa.int64()))],
                              names=["row_no", "doc_id", "gram_set", "bands"])


def _grams(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    ngrams = NGrams(words)
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            some = batch.slice(at, 1000)
            found = [ngrams.of(t).tobytes() for t in some.column("text").to_pylist()]
            yield pa.record_batch([some.column("node"), some.column("weight"), some.column("root"), some.column("block"),
                                   some.column("blocks"), pa.array(found, pa.binary())],
                                  names=["node", "weight", "root", "block", "blocks", "grams"])


def _shared(sets: list[np.ndarray], split: int) -> np.ndarray:
    """Numbers of n-grams that the sets before ``split`` share with those from it on (0: all with all)."""
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = np.cumsum(times > 1) - 1  # an n-gram of one text is shared with none
    kept = times[column] > 1
    rows, cols = np.repeat(np.arange(len(sets)), [len(x) for x in sets])[kept], common[column[kept]]
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    width = int(common[-1]) + 1
    step = max(1, min(width, 4096))
    out = np.zeros((split or len(sets), len(sets) - split), dtype=np.float32)
    for at in range(0, width, step):
        a, b = np.searchsorted(cols, [at, at + step])
        some = np.zeros((len(sets), step), dtype=np.float32)
        some[rows[a:b], cols[a:b] - at] = 1
        out += some[:split or None] @ some[split:].T
    return out.astype(np.int64)


def _forest(pairs: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the given links."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    kept = []
    for a, b in pairs.tolist():
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


_LINKS = pa.schema([("node", pa.int64()), ("other", pa.int64()), ("documents", pa.int64())])


def _verify(batches: Iterator[pa.RecordBatch], threshold: Fraction) -> Iterator[pa.RecordBatch]:
    """Links within each (root, i, j), whose rows come one after the other."""
    up, down = threshold.numerator, threshold.denominator
    out: list[tuple] = []
    key, held = None, []

    def close() -> None:
        if len(held) < 2:
            held.clear()
            return
        _, i, j = key
        held.sort(key=lambda h: h[0])
        split = 0 if i == j else sum(h[0] == i for h in held)
        if i != j and split in (0, len(held)):
            held.clear()
            return
        left, right = held[:split or None], held[split:]
        ids = [np.array([h[1] for h in side], dtype=np.int64) for side in (left, right)]
        weights = [np.array([h[2] for h in side], dtype=np.int64) for side in (left, right)]
        sizes = [np.array([len(h[3]) for h in side]) for side in (left, right)]
        shared = _shared([h[3] for h in held], split)
        # shared / (a + b - shared) >= up / down
        linked = shared * (down + up) >= up * (sizes[0][:, None] + sizes[1][None, :])
        if i == j:
            np.fill_diagonal(linked, False)
        found = [(ids[0], linked @ weights[1])] + ([] if i == j else [(ids[1], linked.T @ weights[0])])
        for names, documents in found:
            out.extend((n, None, d) for n, d in zip(names.tolist(), documents.tolist()) if d)
        a, b = np.nonzero(linked)
        out.extend((x, y, None) for x, y in _forest(np.stack([ids[0][a], ids[1][b]], axis=1)))
        held.clear()

    def rows() -> pa.RecordBatch:
        found = pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), _LINKS)], schema=_LINKS)
        out.clear()
        return found

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("root", "i", "j", "block", "node", "weight")]
        for *here, block, node, weight, grams in zip(*columns, batch.column("grams")):
            if here != key:
                close()
                key = here
            held.append((block, node, weight, np.frombuffer(grams.as_buffer(), dtype=np.uint64)))
        if len(out) >= 5000:
            yield rows()
    close()
    if out:
        yield rows()


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, recall: float = RECALL,
                    hashes: int = HASHES, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_no, doc_id, class_id, set_id, n_links of every row; ``row_no`` is a hash of id and text."""
    bands, rows = choose_bands(threshold, recall, hashes)
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    row_no = F.xxhash64("doc_id", "text").alias("row_no")
    sketches = stored(given.select(row_no, "doc_id", "text").mapInArrow(
        partial(_sketch, words=words, bands=bands, rows=rows),
        "row_no long, doc_id long, gram_set binary, bands array<long>"), "sketches")

    part = sketches.where(F.col("doc_id").isNotNull() & F.col("gram_set").isNotNull())
    classes = stored(part.groupBy("gram_set")
                     .agg(F.min(F.struct("doc_id", "row_no")).alias("rep"), F.count(F.lit(1)).alias("weight"),
                          F.first("bands").alias("bands"))
                     .select("gram_set", F.col("rep.doc_id").alias("set_id"), F.col("rep.row_no").alias("rep_row"), "weight",
                             "bands", F.monotonically_increasing_id().alias("node")), "text-classes")

    # candidates: texts that share a band hash, each tied to the smallest of them
    met = classes.select("node", F.posexplode("bands").alias("band", "value"))
    low = met.groupBy("band", "value").agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
    tied = met.join(low, ["band", "value"]).select(F.col("node").alias("u"), F.col("low").alias("v"))
    candidates = components(tied)
    size = candidates.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).alias("blocks"))
    dealt = (candidates.join(size, "root")
             .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
             .join(classes.select("node", F.col("set_id").alias("doc_id"), F.col("rep_row").alias("row_no"), "weight"), "node"))

    # their n-gram sets, from one document of each class
    texts = given.select("doc_id", row_no, "text").join(dealt, ["doc_id", "row_no"]).dropDuplicates(["node"])
    sets = texts.select("node", "weight", "root", "block", "blocks", "text").mapInArrow(
        partial(_grams, words=words), "node long, weight long, root long, block long, blocks long, grams binary")
    paired = sets.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "root", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "node", "weight", "grams")
    links = stored(paired.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(
        partial(_verify, threshold=Fraction(threshold).limit_denominator(10_000)),
        "node long, other long, documents long"), "links")

    counted = links.where(F.col("other").isNull()).groupBy("node").agg(F.sum("documents").alias("documents"))
    joined = components(links.where(F.col("other").isNotNull()).select(F.col("node").alias("u"), F.col("other").alias("v")))
    known = (classes.select("node", "gram_set", "set_id", "weight").join(joined, "node", "left")
             .join(counted, "node", "left").withColumn("root", F.coalesce("root", "node")))
    named = known.groupBy("root").agg(F.min("set_id").alias("class_id"))
    answer = known.join(named, "root").select(
        "gram_set", "class_id", "set_id", (F.coalesce("documents", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    own = F.col("doc_id")
    return sketches.select("row_no", "doc_id", F.when(own.isNotNull(), F.col("gram_set")).alias("gram_set")).join(
        answer, "gram_set", "left").select(
        "row_no", "doc_id", F.coalesce("class_id", own).alias("class_id"), F.coalesce("set_id", own).alias("set_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """The documents that stay: of each class the one with the smallest id; rows with a null id stay."""
    marked = near_duplicates(docs, **settings)
    gone = marked.where(F.col("doc_id") != F.col("class_id")).select(F.col("doc_id").alias("_doc_id"), F.col("row_no").alias("_row_no"))
    key = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))
    return docs.join(gone, (F.col("doc_id") == F.col("_doc_id")) & (key == F.col("_row_no")), "left_anti")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "set_id", "n_links")


OP10_SQL = r"""WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1),
           lambda i: array_to_string(w[i:i + 4], ' ')))) AS grams
  FROM words WHERE len(w) > 0),
classes AS (SELECT grams, min(doc_id) AS node, count(*) AS weight FROM sets GROUP BY grams),
flat AS (SELECT node, weight, len(grams) AS n, unnest(grams) AS gram FROM classes),
links AS (
  SELECT a.node AS u, b.node AS v, any_value(b.weight) AS weight FROM flat a JOIN flat b ON a.gram = b.gram AND a.node <> b.node
  GROUP BY a.node, b.node HAVING count(*) * 9 >= 4 * (any_value(a.n) + any_value(b.n))),
reach AS (SELECT node AS u, node AS v FROM classes UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
found AS (SELECT u, min(v) AS class_id FROM reach GROUP BY u),
linked AS (SELECT u, sum(weight) AS documents FROM links GROUP BY u)
SELECT d.doc_id, coalesce(f.class_id, d.doc_id) AS class_id, coalesce(c.node, d.doc_id) AS set_id,
  CAST(coalesce(l.documents, 0) + coalesce(c.weight, 1) - 1 AS BIGINT) AS n_links
FROM documents d LEFT JOIN sets s ON d.doc_id = s.doc_id LEFT JOIN classes c ON s.grams = c.grams
LEFT JOIN found f ON c.node = f.u LEFT JOIN linked l ON c.node = l.u"""

QUERIES = {"op10_banded_jaccard": (op10, OP10_SQL)}
