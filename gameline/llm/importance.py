"""Importance resampling towards a target text distribution, by hashed word n-grams.

An untrained ``Split`` pre-tokeniser of the tokenizers library cuts the text, with A-Z lowered, into words
and their offsets.  Windows over consecutive offset pairs are the features: all runs of 1 to ``N`` words,
joined by one space.  A feature falls into the bucket that the CRC-32 of its UTF-8 bytes names.  Histograms
of all documents and of the target texts give each bucket a gain, the log of the ratio of its two smoothed
shares in thousandths.  The weight of a document is the floored mean of its features' gains; adding Gumbel
noise taken from a hash of its id and keeping the highest sums draws without replacement in proportion to
the exponentiated weights.

Each text is cut once: its buckets are written as 16-bit numbers, counted, and read again for the weights.
Histograms and gains have one entry per bucket.  The drawn rows get their ranks from a two-level scan.

A null text has no words; a null id is hashed as the empty text.  A document without features has the
weight 0.  Repeated rows are rows of their own, each with the same score; ties go to the smaller id, a
null id last.  Where no feature is met in the target all gains follow from the smoothing.  Empty tables
give an empty result.  Very long texts are cut in pieces between words, so memory follows the piece.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache, partial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gameline.llm.common import stored, table, texts
from gameline.operators.positions import positions

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
N = 2
BUCKETS = 10_000
SCALE = 1000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
PIECE_CHARS = 1 << 16
BATCH_ROWS = 1000

CUT = "doc_id long, row long, n_words long, n_features long, buckets binary"
COUNTED = "bucket int, n long"
WEIGHED = "doc_id long, row long, n_words long, n_features long, weight long"

_BETWEEN = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")


@lru_cache(maxsize=1)
def splitter():
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(WORD), behavior="removed", invert=True)


def lowered(text: str) -> str:
    """A-Z in lower case, every other character as it is."""
    return text.encode("utf-8", "replace").lower().decode("utf-8")


def pieces(text: str, chars: int = PIECE_CHARS) -> Iterator[tuple[int, str]]:
    """Parts of a text that cut no word, with their offsets; a part is longer than ``chars`` by less than a word."""
    at = 0
    while len(text) - at > chars:
        found = _BETWEEN.search(text, at + chars)
        if found is None:
            break
        yield at, text[at:found.end()]
        at = found.end()
    yield at, text[at:] if at else text


def words(text: str, chars: int = PIECE_CHARS) -> Iterator[list[tuple[str, tuple[int, int]]]]:
    """The words of a text and their offsets in it, in lists for one piece each."""
    for at, piece in pieces(lowered(text), chars):
        found = splitter().pre_tokenize_str(piece)
        yield [(w, (a + at, b + at)) for w, (a, b) in found] if at else found


def feature_hashes(text: str, n: int = N, chars: int = PIECE_CHARS) -> tuple[int, list[int]]:
    """The number of words, and the CRC-32 of every run of 1 to ``n`` consecutive words."""
    count, hashes = 0, []
    runs: list[int] = []  # of the windows that end at the word before, by length
    for found in words(text, chars):
        count += len(found)
        for word, _ in found:
            data = word.encode()
            longer = b" " + data
            # the window over offset pairs grows by one word, and its CRC goes on from there
            runs = [crc32(data), *[crc32(longer, run) for run in runs[:n - 1]]]
            hashes += runs
    return count, hashes


def feature_spans(text: str, n: int = N) -> Iterator[tuple[int, int]]:
    """The offsets of every feature in the text: from the first word's start to the last word's end."""
    last: list[int] = []
    for found in words(text):
        for _, (start, end) in found:
            last = [start, *last[:n - 1]]
            yield from ((a, end) for a in last)


def _cut(batches: Iterator[pa.RecordBatch], n: int, buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(at, BATCH_ROWS) for b in batches for at in range(0, b.num_rows, BATCH_ROWS)):
        n_words, n_features, data = [], [], []
        for text in batch.column("text").to_pylist():
            count, hashes = feature_hashes(text, n)
            n_words.append(count)
            n_features.append(len(hashes))
            data.append((np.array(hashes, dtype=np.uint32) % buckets).astype("<u4" if buckets > 1 << 16 else "<u2").tobytes())
        yield pa.record_batch([batch.column("doc_id"), batch.column("row"), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()),
                               pa.array(data, pa.binary())], names=["doc_id", "row", "n_words", "n_features", "buckets"])


def _numbers(data: bytes, buckets: int) -> np.ndarray:
    return np.frombuffer(data, dtype="<u4" if buckets > 1 << 16 else "<u2")


def cut_texts(docs: DataFrame, n: int = N, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row, n_words, n_features and the bucket of each feature, written to the shared folder."""
    rows = texts(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    return stored(rows.mapInArrow(partial(_cut, n=n, buckets=buckets), CUT), "feature-buckets")


def _count(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(buckets, dtype=np.int64)
    for batch in batches:
        for data in batch.column("buckets").to_pylist():
            total += np.bincount(_numbers(data, buckets), minlength=buckets)
    at = np.flatnonzero(total)
    yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "n"])


def histogram(cut: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features fall into each bucket: a sum per task, then one per bucket."""
    counted = cut.select("buckets").mapInArrow(partial(_count, buckets=buckets), COUNTED)
    out = np.zeros(buckets, dtype=np.int64)
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most one row per bucket
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * ln) of the ratio of the smoothed shares of each bucket."""
    buckets, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(scale * math.log((float(t + 1) * float(s_all + buckets)) / (float(s + 1) * float(t_all + buckets))))
                     for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def _weigh(batches: Iterator[pa.RecordBatch], gain: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        weight = [int(gain[_numbers(d, len(gain))].sum()) // (n or 1)
                  for d, n in zip(batch.column("buckets").to_pylist(), batch.column("n_features").to_pylist())]
        yield pa.record_batch([*batch.columns[:4], pa.array(weight, pa.int64())], names=["doc_id", "row", "n_words", "n_features", "weight"])


def weights(docs: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS, scale: int = SCALE) -> DataFrame:
    """doc_id, row, n_words, n_features, weight of every document; ``target`` holds (id, text) in its first two columns."""
    cut = cut_texts(docs, n, buckets)
    wanted = cut_texts(target, n, buckets, *target.columns[:2])
    gain = gains(histogram(cut, buckets), histogram(wanted, buckets), scale)
    return cut.mapInArrow(partial(_weigh, gain=gain), WEIGHED)


def noise(doc_id: Column, seed: int = SEED, scale: int = SCALE) -> Column:
    """Gumbel noise in units of 1/scale, from the first 32 bits of the SHA-256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-float(scale)) * F.log(-F.log(uniform))).cast("long")


def resample(docs: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS, scale: int = SCALE, least_words: int = LEAST_WORDS,
             percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; the rank of a document that is not drawn is null.

    ``percent`` of the documents with at least ``least_words`` words are drawn, rounded down.
    """
    weighed = stored(weights(docs, target, n, buckets, scale), "weights")
    scored = (weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed, scale))
              .withColumn("fits", (F.col("n_words") >= least_words).cast("int")))
    order = [F.desc("fits"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    placed = positions(scored.drop("n_words"), order, "place")
    fitting = scored.agg(F.coalesce(F.sum("fits"), F.lit(0))).scalar()
    is_drawn = (F.col("fits") == 1) & (F.col("place") <= F.floor(fitting * percent / 100))
    return placed.select("doc_id", "n_features", "weight", "score", F.when(is_drawn, F.col("place")).alias("rank"))


def drawn(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """The drawn documents with all their columns; rows of one id stay together."""
    found = resample(docs, target, **settings).where(F.col("rank").isNotNull()).select(F.col("doc_id").alias("_drawn"))
    return docs.join(found, F.col(id_col) == F.col("_drawn"), "left_semi")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return resample(table(spark, sf_dir, "documents"), target)


# SQL has no CRC-32 in the checking engine; a test compares the whole result with a plain Python version.
QUERIES = {"op13_importance_resampling": (op13, None)}
