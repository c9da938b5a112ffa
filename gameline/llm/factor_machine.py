"""Text quality by a factorisation machine.

The inputs of a document are its hashed words (counts, scaled to length 1), statistics of its structure,
and its size in characters.  With weights w and factors v of rank k the score is

    logistic( w0 + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ] )

where the bracket is the sum of all pairwise interactions, computed in time linear in the inputs.  The
machine is fitted by mini-batches with per-weight step sizes in numpy, on at most ``SAMPLE_ROWS``
labelled rows; the fitted arrays have a fixed size and go to the tasks that score.

Labels, language, source and id are never inputs.  Null and empty texts have the statistics of an empty
text.  Without labelled rows every score is 0.5.  Rows with a null id count as held out or not by the
crc32 of the empty text.  Repeated rows are scored each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gameline.llm.common import fold, ship, table
from gameline.llm.labelled import collected, scored, training_rows

SAMPLE_ROWS = 8000
BUCKETS = 1 << 14
RANK = 8
EPOCHS = 6
BATCH = 64
THRESHOLD = 0.3
WORDS_KEPT = 400_000

# Classes of bytes whose shares are statistics of structure.
CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?", b".,;:", b"|", b"#$%&*@^~", b"<>{}[]()/\\_=+", b"\"'`", b"\n", b" \t"]
STATISTICS = len(CLASSES) + 8


def _class_matrix() -> np.ndarray:
    out = np.zeros((256, len(CLASSES)), dtype=np.float32)
    for i, members in enumerate(CLASSES):
        out[list(members), i] = 1
    return out


class WordBuckets:
    """Bucket of each word, remembered up to a bound."""

    def __init__(self, buckets: int = BUCKETS, kept: int = WORDS_KEPT):
        self.buckets, self.kept, self.known = buckets, kept, {}

    def of(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.kept:
            known.clear()
        for w in set(words).difference(known):
            known[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) % self.buckets
        return np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))


@lru_cache(maxsize=1)
def _buckets() -> tuple[WordBuckets, np.ndarray]:
    return WordBuckets(), _class_matrix()


def inputs(text: str, n_chars: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, their scaled counts, and the statistics of a text."""
    buckets, classes = _buckets()
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    words = text.split()
    at = buckets.of(words)
    bucket, count = np.unique(at, return_counts=True)
    norm = np.sqrt(float(count @ count)) if len(count) else 1.0
    size, n = max(1, len(data)), max(1, len(words))
    lines = text.split("\n")
    shares = np.bincount(data, minlength=256).astype(np.float32) @ classes / size
    rest = [np.log1p(len(words)), np.log1p(len(data)), np.log1p(max(0, n_chars if n_chars is not None else len(text))),
            len(data) / n, len(bucket) / n, float(np.count_nonzero(at[1:] == at[:-1])) / n,
            1 - len(set(lines)) / len(lines), float(count.max()) / n if len(count) else 0.0]
    return bucket.astype(np.int32), (count / norm).astype(np.float32), np.concatenate([np.sqrt(shares), rest]).astype(np.float32)


@dataclass
class FactorMachine:
    """Weights of the words, then of the statistics; statistics are centred and scaled first."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def scaled(self, statistics: np.ndarray) -> np.ndarray:
        return np.clip((statistics - self.mean) / self.scale, -4, 4) / 2

    def logit(self, bucket: np.ndarray, value: np.ndarray, statistics: np.ndarray) -> float:
        x = np.concatenate([value, self.scaled(statistics)])
        v = np.concatenate([self.factors[bucket], self.factors[BUCKETS:]]) * x[:, None]
        linear = self.weights[bucket] @ value + self.weights[BUCKETS:] @ x[len(value):]
        return float(self.bias + linear + 0.5 * (np.square(v.sum(axis=0)).sum() - np.square(v).sum()))


def fit(rows: list[dict], epochs: int = EPOCHS, rank: int = RANK, rate: float = 0.1, decay: float = 1e-5,
        seed: int = 7) -> FactorMachine:
    """Fit on rows of bucket, value, statistics and label."""
    rng = np.random.default_rng(seed)
    n = BUCKETS + STATISTICS
    w, v, bias = np.zeros(n), rng.normal(0, 0.02, (n, rank)), 0.0
    statistics = np.array([r["statistics"] for r in rows], dtype=np.float64).reshape(len(rows), STATISTICS)
    mean = statistics.mean(axis=0) if len(rows) else np.zeros(STATISTICS)
    scale = np.maximum(statistics.std(axis=0), 1e-3) if len(rows) else np.ones(STATISTICS)
    machine = FactorMachine(0.0, w, v, mean, scale)
    if len({r["label"] for r in rows}) < 2:
        if rows:
            machine.bias = 4.0 if rows[0]["label"] else -4.0
        v[:] = 0
        return machine
    dense = machine.scaled(statistics)
    fixed = np.arange(BUCKETS, n)
    index = [np.concatenate([np.array(r["bucket"], dtype=np.int64), fixed]) for r in rows]
    value = [np.concatenate([np.array(r["value"]), d]) for r, d in zip(rows, dense)]
    label = np.array([r["label"] for r in rows], dtype=np.float64)
    bias = float(np.log(label.mean() / (1 - label.mean())))
    seen_w, seen_v, seen_b = np.full(n, 1e-8), np.full((n, rank), 1e-8), 1e-8
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            some = order[at:at + BATCH]
            i, x = np.concatenate([index[r] for r in some]), np.concatenate([value[r] for r in some])
            size = np.array([len(index[r]) for r in some])
            starts = np.cumsum(size) - size
            vx = v[i] * x[:, None]
            sums = np.add.reduceat(vx, starts)
            logit = bias + np.add.reduceat(w[i] * x, starts) + 0.5 * (np.square(sums).sum(axis=1) - np.add.reduceat(np.square(vx).sum(axis=1), starts))
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - label[some]) / len(some)
            each = np.repeat(error, size) * x
            used, back = np.unique(i, return_inverse=True)
            gw = np.bincount(back, each) + decay * w[used]
            gv = np.stack([np.bincount(back, each * (np.repeat(sums[:, f], size) - vx[:, f])) for f in range(rank)], axis=1) + decay * v[used]
            seen_w[used] += gw ** 2
            seen_v[used] += gv ** 2
            seen_b += error.sum() ** 2
            w[used] -= rate * gw / np.sqrt(seen_w[used])
            v[used] -= rate / 2 * gv / np.sqrt(seen_v[used])
            bias -= rate * error.sum() / np.sqrt(seen_b)
    return FactorMachine(bias, w.astype(np.float32), v.astype(np.float32), mean.astype(np.float32), scale.astype(np.float32))


_ROWS = "doc_id long, part int, bucket array<int>, value array<float>, statistics array<float>, label int"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [inputs(t, c) for t, c in zip(batch.column("text").to_pylist(), batch.column("_n_chars").to_pylist())]
        b, v, s = zip(*found) if found else ((), (), ())
        yield pa.record_batch([batch.column("doc_id"), pa.array([0] * len(found), pa.int32()), pa.array(b, pa.list_(pa.int32())),
                               pa.array(v, pa.list_(pa.float32())), pa.array(s, pa.list_(pa.float32())), batch.column("_label")],
                              names=["doc_id", "part", "bucket", "value", "statistics", "label"])


def _score(batches: Iterator[pa.RecordBatch], machine: FactorMachine, carry: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        logits = np.array([machine.logit(*inputs(t, c)) for t, c in zip(batch.column("text").to_pylist(),
                                                                       batch.column("_n_chars").to_pylist())])
        yield pa.record_batch([*[batch.column(c) for c in carry], 1 / (1 + np.exp(-np.clip(logits, -30, 30)))],
                              names=[*carry, "score"])


def _size(docs: DataFrame):
    return (F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")).alias("_n_chars")


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, label: str = "quality", **settings) -> FactorMachine:
    """Fit on a bounded sample of labelled rows."""
    ship(docs.sparkSession)
    given = training_rows(docs.withColumn("_n_chars", _size(docs)), labels, label, rows, ("_n_chars",))
    return fit(collected(given, _features, _ROWS), **settings)


def score(docs: DataFrame, machine: FactorMachine) -> DataFrame:
    """doc_id, score of every row."""
    given = scored(docs.withColumn("_n_chars", _size(docs)), ("_n_chars",))
    return given.mapInArrow(partial(_score, machine=machine, carry=["doc_id"]), "doc_id long, score double")


def keep_good(docs: DataFrame, machine: FactorMachine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score at or above the threshold, with all their columns."""
    names = {c: f"_in{i}" for i, c in enumerate(docs.columns)}
    given = docs.select(*[F.col(c).alias(n) for c, n in names.items()], F.coalesce("text", F.lit("")).alias("text"), _size(docs))
    schema = ", ".join([*[f"{n} {given.schema[n].dataType.simpleString()}" for n in names.values()], "score double"])
    found = given.mapInArrow(partial(_score, machine=machine, carry=list(names.values())), schema)
    return found.where(F.col("score") >= threshold).select(*[F.col(n).alias(c) for c, n in names.items()])


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score",
                        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op8_factor_machine": (op8, None)}
