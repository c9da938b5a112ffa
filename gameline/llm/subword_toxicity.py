"""Toxicity by averaged subword embeddings and a linear softmax, trained jointly.

A word is the mean of the embeddings of its character n-grams, and of itself, all hashed into one table;
a longer token than ``LONGEST`` characters counts as the overlapping parts that it is cut into; a window of ``WINDOW`` words is the mean of its distinct words, with zero vectors up to ``LEAST_WORDS`` of
them, so that neither repetition nor brevity makes a word loud; two linear outputs and a softmax give the chance
of each label.  Table and outputs are trained together in numpy, on windows of at most ``SAMPLE_ROWS``
labelled documents, with steps that shrink to nothing (``WINDOWS_A_ROW`` evenly spaced windows of each, to bound what the driver holds).  A
misspelling that was never seen shares most n-grams with the word it comes from.

Averages and outputs are linear, so a trained model gives each word one number: the difference of the two
outputs.  Scoring walks the whole text: the mean of these numbers in each window, windows half a window
apart, and the most toxic window decides.  Labels, language, source and id are never inputs.

Null and empty texts get the chance of a window without words.  Without labelled rows every score is 0.5.
Repeated rows are scored each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gameline.llm.common import fold, ship, table
from gameline.llm.labelled import collected, scored, training_rows

SAMPLE_ROWS = 8000
WINDOW = 96
WINDOWS_A_ROW = 3
BUCKETS = 1 << 18
DIMENSIONS = 6
GRAMS = (3, 4, 5)
EPOCHS = 3
LEAST_STEPS = 750
BATCH = 64
TEMPERATURE = 20.0
SPREAD = 1e-3
LEAST_WORDS = 48
WORDS_KEPT = 400_000
LONGEST = 64
PART, PART_STEP = 16, 8  # about a word; neighbours share more than the longest n-gram, so none is lost
_EDGES = ".,;:!?\"'()[]{}<>|#$%&*-_"


def words_of(text: str) -> list[str]:
    """The words of a text; a token that is too long to be one gives its overlapping parts."""
    out = []
    for word in text.split():
        if len(word) <= LONGEST or len(word.strip(_EDGES)) <= LONGEST:
            out.append(word)
        else:
            out += [word[i:i + PART] for i in range(0, len(word) - PART + PART_STEP, PART_STEP)]
    return out


def subwords(word: str) -> list[int]:
    """Buckets of a word without the signs around it, and of its character n-grams."""
    bare = word.lower().strip(_EDGES)
    marked = f"<{bare}>"
    grams = [marked[i:i + n] for n in GRAMS for i in range(len(marked) - n + 1)]
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) % BUCKETS for g in (f"={bare}", *grams)]


@dataclass
class SubwordModel:
    """What each bucket adds to the difference of the two outputs, and the constant of the difference."""

    effect: np.ndarray
    bias: float
    known: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"effect": self.effect, "bias": self.bias, "known": {}}

    def learn(self, words: set[str]) -> None:
        """Put the numbers of new words into the table, which has a bound."""
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        new = list(words.difference(self.known))
        if new:
            parts = [subwords(w) for w in new]
            size = np.array([len(p) for p in parts])
            flat = self.effect[np.fromiter(chain.from_iterable(parts), dtype=np.int64)]
            self.known.update(zip(new, (np.add.reduceat(flat, np.cumsum(size) - size) / size).tolist()))

    def score(self, text: str) -> float:
        words = words_of(text)
        self.learn(set(words))
        number = self.known.__getitem__
        bags = [set(words[max(0, end - WINDOW):end]) for end in window_ends(len(words)).tolist()]
        return _chance(self.bias + max(sum(map(number, bag)) / max(len(bag), LEAST_WORDS) for bag in bags))


def window_ends(n: int) -> np.ndarray:
    """Ends of the windows of a text of n words; the last window ends with the text."""
    return np.unique(np.append(np.arange(WINDOW, n, WINDOW // 2), n)) if n > WINDOW else np.array([n])


def _chance(logit: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def fit(rows: list[dict], epochs: int = EPOCHS, rate: float = 0.1, decay: float = 1e-4, seed: int = 11) -> SubwordModel:
    """Fit table and outputs on windows: rows of words and label."""
    rng = np.random.default_rng(seed)
    e = rng.uniform(-SPREAD, SPREAD, (BUCKETS, DIMENSIONS))  # near 0: n-grams that training never meets say nothing
    out, bias = rng.normal(0, 0.1, (DIMENSIONS, 2)), np.zeros(2)
    rows = [r for r in rows if r["words"]]
    if len({r["label"] for r in rows}) < 2:
        constant = 0.0 if not rows else (4.0 if rows[0]["label"] else -4.0)
        return SubwordModel(np.zeros(BUCKETS), constant)
    names = sorted({w for r in rows for w in r["words"]})
    place = {w: i for i, w in enumerate(names)}
    parts = [np.array(subwords(w)) for w in names]
    size = np.array([len(p) for p in parts])
    flat, first = np.concatenate(parts), np.cumsum(size) - size
    windows = [np.array([place[w] for w in r["words"]]) for r in rows]
    label = np.array([r["label"] for r in rows])
    share = label.mean()
    bias[:] = np.log([1 - share, share])
    seen_e, seen_out, seen_bias = np.full(BUCKETS, 1e-10), np.full(out.shape, 1e-8), np.full(2, 1e-8)
    batches = -(-len(rows) // BATCH)
    epochs = max(epochs, -(-LEAST_STEPS // batches))  # a small sample is met more often
    step, steps, first_rate = 0, epochs * batches, rate
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            some, rate, step = order[at:at + BATCH], first_rate * (1 - step / steps), step + 1
            length = np.array([len(windows[r]) for r in some])
            used, back = np.unique(np.concatenate([windows[r] for r in some]), return_inverse=True)
            own = size[used]
            begin = np.cumsum(own) - own
            bucket = flat[np.repeat(first[used] - begin, own) + np.arange(own.sum())]
            word = np.add.reduceat(e[bucket], begin) / own[:, None]
            over = np.maximum(length, LEAST_WORDS)[:, None]
            hidden = np.add.reduceat(word[back], np.cumsum(length) - length) / over
            logits = TEMPERATURE * hidden @ out + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), label[some]] -= 1
            p /= len(some)
            g_out, g_bias = TEMPERATURE * hidden.T @ p, p.sum(axis=0)
            g_hidden = np.repeat(TEMPERATURE * p @ out.T / over, length, axis=0)
            g_word = np.stack([np.bincount(back, g_hidden[:, d], len(used)) for d in range(DIMENSIONS)], axis=1) / own[:, None]
            rows_e, back_e = np.unique(bucket, return_inverse=True)
            each = np.repeat(g_word, own, axis=0)
            g_e = np.stack([np.bincount(back_e, each[:, d]) for d in range(DIMENSIONS)], axis=1)
            g_e += decay * e[rows_e]
            seen_e[rows_e] += np.square(g_e).mean(axis=1)
            seen_out += g_out ** 2
            seen_bias += g_bias ** 2
            e[rows_e] -= rate * g_e / np.sqrt(seen_e[rows_e])[:, None]
            out -= rate * g_out / np.sqrt(seen_out)
            bias -= rate * g_bias / np.sqrt(seen_bias)
    return SubwordModel((TEMPERATURE * e @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


_ROWS = "doc_id long, part int, words array<string>, label int"


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc_id, text, label in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "_label"))):
            words = words_of(text)
            ends = window_ends(len(words))
            ends = ends[np.unique(np.linspace(0, len(ends) - 1, WINDOWS_A_ROW).astype(int))]
            out += [(doc_id, i, sorted(set(words[max(0, end - WINDOW):end])), label) for i, end in enumerate(ends.tolist())]
        if out:
            ids, parts, words, labels = zip(*out)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(parts, pa.int32()), pa.array(words, pa.list_(pa.string())),
                                   pa.array(labels, pa.int32())], names=["doc_id", "part", "words", "label"])


def _score(batches: Iterator[pa.RecordBatch], model: SubwordModel) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = [model.score(t) for t in batch.column("text").to_pylist()]
        yield pa.record_batch([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, label: str = "toxic", **settings) -> SubwordModel:
    """Fit on a bounded sample of labelled rows."""
    ship(docs.sparkSession)
    return fit(collected(training_rows(docs, labels, label, rows), _windows, _ROWS), **settings)


def score(docs: DataFrame, model: SubwordModel) -> DataFrame:
    """doc_id, score of every row."""
    return scored(docs).mapInArrow(partial(_score, model=model), "doc_id long, score double")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op3_subword_toxicity": (op3, None)}
