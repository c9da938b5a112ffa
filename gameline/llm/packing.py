"""Order-preserving packing of documents into sequences of at most ``length`` tokens.

The stream of a task's documents is cut into windows.  Cuts may fall at the end of a document (free),
at the end of a sentence (``SENTENCE_PENALTY``), or, inside a sentence longer than a window, anywhere
(``RAW_PENALTY``).  With f(j) the least cost of the stream up to cut point j at position p(j),

    f(j) = penalty(j) + min over i with p(j) - p(i) <= length of  f(i) + padding(p(j) - p(i))

and as padding is ``length - p(j) + p(i)``, the minimum is one of f(i) + p(i) over a sliding window: a
monotone queue gives it in constant amortised time.  Windows whose size is a power of two need no
padding; they are looked up beside the queue.  The last window of a block of the stream is carried
into the next block, so that only the end of a task's stream can hold a window for want of more text.

Documents keep the order in which the scan gives them; ``order_by`` sorts by a column first.  Each
document is its token ids and one end id; a null text is empty and has only the end id.  Repeated ids
are packed as separate documents.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gameline.llm.common import table, texts
from gameline.llm.encoding import WordEncoder, encoder, tokenizer_path

LENGTH = 2048
SENTENCE_PENALTY = 16.0
RAW_PENALTY = 256.0
RAW_STEP = 64
BLOCK_TOKENS = 1 << 18
SEQUENCES_A_TASK = 1 << 33

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_NAMES = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]


def cut_windows(points: np.ndarray, penalties: np.ndarray, length: int = LENGTH) -> list[int]:
    """Ends of the windows of least cost; ``points`` ascend from 0 and lie at most ``length`` apart."""
    m = len(points)
    twos: dict[int, list[int]] = {}
    size = 1
    place = np.full(int(points[-1]) + 1, -1)
    place[points] = np.arange(m)
    while size < length:
        first = int(np.searchsorted(points, size))
        at = place[points[first:] - size]
        met = np.flatnonzero(at >= 0)
        for j, i in zip((met + first).tolist(), at[met].tolist()):
            if j in twos:
                twos[j].append(i)
            else:
                twos[j] = [i]
        size *= 2
    p, extra = points.tolist(), penalties.tolist()
    cost, came = [0.0] * m, [0] * m
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for j in range(1, m):
        here, oldest = p[j], p[j] - length
        while p[queue[0][1]] < oldest:
            queue.popleft()
        best, source = queue[0]
        best += length - here
        for i in twos.get(j, ()):
            if cost[i] < best:
                best, source = cost[i], i
        best += extra[j]
        cost[j], came[j] = best, source
        key = best + here
        while queue and queue[-1][0] > key:
            queue.pop()
        queue.append((key, j))
    ends, j = [], m - 1
    while j > 0:
        ends.append(p[j])
        j = came[j]
    return ends[::-1]


class Boundaries:
    """Which ids end a sentence, by the text of the tokens."""

    def __init__(self, encode: WordEncoder, end_id: int):
        vocab = encode.tokenizer.get_vocab()
        n = max(max(vocab.values()), end_id) + 1
        self.stops, self.breaks = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        # fixed values: how a byte-level vocabulary shows a space and a line feed
        space, feed = "Ġ", "Ċ"
        for piece, i in vocab.items():
            self.stops[i] = piece[-1] in ".!?" or piece.endswith(feed)
            self.breaks[i] = piece[0] in (space, feed)
        self.breaks[end_id] = True

    def points(self, ids: np.ndarray, doc_ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the stream may be cut, and what each cut costs."""
        ends, at = np.zeros(len(ids) + 1, dtype=bool), np.zeros(len(ids) + 1, dtype=bool)
        ends[doc_ends] = True
        at[1:-1] = self.stops[ids[:-1]] & self.breaks[ids[1:]]
        at |= ends
        at[0] = True
        points = np.flatnonzero(at)
        gaps = np.flatnonzero(np.diff(points) > length)
        raw = [np.arange(points[g] + RAW_STEP, points[g + 1], RAW_STEP) for g in gaps]
        cost = np.full(len(points), SENTENCE_PENALTY)
        cost[ends[points]] = 0.0
        if raw:
            points = np.concatenate([points, *raw])
            cost = np.concatenate([cost, np.full(len(points) - len(cost), RAW_PENALTY)])
            order = np.argsort(points, kind="stable")
            points, cost = points[order], cost[order]
        return points, cost


class Stream:
    """The documents of one task, waiting to be cut."""

    def __init__(self, boundaries: Boundaries, length: int, first_sequence: int):
        self.boundaries, self.length, self.sequence = boundaries, length, first_sequence
        self.parts: list[tuple[int | None, int, int, np.ndarray]] = []  # doc_id, start, doc_tokens, ids
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.parts.append((doc_id, 0, len(ids), ids))
        self.held += len(ids)

    def pieces(self, last: bool) -> list[tuple]:
        """Cut what waits; unless it is the last of the stream, the end that is not yet full goes on waiting."""
        if not self.parts:
            return []
        ids = np.concatenate([p[3] for p in self.parts])
        doc_ends = np.cumsum([len(p[3]) for p in self.parts])
        ends = cut_windows(*self.boundaries.points(ids, doc_ends, self.length), self.length)
        if not last:
            ends.pop()
        out, part, used, begin = [], 0, 0, 0
        for end in ends:
            at = begin
            while at < end:
                doc_id, start, total, own = self.parts[part]
                n = min(end - at, len(own) - used)
                out.append((doc_id, start + used, n, total, self.sequence, at - begin, own[used:used + n].tobytes()))
                at, used = at + n, used + n
                if used == len(own):
                    part, used = part + 1, 0
            self.sequence, begin = self.sequence + 1, end
        rest = self.parts[part:]
        if rest and used:
            doc_id, start, total, own = rest[0]
            rest[0] = (doc_id, start + used, total, own[used:])
        self.parts, self.held = rest, sum(len(p[3]) for p in rest)
        return out


def _pack(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, length: int) -> Iterator[pa.RecordBatch]:
    encode = encoder(tokenizer)
    schema = pa.schema([*[(n, pa.int64()) for n in _NAMES[:-1]], ("ids", pa.binary())])
    stream = Stream(Boundaries(encode, end_id), length, TaskContext.get().partitionId() * SEQUENCES_A_TASK)

    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

    for batch in batches:
        doc_ids = iter(batch.column("doc_id").to_pylist())
        for ids, ends in encode.encode_flat(batch.column("text").to_pylist(), end_id):
            for doc_id, own in zip(islice(doc_ids, len(ends)), np.split(ids, ends[:-1])):
                stream.add(doc_id, own)
                if stream.held >= BLOCK_TOKENS and (found := stream.pieces(last=False)):
                    yield rows(found)
    if found := stream.pieces(last=True):
        yield rows(found)


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, length: int = LENGTH,
         order_by: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents in sequences: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    ``ids`` holds the piece's ids as unsigned 32-bit little-endian bytes; ``sequence_id`` ascends in
    stream order within a task's stream and differs between tasks.
    """
    rows = texts(docs, id_col, text_col)
    if order_by is not None:
        order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc()]
        if order_by != id_col:
            rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                               F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(order_by).alias("_order"))
            order = [F.col("_order").asc_nulls_first(), *order]
        rows = rows.repartitionByRange(order[0]).sortWithinPartitions(*order).select("doc_id", "text")
    return rows.mapInArrow(partial(_pack, tokenizer=tokenizer or tokenizer_path(), end_id=end_id, length=length), PIECES)


def digested(pieces: DataFrame) -> DataFrame:
    """The pieces with the checksum of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(pack(table(spark, sf_dir, "documents")))


QUERIES = {"op9_dp_packing": (op9, None)}
