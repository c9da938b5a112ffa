"""Log-probability of texts under a probabilistic suffix tree, smoothed with word frequencies.

Text is a stream of bytes in which A-Z are lower case and every token, a run of bytes other than white
space, is followed by one space; a line feed is the end token of a document.

The tree.  A context is a string of up to ``DEPTH`` bytes.  One pass counts, for every position, the byte
and the ``DEPTH`` bytes before it; counts of shorter contexts are sums of these.  A context s is retained
if it occurs at least ``LEAST_COUNT`` times, whatever the size of the corpus, and its next bytes diverge from
those after its longest proper suffix by ``DIVERGENCE`` bits or more (Kullback-Leibler).  Next-byte
distributions are smoothed towards the longest retained proper suffix (Witten-Bell), at the root towards
all bytes alike.  Scoring uses the longest retained suffix of what has been read.

Word frequencies.  A token's probability is ``TREE_WEIGHT`` times its bytes' under the tree plus the rest
times its add-one-half frequency among all training tokens.  Every document is read as if a line feed and a
space stood before it and nothing else, so its score does not depend on other rows of its block.  Tokens are known by 64-bit hashes.

Contexts and word frequencies are tables that grow with the corpus and are never sent whole to a task.  Both are
dealt into buckets, tokens by themselves, byte strings by their nearest bytes in common.  A task's counts go to
each bucket as one row of packed columns.  Documents are dealt into blocks as they are read; a block asks each
bucket for its distinct tokens and byte strings, one row again, and gets the counts of its own.  A retained suffix
of a context that a block meets is met at the same place, so a block's contexts are all that its distributions need.

Training texts are those whose crc32 of the id, modulo 5, is not 1.  Null and empty texts have the end token
only.  Repeated rows are scored, and learned from, each.  Without training texts all counts are 0.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gameline.llm.common import fold, stored, table, texts

DEPTH = 7  # with the next byte a number of 64 bits
LEAST_COUNT = 10
DIVERGENCE = 0.01
TREE_WEIGHT = 0.5
BLOCK_BYTES = 32 << 20
CHUNK_BYTES = 1 << 20
BUCKET_BYTES = 8 << 20
LEAST_BUCKETS = 64

#: Lengths of contexts that are judged, and asked for, together, longest first; the nearest bytes in common say which task does it.
_STEPS = ((DEPTH, 4), (4, 2), (2, 0))
_WORDS = len(_STEPS)  # the level of tokens; that of byte strings and contexts is their step, that of the root _ROOT
_ROOT = -1
_ZSTD = pa.Codec("zstd", compression_level=3)

_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
_LOWER = bytes.maketrans(_SPACE + bytes(range(65, 91)), b"\x20" * len(_SPACE) + bytes(range(97, 123)))
_START = b"\n "  # what stands before a document
_WORD_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _different(values: np.ndarray) -> np.ndarray:
    """Different numbers in order, by sorting: numpy's own way hashes, which is ten times slower on these."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


_POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(4095, _WORD_BASE)]), dtype=np.uint64)


@dataclass
class Tokens:
    """The stream of some documents: bytes after ``_START``, bounds of the tokens, tokens of each document."""

    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray  # where the token's space stands
    per_document: np.ndarray

    @staticmethod
    def of(documents: list[str]) -> Tokens:
        raw = b"".join([t.encode("utf-8", "surrogatepass").translate(_LOWER) + b" \n " for t in documents])
        data = np.frombuffer(_START + raw, dtype=np.uint8)
        kept = np.ones(len(data), dtype=bool)
        kept[1:] = (data[1:] != 32) | (data[:-1] != 32)
        data = data[kept]
        spaces = np.flatnonzero(data == 32)
        begin, end = spaces[:-1] + 1, spaces[1:]
        last = np.flatnonzero((data[begin] == 10))
        return Tokens(data, begin, end, np.diff(np.concatenate([[-1], last])))

    def hashes(self) -> np.ndarray:
        """A 64-bit number of each token."""
        if not len(self.begin):
            return np.empty(0, dtype=np.uint64)
        size = self.end - self.begin
        # the token's bytes and its space, weighted by powers of a base
        place = np.arange(self.begin[0], self.end[-1] + 1) - np.repeat(self.begin, size + 1)
        power = _POWERS[place & 4095]
        far = place > 4095
        if far.any():
            power = np.where(far, _mix(power + (place >> 12).astype(np.uint64)), power)
        sums = np.add.reduceat((self.data[self.begin[0]:self.end[-1] + 1].astype(np.uint64) + np.uint64(1)) * power, self.begin - self.begin[0])
        return _mix(sums + size.astype(np.uint64))

    def grams(self) -> np.ndarray:
        """For each byte after ``_START``: the ``DEPTH`` bytes before it and itself, as one number; 0 stands before a document's ``_START``."""
        return _grams(self.data)


_LOW = np.array([(1 << (8 * (i + 1))) - 1 for i in range(DEPTH + 1)], dtype=np.uint64)  # the lowest 1, 2, ... bytes


def _grams(data: np.ndarray) -> np.ndarray:
    n = len(data) - len(_START)
    # a document starts after a line feed, which ends the one before, and its space
    feed = np.maximum.accumulate(np.where(data[:n] == 10, np.arange(n), 0))
    own = np.arange(len(_START), len(data)) - feed
    out = np.concatenate([np.zeros(DEPTH, dtype=np.uint64), data.astype(np.uint64)])
    for half in (1, 2, 4):
        out = (out[:-half] << np.uint64(8 * half)) | out[half:]
    return (out[len(_START):] & _LOW[np.minimum(own, DEPTH)]).view(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of batches with about ``CHUNK_BYTES`` of text."""
    for batch in batches:
        size = np.array([len(t) if t is not None else 0 for t in batch.column("text").to_pylist()], dtype=np.int64)
        part = (np.cumsum(size) - size) // CHUNK_BYTES
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            if b > a:
                yield batch.slice(a, b - a)


class _Counter:
    """Counts of numbers, merged as they grow; ``drain`` gives what there is and starts again."""

    def __init__(self, bound: int = 4_000_000):
        self.keys, self.counts, self.bound = [], [], bound
        self.held = 0

    def add(self, values: np.ndarray, n: np.ndarray | None = None) -> None:
        if n is None:
            keys, counts = np.unique(values, return_counts=True)
        else:
            keys, counts = values, n
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)
        if self.held > self.bound:
            self.merge()

    def merge(self) -> None:
        if self.keys:
            keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
            order = np.argsort(keys)
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else order
            self.keys, self.counts = [keys[first]], [np.add.reduceat(counts, first) if len(keys) else counts]
            self.held = len(first)

    def drain(self) -> tuple[np.ndarray, np.ndarray]:
        self.merge()
        out = (self.keys[0], self.counts[0]) if self.keys else (np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64))
        self.keys, self.counts, self.held = [], [], 0
        return out


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers, compressed with their bytes of like worth together, after the lengths of the columns."""
    planes = b"".join([np.ascontiguousarray(c.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns])
    return np.array([len(columns), *map(len, columns)], dtype="<i8").tobytes() + _ZSTD.compress(planes, asbytes=True)


def _unpack(data: bytes) -> list[np.ndarray]:
    columns = int(np.frombuffer(data, "<i8", 1)[0])
    sizes = np.frombuffer(data, "<i8", columns, 8).tolist()
    planes = np.frombuffer(_ZSTD.decompress(memoryview(data)[8 * columns + 8:], 8 * sum(sizes)), dtype=np.uint8)
    ends = np.cumsum([0, *sizes]) * 8
    return [np.ascontiguousarray(planes[a:b].reshape(8, -1).T).view("<i8").reshape(-1) for a, b in zip(ends[:-1], ends[1:])]


def _dealt(near: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of its numbers, in order): numbers of one value fall into one bucket."""
    bucket = (_mix(near.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    for places in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        if len(places):
            yield int(bucket[places[0]]), places


def _near(keys: np.ndarray, level: int, after: int = 8) -> np.ndarray:
    """What deals tokens, or byte strings with ``after`` bits after the context, into buckets."""
    if level == _WORDS:
        return keys
    return (keys.view(np.uint64) >> np.uint64(after)) & _LOW[max(1, _STEPS[level][1]) - 1]


_COUNTS = "level int, bucket int, total long, data binary"


def _counts(level: int, buckets: int, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row of packed (keys, n) for each bucket."""
    for bucket, at in _dealt(_near(keys, level), buckets):
        yield pa.record_batch([pa.array([level], pa.int32()), pa.array([bucket], pa.int32()), pa.array([int(n[at].sum())], pa.int64()),
                               pa.array([_pack(keys[at], n[at])], pa.binary())], names=["level", "bucket", "total", "data"])


class _Distinct:
    """Different numbers, merged as they grow."""

    def __init__(self, bound: int = 4_000_000):
        self.parts, self.bound = [], bound

    def add(self, values: np.ndarray) -> None:
        self.parts.append(_different(values))
        if len(self.parts) > 1 and sum(map(len, self.parts[1:])) > max(self.bound - len(self.parts[0]), self.bound // 4):
            self.parts = [_different(np.concatenate(self.parts))]

    def drain(self) -> np.ndarray:
        out, self.parts = _different(np.concatenate(self.parts)), []
        return out


def _count(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Counts of the tokens and of the byte strings in a task's texts."""
    counters = {_WORDS: _Counter(2_000_000), 0: _Counter(6_000_000)}
    for chunk in _chunks(batches):
        tokens = Tokens.of(chunk.column("text").to_pylist())
        for level, values in ((_WORDS, tokens.hashes()), (0, tokens.grams())):
            counter = counters[level]
            counter.add(values)
            if counter.held > counter.bound * 3 // 4:
                counter.merge()
                if counter.held > counter.bound * 3 // 4:
                    yield from _counts(level, buckets, *counter.drain())
    for level, counter in counters.items():
        yield from _counts(level, buckets, *counter.drain())


def _given(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Packed counts of byte strings from rows (key, n)."""
    for batch in batches:
        yield from _counts(0, buckets, batch.column("key").to_numpy().view(np.uint64), batch.column("n").to_numpy())


def _plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, n) from packed counts."""
    for batch in batches:
        for data in batch.column("data"):
            keys, n = _unpack(data.as_py())
            for at in range(0, len(keys), 200_000):
                yield pa.record_batch([pa.array(keys[at:at + 200_000]), pa.array(n[at:at + 200_000])], names=["key", "n"])


_BLOCKS = "block long, kind int, level int, bucket int, data binary"


def _block_rows(block: int, kind: int, rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    level, bucket, data = zip(*rows)
    return pa.record_batch([pa.array([block] * len(rows), pa.int64()), pa.array([kind] * len(rows), pa.int32()), pa.array(level, pa.int32()),
                            pa.array(bucket, pa.int32()), pa.array(data, pa.binary())], names=["block", "kind", "level", "bucket", "data"])


def _questions(block: int, tokens: np.ndarray, grams: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """What a block asks of each bucket: its distinct tokens, and its distinct byte strings as long as the level's."""
    asked = [(_WORDS, tokens), *((level, _different(grams.view(np.uint64) & _LOW[longest])) for level, (longest, _) in enumerate(_STEPS))]
    for level, keys in asked:
        for bucket, at in _dealt(_near(keys, level), buckets):
            yield _block_rows(block, 1, [(level, bucket, _pack(keys[at]))])


def _packed_documents(chunk: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, chunk.schema, options=pa.ipc.IpcWriteOptions(compression=_ZSTD)) as stream:
        stream.write_batch(chunk)
    return sink.getvalue().to_pybytes()


def _documents(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    """A task's documents, packed, in blocks of about ``block_bytes``."""
    block, size = None, 0
    for chunk in _chunks(batches):
        if block is None or size >= block_bytes:
            block, size = int.from_bytes(os.urandom(8), "big") >> 1, 0
        chunk = pa.record_batch([chunk.column("doc_id"), chunk.column("text")], names=["doc_id", "text"])
        yield _block_rows(block, 2, [(_WORDS, 0, _packed_documents(chunk))])
        size += chunk.column("text").nbytes


def _ask(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """What blocks ask, from their packed documents; a block may be read in parts, which ask each for themselves."""
    now, tokens, grams = None, _Distinct(), _Distinct()
    for batch in batches:
        for block, data in zip(batch.column("block").to_pylist(), batch.column("data")):
            if now not in (None, block):
                yield from _questions(now, tokens.drain(), grams.drain(), buckets)
            now = block
            some = Tokens.of(_documents(data.as_py()).column("text").to_pylist())
            tokens.add(some.hashes())
            grams.add(some.grams())
    if now is not None:
        yield from _questions(now, tokens.drain(), grams.drain(), buckets)


@dataclass
class Contexts:
    """Retained contexts that some texts meet: sorted numbers, positions and kinds of next bytes; counts by context and byte."""

    keys: np.ndarray
    positions: np.ndarray
    kinds: np.ndarray
    nexts: np.ndarray  # place of the context times 256, plus the byte
    counts: np.ndarray

    @staticmethod
    def of(packed: list[bytes]) -> Contexts:
        """From packed contexts, their positions and kinds, how many of their next bytes follow, and these times 2**48 plus their counts."""
        none = [np.empty(0, dtype=np.int64)] * 5
        parts = [list(x) for x in zip(none, *map(_unpack, packed))]
        keys, positions, kinds, size, nexts = (np.concatenate(parts.pop(0)) for _ in range(5))
        order = np.argsort(keys)
        # a context may be given more than once, with the same counts
        first = np.concatenate([[True], np.diff(keys[order]) != 0])[:len(keys)]
        place = np.empty(len(keys), dtype=np.int64)
        place[order] = np.cumsum(first) - 1
        order = order[first]
        wanted = np.repeat(place, size)
        wanted *= 256
        wanted += nexts >> np.int64(48)
        nexts &= np.int64((1 << 48) - 1)
        inner = np.argsort(wanted)
        return Contexts(keys[order], positions[order], kinds[order], wanted[inner], nexts[inner])

    def met(self, grams: np.ndarray, longest: int, shortest: int) -> bytes:
        """Of the contexts longer than ``shortest``, those that byte strings of ``longest`` + 1 bytes meet, with the next bytes met, packed."""
        found = [[np.empty(0, dtype=np.int64)] * 5]
        for length in range(shortest + 1, longest + 1):
            some = _different(grams.view(np.uint64) & _LOW[length])
            key = (some >> np.uint64(8)).view(np.int64) | np.int64(length << 56)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            here = self.keys[at] == key
            at, byte = at[here], (some[here] & np.uint64(255)).astype(np.int64)
            if not len(at):
                continue
            wanted = at * 256 + byte
            near = np.minimum(np.searchsorted(self.nexts, wanted), len(self.nexts) - 1)
            seen = self.nexts[near] == wanted
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            own = at[first]
            found.append([self.keys[own], self.positions[own], self.kinds[own], np.add.reduceat(seen.astype(np.int64), first),
                          (byte[seen] << 48) | self.counts[near[seen]]])
        return _pack(*(np.concatenate(x) for x in zip(*found)))

    def logs(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each gram under the longest retained suffix of the bytes before it."""
        some, links = grams.view(np.uint64), []
        for length in range(DEPTH, -1, -1):  # the different strings of each length, and where each one's suffix stands among the next
            some, back = np.unique(some & _LOW[length], return_inverse=True)
            links.append((length, some, back))
        p = np.full(len(some), 1 / 256)
        for length, some, back in reversed(links):
            if len(self.keys) and len(some):
                key = (some >> np.uint64(8)).view(np.int64) | np.int64(length << 56)
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                met = np.flatnonzero(self.keys[at] == key)
                at = at[met]
                wanted = at * 256 + (some[met] & np.uint64(255)).astype(np.int64)
                near = np.minimum(np.searchsorted(self.nexts, wanted), len(self.nexts) - 1)
                n = np.where(self.nexts[near] == wanted, self.counts[near], 0)
                p[met] = (n + self.kinds[at] * p[met]) / (self.positions[at] + self.kinds[at])
            p = (p if length < DEPTH else np.log10(p))[back]
        return p


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """To what blocks ask of buckets: the counts of tokens that are known, the contexts that are met. A bucket's own rows (kind 0) come first."""
    now, held, known = None, [], None
    for batch in batches:
        for block, kind, level, bucket, data in zip(*(batch.column(c).to_pylist() for c in ("block", "kind", "level", "bucket", "data"))):
            if (level, bucket) != now:
                now, held, known = (level, bucket), [], None
            if kind == 0:
                held.append(data)
                continue
            if not held:
                continue
            asked = _unpack(data)[0]
            if level != _WORDS:
                known = known or Contexts.of(held)
                yield _block_rows(block, 1, [(level, bucket, known.met(asked, *_STEPS[level]))])
                continue
            if known is None:
                keys, n = (np.concatenate(x) for x in zip(*map(_unpack, held)))
                order = np.argsort(keys)
                known = keys[order], n[order]
            at = np.minimum(np.searchsorted(known[0], asked), len(known[0]) - 1)
            here = known[0][at] == asked
            yield _block_rows(block, 1, [(level, bucket, _pack(asked[here], known[1][at[here]]))])


def _answers(known: DataFrame, asked: DataFrame) -> DataFrame:
    """What blocks get from the buckets' rows (level, bucket, data)."""
    rows = known.select(F.lit(None).cast("long").alias("block"), F.lit(0).alias("kind"), "level", "bucket", "data").unionByName(asked)
    return _by(rows, "level", "bucket").sortWithinPartitions("level", "bucket", "kind").mapInArrow(_answer, _BLOCKS)


def _by(rows: DataFrame, *columns: str) -> DataFrame:
    """Dealt by columns into as many pieces as a shuffle has, whatever their size: the rows are packed."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


@dataclass
class SuffixTree:
    """The retained contexts as a table: rows of packed contexts by level and bucket, the root at level ``_ROOT``."""

    table: DataFrame
    buckets: int

    @property
    def contexts(self) -> int:
        return self.table.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]

    def root(self) -> list[bytes]:
        return [bytes(r.data) for r in self.table.where(F.col("level") == _ROOT).select("data").collect()]  # one row, if any

    def logs(self, data: np.ndarray) -> np.ndarray:
        """log10 probability of each byte after the first len(_START) of one short stream, on the driver."""
        grams = _grams(data)
        asked = [r for b in _questions(0, np.empty(0, dtype=np.uint64), grams, self.buckets) for r in zip(*(c.to_pylist() for c in b.columns))]
        rows = _answers(self.table.select("level", "bucket", "data"), self.table.sparkSession.createDataFrame(asked, _BLOCKS)).collect()
        return Contexts.of([*self.root(), *(bytes(r.data) for r in rows)]).logs(grams)


def _distributions(rows: list[tuple[int, int, int, int]]) -> dict[bytes, np.ndarray]:
    """Smoothed next-byte probabilities of retained contexts, from (length, context, next byte, count)."""
    counts: dict[bytes, np.ndarray] = {b"": np.zeros(256)}
    for length, context, byte, n in rows:
        counts.setdefault(int(context).to_bytes(8, "big")[8 - length:], np.zeros(256))[byte] += n
    out: dict[bytes, np.ndarray] = {}
    for s in sorted(counts, key=len):
        c = counts[s]
        parent = next((out[s[i:]] for i in range(1, len(s) + 1) if s[i:] in out), np.full(256, 1 / 256)) if s else np.full(256, 1 / 256)
        kinds = max(1, int(np.count_nonzero(c)))
        out[s] = (c + kinds * parent) / (c.sum() + kinds)
    return out


def _judged(level: int, bucket: int, own: bool, size: int, total: int, data: bytes) -> pa.RecordBatch:
    return pa.record_batch([pa.array([level], pa.int32()), pa.array([bucket], pa.int32()), pa.array([own]), pa.array([size], pa.int64()),
                            pa.array([total], pa.int64()), pa.array([data], pa.binary())],
                           names=["level", "bucket", "own", "size", "total", "data"])


_JUDGED = "level int, bucket int, own boolean, size long, total long, data binary"


def _judge(batches: Iterator[pa.RecordBatch], least: float, divergence: float, buckets: int) -> Iterator[pa.RecordBatch]:
    """Of each bucket's counts: of tokens, their sums; of byte strings, the retained contexts of the level's lengths, both packed.

    Sums for the next level are not ``own``; the last level gives the root.
    """
    now, held = None, _Counter()
    for batch in batches:
        for level, bucket, data in zip(*(batch.column(c).to_pylist() for c in ("level", "bucket", "data"))):
            if now not in (None, (level, bucket)):
                yield from _judge_bucket(*now, *held.drain(), least, divergence, buckets)
            now = level, bucket
            keys, n = _unpack(data)
            held.add(keys.view(np.uint64), n)
    if now is not None:
        yield from _judge_bucket(*now, *held.drain(), least, divergence, buckets)


def _judge_bucket(level: int, bucket: int, g: np.ndarray, n: np.ndarray, least: float, divergence: float,
                  buckets: int) -> Iterator[pa.RecordBatch]:
    if level == _WORDS:
        yield _judged(level, bucket, True, len(g), int(n.sum()), _pack(g, n))
        return
    longest, shortest = _STEPS[level]
    eight, low = np.uint64(8), np.uint64(255)
    found = [[np.empty(0, dtype=np.int64)] * 5]

    def grouped(g: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first = np.flatnonzero(np.concatenate([[True], (g[1:] >> eight) != (g[:-1] >> eight)]))
        return first, np.diff(np.append(first, len(g))), np.add.reduceat(n, first)

    for length in range(longest, shortest, -1) if len(g) else ():
        shorter, back = np.unique(g & _LOW[length - 1], return_inverse=True)
        m = np.bincount(back, n).astype(np.int64)
        first, size, positions = grouped(g, n)
        _, parent_size, parent_positions = grouped(shorter, m)
        p = n / np.repeat(positions, size)
        q = (m / np.repeat(parent_positions, parent_size))[back]
        kept = (positions >= least) & (np.add.reduceat(p * np.log2(p / q), first) >= divergence)
        mine = np.repeat(kept, size)
        found.append([(g[first][kept] >> eight).view(np.int64) | np.int64(length << 56), positions[kept], size[kept], size[kept],
                      ((g & low).astype(np.int64) << 48)[mine] + n[mine]])
        g, n = shorter, m
    keys, positions, kinds, size, nexts = (np.concatenate(x) for x in zip(*found))
    ends = np.concatenate([[0], np.cumsum(size)])
    for of, at in _dealt(_near(keys, level, after=0), buckets):
        here = np.repeat(ends[at] - np.cumsum(size[at]) + size[at], size[at]) + np.arange(size[at].sum())
        yield _judged(level, of, True, len(at), int(positions[at].sum()), _pack(keys[at], positions[at], kinds[at], size[at], nexts[here]))
    if len(g) and shortest:
        last = level + 2 == len(_STEPS)  # the last step has at most 256**3 byte strings, whatever the corpus, and is one bucket
        for of, at in _dealt(_near(g, level + 1), 1 if last else buckets):
            yield _judged(level + 1, of, False, len(at), int(n[at].sum()), _pack(g[at], n[at]))
    elif len(g):
        all_, one = np.array([len(g)]), np.zeros(1, dtype=np.int64)
        yield _judged(_ROOT, 0, True, 1, int(n.sum()), _pack(one, np.array([n.sum()]), all_, all_, (g.astype(np.int64) << 48) + n))


def _kept(counts: DataFrame, least: float, divergence: float, buckets: int) -> DataFrame:
    """Packed contexts that pass both tests, and sums of tokens, by level and bucket, from packed counts."""
    out = None
    for _ in _STEPS:
        found = stored(_by(counts, "level", "bucket").sortWithinPartitions("level", "bucket")
                       .mapInArrow(partial(_judge, least=least, divergence=divergence, buckets=buckets), _JUDGED), "contexts", compression="none")
        counts = found.where("NOT own").select("level", "bucket", "data")
        found = found.where("own")
        out = found if out is None else out.unionByName(found)
    return out


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(length, context, byte, n) of packed contexts."""
    for batch in batches:
        for data in batch.column("data"):
            keys, _, _, size, nexts = _unpack(data.as_py())
            key = np.repeat(keys, size)
            for at in range(0, len(key), 200_000):
                k, x = key[at:at + 200_000], nexts[at:at + 200_000]
                yield pa.record_batch([pa.array((k >> 56).astype(np.int32)), pa.array(k & np.int64((1 << 56) - 1)),
                                       pa.array((x >> 48).astype(np.int32)), pa.array(x & np.int64((1 << 48) - 1))],
                                      names=["length", "context", "byte", "n"])


def retained(grams: DataFrame, least_share: float = 0.0, divergence: float = DIVERGENCE, least_count: int = LEAST_COUNT) -> DataFrame:
    """(length, context, byte, n) of the contexts that pass both tests, from counts (key, n) of byte strings."""
    counts = grams.select("key", "n").mapInArrow(partial(_given, buckets=LEAST_BUCKETS), _COUNTS)
    kept = _kept(counts, _least(counts, least_share, least_count), divergence, LEAST_BUCKETS)
    return kept.select("data").mapInArrow(_listed, "length int, context long, byte int, n long")


def _least(counts: DataFrame, least_share: float, least_count: int) -> float:
    """Positions a context needs; a share of all positions, asked for besides, keeps a tree from growing with the corpus."""
    if not least_share:
        return least_count
    return max(least_count, least_share * counts.where("level = 0").agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0])


def _score(batches: Iterator[pa.RecordBatch], words: int, distinct: int, tree_weight: float, root: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Scores of the documents of blocks; the counts of a block's tokens and contexts come before its documents."""
    floor = words + 0.5 * (distinct + 1)
    now, counts, met, tree = None, [], [], None
    for batch in batches:
        for block, kind, level, data in zip(*(batch.column(c) for c in ("block", "kind", "level", "data"))):
            block, data = block.as_py(), data.as_py()
            if block != now:
                now, counts, met, tree = block, [], [*root], None
            if kind.as_py() == 1:
                (counts if level.as_py() == _WORDS else met).append(data)
                continue
            if tree is None:
                known, number = (np.concatenate(x) for x in zip([np.empty(0, dtype=np.int64)] * 2, *map(_unpack, counts)))
                order = np.argsort(known.view(np.uint64))
                known, number = known.view(np.uint64)[order], number[order]
                tree, met, counts = Contexts.of(met), [], []
            chunk = _documents(data)
            tokens = Tokens.of(chunk.column("text").to_pylist())
            own = tokens.hashes()
            at = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
            c = np.where(known[at] == own, number[at], 0) if len(known) else np.zeros(len(own), dtype=np.int64)
            share = (c + 0.5) / floor
            logs = tree.logs(tokens.grams())
            by_tree = np.power(10.0, np.add.reduceat(logs, tokens.begin - len(_START)))
            scores = np.log10(tree_weight * by_tree + (1 - tree_weight) * share)
            first = np.cumsum(tokens.per_document) - tokens.per_document
            yield pa.record_batch(
                [chunk.column("doc_id"), pa.array(tokens.per_document), pa.array(np.add.reduceat((c > 0).astype(np.int64), first)),
                 pa.array(np.add.reduceat(np.log10(share), first)), pa.array(np.add.reduceat(scores, first))],
                names=["doc_id", "n_tokens", "n_known", "base_score", "score"])


_SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _bucket_number(docs: DataFrame) -> int:
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    return max(LEAST_BUCKETS, -(-size // BUCKET_BYTES))


def train(docs: DataFrame, least_share: float = 0.0, divergence: float = DIVERGENCE,
          least_count: int = LEAST_COUNT) -> tuple[DataFrame, SuffixTree, int, int]:
    """Token counts, packed (``token_counts`` lists them), the tree, and the numbers of tokens and of distinct tokens, from the texts given."""
    buckets = _bucket_number(docs)
    counts = docs.select("text").mapInArrow(partial(_count, buckets=buckets), _COUNTS)
    kept = _kept(counts.select("level", "bucket", "data"), _least(counts, least_share, least_count), divergence, buckets)
    words, contexts = kept.where(F.col("level") == _WORDS), kept.where(F.col("level") != _WORDS)
    total, distinct = words.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    return words.select("level", "bucket", "data"), SuffixTree(contexts, buckets), total, distinct


def token_counts(words: DataFrame) -> DataFrame:
    """(key, n) of packed token counts."""
    return words.select("data").mapInArrow(_plain, "key long, n long")


def score(docs: DataFrame, words: DataFrame, tree: SuffixTree, total: int, distinct: int,
          tree_weight: float = TREE_WEIGHT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every row of (doc_id, text)."""
    blocks = stored(docs.select("doc_id", "text").mapInArrow(partial(_blocks, block_bytes=block_bytes), _BLOCKS), "blocks", compression="none")
    asked = blocks.select("block", "data").mapInArrow(partial(_ask, buckets=tree.buckets), _BLOCKS)
    known = words.unionByName(tree.table.where(F.col("level") != _ROOT).select("level", "bucket", "data"))
    rows = _answers(known, asked).unionByName(blocks)
    pieces = 3 * max(1, blocks.agg(F.countDistinct("block")).first()[0])
    return (rows.repartition(pieces, "block").sortWithinPartitions("block", "kind")
            .mapInArrow(partial(_score, words=total, distinct=distinct, tree_weight=tree_weight, root=tree.root()), _SCORES))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(table(spark, sf_dir, "documents"))
    words, tree, total, distinct = train(docs.where(fold(F.col("doc_id")) != 1))
    found = score(docs, words, tree, total, distinct)
    return found.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "n_tokens", "n_known",
                        F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


QUERIES = {"op2_suffix_tree": (op2, None)}
