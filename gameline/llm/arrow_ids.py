"""Token ids as Arrow files of equal-length sequences with masks.

Documents are encoded in ascending id order and their ids written one after the other, cut into
sequences of ``length``.  A file is an Arrow IPC file; each of its batches holds

* ``ids``: fixed-size lists of ``length`` unsigned integers, as narrow as the vocabulary allows,
* ``mask``: fixed-size lists of ``length`` booleans, false on the padding of a file's last sequence.

Beside each file lies an index file with the documents in it: ``doc_id, start, n_tokens``, where
``start`` counts ids from the file's beginning.  Reading maps the file, so a sequence is a view.

Each task writes files under names of its own attempt, and only files named in the manifest, which
Spark commits, belong to the result: a lost executor or a second attempt leaves no trace in it.

Null texts are empty, and an empty text has only the end id.  Rows with the same id stand next to
each other, ordered by text; a null id comes first.  An empty table gives an empty manifest.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gameline.llm.common import new_folder, stored, table, texts
from gameline.llm.encoding import encoder, tokenizer_path

LENGTH = 2048
SEQUENCES_A_BATCH = 128

MANIFEST = "part long, path string, n_ids long, n_docs long"
FOUND = "doc_id long, start long, n_tokens long, ids binary"


def _schema(length: int, narrow: bool) -> pa.Schema:
    kind = pa.uint16() if narrow else pa.uint32()
    return pa.schema([("ids", pa.list_(pa.field("item", kind, nullable=False), length)),
                      ("mask", pa.list_(pa.field("item", pa.bool_(), nullable=False), length))])


def _batch(schema: pa.Schema, ids: np.ndarray, length: int) -> pa.RecordBatch:
    """A batch of whole sequences; what is missing in the last one is padding."""
    rows = -(-len(ids) // length)
    padded = np.zeros(rows * length, dtype=schema.field("ids").type.value_type.to_pandas_dtype())
    padded[:len(ids)] = ids
    columns = (pa.array(padded), pa.array(np.arange(len(padded)) < len(ids)))
    return pa.record_batch([pa.FixedSizeListArray.from_arrays(c, type=schema.field(i).type)
                            for i, c in enumerate(columns)], schema=schema)


def _write(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, end_id: int,
           length: int) -> Iterator[pa.RecordBatch]:
    """One file for the rows of a task, which come in order."""
    encode = encoder(tokenizer)
    narrow = max(encode.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16
    schema, part = _schema(length, narrow), TaskContext.get().partitionId()
    store, top = fs.FileSystem.from_uri(folder)
    store.create_dir(top, recursive=True)
    path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.arrow"
    index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
    full = length * SEQUENCES_A_BATCH
    waiting, held, n_ids, n_docs, writers = [], 0, 0, 0, None
    try:
        for batch in batches:
            if writers is None and batch.num_rows:
                outs = [store.open_output_stream(fs.FileSystem.from_uri(p)[1]) for p in (path, f"{path}.index")]
                writers = [pa.ipc.new_file(outs[0], schema), pa.ipc.new_file(outs[1], index_schema)]
            at = 0
            for ids, ends in encode.encode_flat(batch.column("text").to_pylist(), end_id):
                sizes = np.diff(ends, prepend=0)
                writers[1].write_batch(pa.record_batch([batch.column("doc_id").slice(at, len(ends)), n_ids + ends - sizes, sizes],
                                                       schema=index_schema))
                at, n_ids, n_docs = at + len(ends), n_ids + len(ids), n_docs + len(ends)
                waiting.append(ids)
                held += len(ids)
                if held >= full:
                    ids = np.concatenate(waiting)
                    for begin in range(0, held - held % full, full):
                        writers[0].write_batch(_batch(schema, ids[begin:begin + full], length))
                    waiting = [ids[held - held % full:]]
                    held %= full
        if held:
            writers[0].write_batch(_batch(schema, np.concatenate(waiting), length))
    finally:
        if writers is not None:
            for w in (*writers, *outs):
                w.close()
    if writers is not None:
        yield pa.record_batch([[part], [path], [n_ids], [n_docs]], names=["part", "path", "n_ids", "n_docs"])


def write_sequences(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, end_id: int = 2,
                    length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode all texts, write the files, and return the manifest: part, path, n_ids, n_docs."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "token-ids")
    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc()]
    write = partial(_write, folder=folder, tokenizer=tokenizer or tokenizer_path(), end_id=end_id, length=length)
    ordered = (texts(docs, id_col, text_col).repartitionByRange(order[0]).sortWithinPartitions(*order))
    return stored(ordered.mapInArrow(write, MANIFEST), "token-ids-manifest")


class SequenceFile:
    """Random access to the sequences of one file."""

    def __init__(self, path: str):
        store, inside = fs.FileSystem.from_uri(path)
        source = pa.memory_map(inside) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(inside)
        self.reader = pa.ipc.open_file(source)
        index = store.open_input_file(f"{inside}.index")
        self.documents = pa.ipc.open_file(index).read_all()

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of a sequence; the ids are a view of the file."""
        batch = self.reader.get_batch(i // SEQUENCES_A_BATCH)
        row = i % SEQUENCES_A_BATCH
        ids, mask = batch.column("ids"), batch.column("mask")
        n = ids.type.list_size
        return ids.values.slice(row * n, n).to_numpy(zero_copy_only=True), mask.values.slice(row * n, n)

    def ids(self) -> Iterator[np.ndarray]:
        """The ids batch by batch, without padding."""
        for b in range(self.reader.num_record_batches):
            batch = self.reader.get_batch(b)
            kept = batch.column("mask").values.true_count
            yield batch.column("ids").values.to_numpy(zero_copy_only=True)[:kept]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for base, path in zip(batch.column("base").to_pylist(), batch.column("path").to_pylist()):
            file = SequenceFile(path)
            parts, buffer, at = file.ids(), b"", 0
            for docs in file.documents.to_batches(max_chunksize=1000):
                out = []
                for n in docs.column("n_tokens").to_pylist():
                    if len(buffer) - at < 4 * n:
                        pieces, have, at = [buffer[at:]], len(buffer) - at, 0
                        while have < 4 * n:
                            pieces.append(next(parts).astype("<u4").tobytes())
                            have += len(pieces[-1])
                        buffer = b"".join(pieces)
                    out.append(buffer[at:at + 4 * n])
                    at += 4 * n
                starts = pa.array(docs.column("start").to_numpy() + base)
                yield pa.record_batch([docs.column("doc_id"), starts, docs.column("n_tokens"), pa.array(out, pa.binary())],
                                      names=["doc_id", "start", "n_tokens", "ids"])


def read_documents(manifest: DataFrame) -> DataFrame:
    """Read the files back: doc_id, start (ids of all documents before it), n_tokens, ids (unsigned 32-bit, little-endian)."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    based = manifest.select("part", "path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    return based.repartition(max(1, manifest.count()), "part").mapInArrow(_read, FOUND)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read_documents(write_sequences(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op7_arrow_ids": (op7, None)}
