"""Token ids in Arrow files of fixed-size lists, read back by position without copying.

The stream of ids, every document followed by its end id, is cut into sequences of `length`. A file holds record batches
of two fixed-size-list columns, `ids` and `mask` (true where there is a token, false in the padding behind the file's last one),
so sequence k of a file is found by its number alone. Beside each token file lies an index file with the documents in it:
`doc_id`, `start` (ids before it in this file) and `n_tokens`. Files follow each other in ascending `doc_id`.

A task writes to names of its own attempt and renames at the end, so a lost or repeated task leaves one whole file.
Null texts are empty documents; a null id comes first; rows of one id lie together, ordered by text; an empty table
gives no file and no row; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.ipc as ipc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import in_arrow, in_arrow, shared_folder, stored, text_slices
from tidemark.llm.tokens import encoder

BATCH_SEQUENCES = 256
MANIFEST = "file string, part int, n_tokens bigint, n_docs bigint"
ROWS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def id_type(vocabulary: int) -> pa.DataType:
    """The smallest type for the ids; uint16 where they fit."""
    return pa.uint16() if vocabulary <= 1 << 16 else pa.uint32()


def lists(values: np.ndarray, kind: pa.DataType, length: int) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(values, kind), length)


class TokenFile:
    """Appends ids to an Arrow file, whole sequences at a time."""

    def __init__(self, sink, kind: pa.DataType, length: int):
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.writer, self.kind, self.length = ipc.new_file(sink, self.schema), kind, length
        self.rest, self.n_tokens = np.zeros(0, kind.to_pandas_dtype()), 0

    def append(self, ids: np.ndarray):
        self.n_tokens += len(ids)
        ids = np.concatenate([self.rest, ids.astype(self.rest.dtype)])
        step = self.length * BATCH_SEQUENCES
        whole = len(ids) // step * step
        for low in range(0, whole, step):
            self.batch(ids[low:low + step], step)
        self.rest = ids[whole:]

    def batch(self, ids: np.ndarray, real: int):
        mask = np.arange(len(ids)) < real
        self.writer.write_batch(pa.record_batch([lists(ids, self.kind, self.length), lists(mask, pa.bool_(), self.length)], schema=self.schema))

    def close(self):
        if len(self.rest):
            padded = np.zeros(-(-len(self.rest) // self.length) * self.length, self.rest.dtype)
            padded[:len(self.rest)] = self.rest
            self.batch(padded, len(self.rest))
        self.writer.close()


def write_part(batches: Iterator[pa.RecordBatch], folder: str, path: str, end_id: int, length: int) -> Iterator[pa.RecordBatch]:
    """Writes this task's documents in their order and yields one manifest row, or none for no document."""
    files, root = fs.FileSystem.from_uri(folder)
    tokens = encoder(path, (end_id,))
    part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
    name, index_schema = f"part-{part:06d}", pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
    out, n_docs = None, 0
    for batch in batches:
        for rows, texts in text_slices(batch, "text"):
            if out is None:
                files.create_dir(root)
                sinks = [files.open_output_stream(f"{root}/.{name}-{attempt}.{kind}") for kind in ("tokens", "index")]
                out, index = TokenFile(sinks[0], id_type(tokens.vocabulary), length), ipc.new_file(sinks[1], index_schema)
            ids, counts = tokens.encode(texts)
            starts = out.n_tokens + np.cumsum(counts) - counts
            index.write_batch(pa.record_batch([rows.column("doc_id").cast(pa.int64()), pa.array(starts), pa.array(counts)], schema=index_schema))
            out.append(ids)
            n_docs += len(texts)
    if out is None:
        return
    out.close()
    index.close()
    for sink, kind in zip(sinks, ("tokens", "index")):
        sink.close()
        files.move(f"{root}/.{name}-{attempt}.{kind}", f"{root}/{name}.{kind}.arrow")
    yield pa.record_batch([pa.array([f"{folder}/{name}"]), pa.array([part], pa.int32()), pa.array([out.n_tokens]), pa.array([n_docs])],
                          ["file", "part", "n_tokens", "n_docs"])


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int, length: int = 2048, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes all documents and returns the stored manifest: a row per token file."""
    named = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ordered = named.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stored(in_arrow(ordered, lambda batches: write_part(batches, folder, path, end_id, length), MANIFEST), "token-files")


def slices(reader: ipc.RecordBatchFileReader, length: int, starts: np.ndarray, counts: np.ndarray) -> Iterator[list[np.ndarray]]:
    """The ids of each document as views of the file's batches; random access: batch and place follow from `start`."""
    step, number, held = length * BATCH_SEQUENCES, -1, None
    for start, count in zip(starts.tolist(), counts.tolist()):
        views = []
        while count:
            if start // step != number:
                number = start // step
                held = reader.get_batch(number).column("ids").flatten().to_numpy(zero_copy_only=True)
            views.append(held[start % step:start % step + count])
            start, count = start + len(views[-1]), count - len(views[-1])
        yield views


def read_part(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, before in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist()):
            files, name = fs.FileSystem.from_uri(file)
            local = isinstance(files, fs.LocalFileSystem)
            open_ = pa.memory_map if local else files.open_input_file
            with open_(f"{name}.tokens.arrow") as source, open_(f"{name}.index.arrow") as index_source:
                reader, index = ipc.open_file(source), ipc.open_file(index_source)
                for k in range(index.num_record_batches):
                    rows = index.get_batch(k)
                    starts, counts = (rows.column(c).to_numpy() for c in ("start", "n_tokens"))
                    sums = []
                    for views in slices(reader, length, starts, counts):
                        crc = 0
                        for view in views:
                            crc = zlib.crc32(view.astype("<u4").tobytes(), crc)
                        sums.append(crc)
                    yield pa.record_batch([rows.column("doc_id"), pa.array(starts + before), pa.array(counts), pa.array(sums, pa.int64())],
                                          ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(manifest: DataFrame, length: int = 2048) -> DataFrame:
    """A row per document from the files: `start` counts the ids of all documents before it, over all files."""
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    placed = manifest.select("file", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)).alias("before"))
    # As many tasks as files: left to itself, the planner would read all of them in one, as the manifest is small.
    spread = placed.repartition(max(1, manifest.count()), "file")
    return in_arrow(spread, lambda batches: read_part(batches, length), ROWS)


def token_file_round_trip(docs: DataFrame, path: str, end_id: int, length: int = 2048) -> DataFrame:
    manifest = write_token_files(docs, shared_folder(docs.sparkSession, "tokens"), path, end_id, length)
    return read_token_files(manifest, length)
