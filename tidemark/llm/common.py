"""What the operators of this folder share: tables, stored intermediate results, words and text slices."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import ensure_checkpoint_dir

SLICE_BYTES = 2 << 20  # Python handles texts in slices of about this size, whatever an Arrow batch holds
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what separates the words of a text in which A-Z are lower case
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors see, below `spark.checkpoint.dir`."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written once as Parquet to a shared folder and read again: it is computed once, survives lost executors, and
    its size is known to the planner, which decides by it whether a join broadcasts."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def spare_names(df: DataFrame, *names: str) -> list[str]:
    """`names`, each lengthened until no column of `df` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def ship_library(spark: SparkSession) -> None:
    """Sends this library to the executors once per application: their Python workers import it."""
    context = spark.sparkContext
    if getattr(context, "_tidemark_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    name = os.path.join(tempfile.mkdtemp(prefix="spark-library-"), "tidemark-library")
    context.addPyFile(shutil.make_archive(name, "zip", root, "tidemark"))
    context._tidemark_shipped = True


def in_arrow(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """`df.mapInArrow`, with the library at hand where `fn` runs."""
    ship_library(df.sparkSession)
    return df.mapInArrow(fn, schema)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_between(text: Column, separators: str) -> Column:
    """The maximal stretches of `text` without a separator; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def null_safe_key(column: Column) -> Column:
    """A string that is never null and differs for null and for every value."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("null"))


# Bytes of words: digits, a-z, A-Z made small, and everything that is not ASCII; all else becomes a blank.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def text_slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Consecutive rows of a batch with their texts as UTF-8 (null: empty), each slice of about SLICE_BYTES or one row."""
    texts = batch.column(column).cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return
    ends = np.cumsum(np.diff(np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)))
    low = 0
    while low < len(texts):
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
        yield batch.slice(low, high - low), texts.slice(low, high - low).to_pylist()
        low = high
    pa.default_memory_pool().release_unused()
