"""What the operators on embeddings share: whole-number vectors from Arrow batches, and rows laid out along a Hilbert curve.

A vector takes part if it is not null and all its components are there, finite and, times the factor, within the limit: beyond
that sums of products would not fit into a long, so such a component counts as not finite.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import in_arrow

AXES, BITS = 7, 9  # of the curve: 63 bits


class WholeVectors:
    """The vectors of a list column, every component times `factor` and rounded down."""

    def __init__(self, column: pa.Array, factor: int, limit: int):
        lists = column.cast(pa.large_list(pa.float64()))
        there = lists.is_valid().to_numpy(zero_copy_only=False)
        sizes = np.diff(np.frombuffer(lists.buffers()[1], np.int64, len(lists) + 1, lists.offset * 8)) if len(lists) else np.zeros(0, np.int64)
        sizes = np.where(there, sizes, 0)
        with np.errstate(over="ignore", invalid="ignore"):
            self.values = np.floor(factor * lists.flatten().fill_null(np.nan).to_numpy(zero_copy_only=False))
            wrong = np.concatenate([[0], np.cumsum(~(np.abs(self.values) <= limit))])
        ends = np.cumsum(sizes)
        self.starts = ends - sizes
        self.lengths = np.where(there & (wrong[ends] == wrong[self.starts]), sizes, -1)

    def rows(self, dims: int) -> np.ndarray:
        return np.flatnonzero(self.lengths == dims)

    def matrix(self, dims: int) -> np.ndarray:
        """The rows of `dims` components as longs."""
        return self.values[self.starts[self.rows(dims)][:, None] + np.arange(dims)].astype(np.int64)


def ranges(batches: Iterator[pa.RecordBatch], factor: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Per length and dimension: rows, least and largest component, least and largest place on each axis of the curve (dimension below -1)."""
    found: dict[tuple[int, int], list[int]] = {}
    for batch in batches:
        vectors = WholeVectors(batch.column(0), factor, limit)
        for dims in np.unique(vectors.lengths[vectors.lengths >= 0]).tolist():
            x = vectors.matrix(dims)
            for first, part in ((0, x), (-2, on_axes(x))):
                for k, (low, high) in enumerate(zip(part.min(axis=0).tolist(), part.max(axis=0).tolist())):
                    entry = found.setdefault((dims, first + k if first == 0 else first - k), [0, low, high])
                    entry[:] = entry[0] + len(x), min(entry[1], low), max(entry[2], high)
            found.setdefault((dims, -1), [0, 0, 0])[0] += len(x)
    columns = list(zip(*((*key, *entry) for key, entry in found.items()))) or [[]] * 5
    yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["length", "dim", "n", "low", "high"])


class Summary:
    """Rows, components per row and component ranges of the vectors that take part: those of `dims` components or, without it, of the
    commonest number of components (of several, the largest)."""

    def __init__(self, df: DataFrame, column: str, factor: int, limit: int, dims: int | None = None):
        each = in_arrow(df.select(column), lambda batches: ranges(batches, factor, limit), "length bigint, dim bigint, n bigint, low bigint, high bigint")
        total = each.groupBy("length", "dim").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        if dims is None:
            first = total.where("dim = -1 AND length > 0").orderBy(F.desc("n"), F.desc("length")).first()
            dims = first["length"] if first else 0
        rows = {r["dim"]: r for r in total.where(F.col("length") == dims).collect()}
        self.dims, self.n = dims, rows[-1]["n"] if dims and rows else 0
        of = (lambda name, dim: [rows[d][name] for d in dim]) if self.n else lambda name, dim: []
        self.low, self.high = of("low", range(dims)), of("high", range(dims))
        axes = range(-2, -2 - AXES, -1)
        self.axis_low, self.axis_high = of("low", axes), of("high", axes)
        self.largest = max(map(abs, self.low + self.high), default=0)


def on_axes(x: np.ndarray) -> np.ndarray:
    """Places on AXES axes of random signs: vectors close to each other are close there."""
    signs = np.random.default_rng(11).integers(0, 2, (x.shape[1], AXES)) * 2 - 1
    return x @ signs


def hilbert_places(cells: np.ndarray) -> np.ndarray:
    """Places along the Hilbert curve of rows of AXES cell numbers below 2**BITS, by rotating and reflecting from the coarsest bit down."""
    cells = cells.astype(np.int64).copy()
    step = 1 << (BITS - 1)
    while step > 1:
        below = step - 1
        for k in range(AXES):
            upper = (cells[:, k] & step) != 0
            swapped = np.where(upper, 0, (cells[:, 0] ^ cells[:, k]) & below)
            cells[:, 0] ^= np.where(upper, below, swapped)
            cells[:, k] ^= swapped
        step >>= 1
    for k in range(1, AXES):
        cells[:, k] ^= cells[:, k - 1]
    turned, step = np.zeros(len(cells), np.int64), 1 << (BITS - 1)
    while step > 1:
        turned ^= np.where(cells[:, -1] & step, step - 1, 0)
        step >>= 1
    cells ^= turned[:, None]
    places = np.zeros(len(cells), np.int64)
    for bit in reversed(range(BITS)):
        for k in range(AXES):
            places = (places << 1) | ((cells[:, k] >> bit) & 1)
    return places


def placed(batches: Iterator[pa.RecordBatch], summary: Summary, factor: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The other columns with `x`, the whole components, and `curve`, the place on the curve."""
    low = np.array(summary.axis_low, np.float64)
    width = np.maximum(np.array(summary.axis_high, np.float64) - low, 1.0)
    for batch in batches:
        vectors = WholeVectors(batch.column(0), factor, limit)
        rows, x = vectors.rows(summary.dims), vectors.matrix(summary.dims)
        cells = np.clip((on_axes(x) - low) / width * (1 << BITS), 0, (1 << BITS) - 1)
        taken = batch.take(pa.array(rows))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * summary.dims, pa.int32()), pa.array(x.ravel().astype(np.int32)))
        yield pa.RecordBatch.from_arrays([*taken.columns[1:], lists, pa.array(hilbert_places(cells))], names=[*taken.schema.names[1:], "x", "curve"])


def along_curve(df: DataFrame, column: str, summary: Summary, factor: int, limit: int, partitions: int | None = None) -> DataFrame:
    """The rows of `df` that take part, with `x array<int>` and `row`, a number of their own, range-partitioned and sorted along the
    curve. Equal vectors are told apart by `row`, so that any number of copies of one vector spreads over partitions."""
    others = [c for c in df.columns if c != column]
    numbered = df.select(column, *others, F.monotonically_increasing_id().alias("row"))
    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes if c != column), "row bigint", "x array<int>", "curve bigint"])
    rows = in_arrow(numbered, lambda batches: placed(batches, summary, factor, limit), schema)
    keys = ("curve", "row")
    return (rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)).sortWithinPartitions(*keys).drop("curve")
