"""Whitening of embeddings by a bit-sliced scatter matrix.

Components are whole numbers x = floor(factor * c) + shift. Each dimension, less its least value, is cut into bit planes; a plane of
64 rows is one word. The sum of products of two dimensions is the sum over their planes a, b of 2**(a+b) times the set bits of
(plane a AND plane b): exact whatever the number of rows. Tasks add their blocks up and send one row per pair of dimensions, in limbs
of 48 bits that add up in longs. The driver, which gets these dims**2 / 2 numbers, centres them as integers, n * sum(xy) - sum(x) sum(y),
before the only rounding, and takes eigenvectors.

Left out are null vectors, vectors with a null or non-finite component (or one beyond 2**62 when scaled), and vectors of another than
the commonest number of components (of several, the largest). Repeated rows and null ids are rows like any other. A component whose
eigenvalue is zero but for rounding has no direction to be scaled: `whitened` and `explained` are 0 there, and `identity_error` leaves
it out. An empty table gives no row; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import in_arrow, stored
from tidemark.llm.vectors import Summary, WholeVectors

BLOCK = 1 << 15  # rows whose planes are compared at once
LIMIT = 1 << 62
LIMB, LIMBS = 48, 4


def bit_planes(y: np.ndarray, planes: list[int]) -> np.ndarray:
    """Words of 64 rows for every plane of every dimension; `y` holds values of at least 0 and a multiple of 64 rows."""
    cut = [np.packbits(((y[:, k, None] >> np.arange(n)) & 1).astype(np.uint8).T, axis=1, bitorder="little") for k, n in enumerate(planes)]
    return np.ascontiguousarray(np.concatenate(cut)).view(np.uint64)


def products(y: np.ndarray, planes: list[int]) -> tuple[list, list[list]]:
    """Exact sums of the dimensions, and of their products with themselves and all later ones."""
    padded = np.zeros((-(-len(y) // 64) * 64, y.shape[1]), np.int64)
    padded[:len(y)] = y
    words = bit_planes(padded, planes)
    starts = np.concatenate([[0], np.cumsum(planes)])
    small = 2 * max(planes) + BLOCK.bit_length() < 62
    kind = np.int64 if small else object
    weights = np.concatenate([np.array([1 << a for a in range(n)], kind) for n in planes])
    sums = np.add.reduceat(np.bitwise_count(words).sum(axis=1, dtype=np.int64).astype(kind) * weights, starts[:-1])
    out = []
    for k, first in enumerate(starts[:-1]):
        both = np.stack([np.bitwise_count(words[a] & words[first:]).sum(axis=1, dtype=np.int64) for a in range(first, starts[k + 1])])
        weighted = (both.astype(kind) * weights[first:starts[k + 1], None]).sum(axis=0) * weights[first:]
        out.append(np.add.reduceat(weighted, starts[k:-1] - first).tolist())
    return sums.tolist(), out


def scattered(batches: Iterator[pa.RecordBatch], summary: Summary, factor: int) -> Iterator[pa.RecordBatch]:
    """(i, j, limbs) of the sum of products of dimensions i and j; j = -1: of the sum of dimension i."""
    low, planes = np.array(summary.low), [max(1, (h - v).bit_length()) for v, h in zip(summary.low, summary.high)]
    sums, crossed = [0] * summary.dims, [[0] * (summary.dims - k) for k in range(summary.dims)]
    waiting, size = [], 0

    def flush():
        nonlocal waiting, size, sums, crossed
        y = np.concatenate(waiting)
        for at in range(0, len(y), BLOCK):
            more, pairs = products(y[at:at + BLOCK], planes)
            sums = [a + b for a, b in zip(sums, more)]
            crossed = [[a + b for a, b in zip(*both)] for both in zip(crossed, pairs)]
        waiting, size = [], 0

    for batch in batches:
        x = WholeVectors(batch.column(0), factor, LIMIT).matrix(summary.dims)
        waiting.append(x - low)
        size += len(x)
        if size >= BLOCK:
            flush()
    if size:
        flush()
    found = [(i, -1, v) for i, v in enumerate(sums)] + [(i, i + k, v) for i, row in enumerate(crossed) for k, v in enumerate(row)]
    limbs = [[(v >> (LIMB * k)) & ((1 << LIMB) - 1) for _, _, v in found] for k in range(LIMBS)]
    yield pa.record_batch([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int32()), *(pa.array(limb, pa.int64()) for limb in limbs)],
                          ["i", "j", *(f"l{k}" for k in range(LIMBS))])


class Whitening:
    """What the fit list says: exact sums, covariance, eigenvectors by falling eigenvalue."""

    def __init__(self, summary: Summary, totals: dict[tuple[int, int], int], components: int):
        self.n, dims = summary.n, summary.dims
        self.low, self.sums = summary.low, [totals[i, -1] for i in range(dims)]  # of the values less the least one
        cov = np.zeros((dims, dims))
        for (i, j), v in totals.items():
            if j >= 0:
                cov[i, j] = cov[j, i] = (self.n * v - self.sums[i] * self.sums[j]) / (self.n * self.n)
        values, vectors = np.linalg.eigh(cov)
        values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
        self.real = values > dims * np.finfo(np.float64).eps * max(values[0], 0.0)
        scale = np.where(self.real, 1 / np.sqrt(np.where(self.real, values, 1.0)), 0.0)
        self.vectors, self.scale = vectors, scale
        trace = float(np.trace(cov))
        self.explained = [float(v / trace) if r else 0.0 for v, r in zip(values, self.real)]
        far = [max(abs(self.n * (h - v) - s), s) for v, h, s in zip(summary.low, summary.high, self.sums)]
        self.small = sum(f * f for f in far) < 1 << 63 and all(self.n * (h - v) < 1 << 63 for v, h in zip(summary.low, summary.high))


def scatter(df: DataFrame, column: str, summary: Summary, factor: int) -> dict[tuple[int, int], int]:
    """The exact sums over all rows."""
    limbs = [f"l{k}" for k in range(LIMBS)]
    parts = in_arrow(df.select(column), lambda batches: scattered(batches, summary, factor), "i int, j int, " + ", ".join(f"{c} bigint" for c in limbs))
    rows = parts.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in limbs)).collect()
    return {(r["i"], r["j"]): sum(r[c] << (LIMB * k) for k, c in enumerate(limbs)) for r in rows}


def whitened_rows(batches: Iterator[pa.RecordBatch], fit: Whitening, dims: int, factor: int) -> Iterator[pa.RecordBatch]:
    low, kind = np.array(fit.low), np.int64 if fit.small else object
    sums = np.array(fit.sums, kind)
    for batch in batches:
        vectors = WholeVectors(batch.column(0), factor, LIMIT)
        z = (vectors.matrix(dims) - low).astype(kind) * fit.n - sums
        far = (z * z).sum(axis=1)
        deviation = pa.array(far).cast(pa.decimal128(38)) if fit.small else pa.array([Decimal(v) if v < 10**38 else None for v in far.tolist()], pa.decimal128(38))
        scores = ((z / fit.n).astype(np.float64) @ fit.vectors) * fit.scale
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * scores.shape[1], pa.int32()), pa.array(scores.ravel()))
        ids = batch.column(1).take(pa.array(vectors.rows(dims)))
        yield pa.RecordBatch.from_arrays([ids, deviation, lists], names=["id", "deviation", "scores"])


def identity_error(scores: DataFrame, width: list[int]) -> float:
    """The largest absolute entry of the covariance of `scores` at the places `width`, less the identity."""
    if not width:
        return 0.0
    at = [F.col("scores")[k] for k in width]
    means = scores.agg(*(F.avg(a) for a in at)).first()
    centred = [a - F.lit(m) for a, m in zip(at, means)]
    pairs = [(k, m) for k in range(len(at)) for m in range(k + 1)]
    found = scores.agg(*(F.avg(centred[k] * centred[m]) for k, m in pairs)).first()
    return max(abs(v - (k == m)) for v, (k, m) in zip(found, pairs))


def whiten(df: DataFrame, id: str = "vec_id", column: str = "embedding", factor: int = 1024, shift: int = 100_000, components: int = 8) -> DataFrame:
    """One row per remaining row and component: the id, `component`, `n`, `deviation` (decimal, null beyond 38 digits; `shift` leaves it as it
    is), `whitened`, `explained`, `identity_error`."""
    kind = dict(df.dtypes)[id]
    summary = Summary(df, column, factor, LIMIT - abs(shift))
    if not summary.n:
        return df.sparkSession.createDataFrame([], f"`{id}` {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double")
    fit = Whitening(summary, scatter(df, column, summary, factor), components)
    rows = in_arrow(df.select(column, id), lambda batches: whitened_rows(batches, fit, summary.dims, factor), f"id {kind}, deviation decimal(38,0), scores array<double>")
    rows = stored(rows, "whitened")
    error = identity_error(rows, np.flatnonzero(fit.real).tolist())
    each = rows.select("id", "deviation", F.posexplode("scores").alias("at", "whitened"))
    explained = F.array(*map(F.lit, fit.explained))
    return each.select(F.col("id").alias(id), (F.col("at") + 1).alias("component"), F.lit(fit.n).cast("bigint").alias("n"), "deviation", "whitened",
                       explained[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"))
