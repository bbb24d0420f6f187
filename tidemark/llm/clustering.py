"""Lloyd clustering over zone maps along a space-filling curve.

Vectors become whole numbers floor(factor * x), are ordered along a Hilbert curve and cut into blocks of BLOCK rows with the least and
largest value of every dimension: a box. A centroid's distance to a box is at least that to its nearest point and at most that to its
farthest corner; the centroids whose least distance is within the smallest such most are the block's candidates, and only these are
compared, exactly, with its rows. The blocks are stored once; each round reads them, adds up counts and sums per task and then over
all, and the k centroids, which are the only thing kept on the driver, move to the exact floor of the mean.

Left out are vectors that are null, hold a null or non-finite component (or one beyond 2**26 when scaled), or have not exactly `dims`
components. Rows are drawn as first centroids by the hash of their id; of equal ids by the vector, and null ids come last. With fewer
rows than k there are that many centroids. Repeated rows are rows like any other. An empty table gives no row; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import in_arrow, stored
from tidemark.llm.vectors import Summary, along_curve

BLOCK = 128
LIMIT = 1 << 26


def int_lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel().astype(np.int32)))


def blocked(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    """Rows `ids`, `x` (flat), `low`, `high` of consecutive rows."""
    for batch in batches:
        x = batch.column("x").flatten().to_numpy().reshape(-1, dims)
        for at in range(0, len(x), BLOCK):
            part, ids = x[at:at + BLOCK], batch.column("id").slice(at, BLOCK)
            ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            yield pa.RecordBatch.from_arrays([ids, int_lists(part.reshape(1, -1)), int_lists(part.min(axis=0)[None]), int_lists(part.max(axis=0)[None])], names=["ids", "x", "low", "high"])


class Centroids:
    """Exact distances: in doubles while all sums stay below 2**53, else in longs."""

    def __init__(self, places: list[list[int]], largest: int):
        self.kind = np.float64 if largest <= 1 << 22 else np.int64
        self.places = np.array(places, self.kind)
        self.lengths = (self.places ** 2).sum(axis=1)

    def candidates(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        below, above = low - self.places, self.places - high
        least = (np.maximum(np.maximum(below, above), 0) ** 2).sum(axis=1)
        most = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(axis=1)
        return np.flatnonzero(least <= most.min())

    def nearest(self, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of and squared distance to the nearest centroid, of several the first, for every row of a block."""
        some = self.candidates(low.astype(self.kind), high.astype(self.kind))
        x = x.astype(self.kind)
        distance = (x ** 2).sum(axis=1)[:, None] - 2 * (x @ self.places[some].T) + self.lengths[some]
        first = distance.argmin(axis=1)
        return some[first], distance[np.arange(len(x)), first].astype(np.int64)


def blocks_of(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    low, high = (batch.column(c).flatten().to_numpy().reshape(-1, dims) for c in ("low", "high"))
    for k in range(len(batch)):
        yield batch.column("ids")[k].values, batch.column("x")[k].values.to_numpy().reshape(-1, dims), low[k], high[k]


def summed(batches: Iterator[pa.RecordBatch], centroids: Centroids, dims: int) -> Iterator[pa.RecordBatch]:
    """Per cluster: rows and the sum of every dimension (dimension -1: the rows)."""
    counts, sums = np.zeros(len(centroids.places), np.int64), np.zeros((len(centroids.places), dims), np.int64)
    for batch in batches:
        for _, x, low, high in blocks_of(batch, dims):
            cluster, _ = centroids.nearest(x, low, high)
            for k in np.unique(cluster):
                own = x[cluster == k]
                counts[k] += len(own)
                sums[k] += own.sum(axis=0, dtype=np.int64)
    for k in np.flatnonzero(counts):
        values = np.concatenate([[counts[k]], sums[k]])
        yield pa.record_batch([pa.array(np.full(dims + 1, k, np.int32)), pa.array(np.arange(-1, dims, dtype=np.int32)), pa.array(values)], ["cluster", "dim", "total"])


def assigned(batches: Iterator[pa.RecordBatch], centroids: Centroids, dims: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, x, low, high in blocks_of(batch, dims):
            cluster, distance = centroids.nearest(x, low, high)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["id", "cluster", "distance"])


def moved(blocks: DataFrame, places: list[list[int]], summary: Summary) -> list[list[int]]:
    """The centroids after one round; those without rows stay."""
    centroids = Centroids(places, summary.largest)
    parts = in_arrow(blocks.select("ids", "x", "low", "high"), lambda batches: summed(batches, centroids, summary.dims), "cluster int, dim int, total bigint")
    totals = {(r["cluster"], r["dim"]): r["total"] for r in parts.groupBy("cluster", "dim").agg(F.sum("total").alias("total")).collect()}
    return [[totals[k, d] // totals[k, -1] for d in range(summary.dims)] if (k, -1) in totals else p for k, p in enumerate(places)]


def cluster(df: DataFrame, id: str = "vec_id", column: str = "embedding", dims: int = 64, factor: int = 256, k: int = 40, rounds: int = 5, seed: str = "2") -> DataFrame:
    """One row per vector: the id, `cluster`, `distance`, `cluster_inertia`, `inertia`, `centroid_sha256`."""
    kind = dict(df.dtypes)[id]
    summary = Summary(df, column, factor, LIMIT, dims)
    if not summary.n:
        return df.sparkSession.createDataFrame([], f"`{id}` {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    rows = along_curve(df.select(F.col(id).alias("id"), F.col(column).alias("vector")), "vector", summary, factor, LIMIT)
    blocks = stored(in_arrow(rows.drop("row"), lambda batches: blocked(batches, dims), f"ids array<{kind}>, x array<int>, low array<int>, high array<int>"), "blocks")
    each = blocks.select(F.posexplode("ids").alias("at", "id"), "x").select("id", F.slice("x", F.col("at") * dims + 1, dims).alias("x"))
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    places = [list(r["x"]) for r in each.orderBy(drawn.asc_nulls_last(), "x").limit(k).collect()]
    for _ in range(rounds):
        places = moved(blocks, places, summary)
    centroids = Centroids(places, summary.largest)
    found = stored(in_arrow(blocks, lambda batches: assigned(batches, centroids, dims), f"id {kind}, cluster int, distance bigint"), "assigned")
    inertia = {r["cluster"]: r["total"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    hashes = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in places]
    # One row per centroid.
    facts = df.sparkSession.createDataFrame([(c, total, sum(inertia.values()), hashes[c]) for c, total in inertia.items()],
                                            "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select(F.col("id").alias(id), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
