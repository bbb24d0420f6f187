"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Vectors become whole numbers floor(factor * x) and are dealt into blocks along a Hilbert curve, one partition each, so that a block's
rows lie close together. A block keeps one list per dimension, sorted by value. A query walks every list from the end that suits the
sign of its component, the same number of steps in each, doubling; what it meets is scored exactly by random access. The values where
the walks stand bound the score of all that was not met; the query is done as soon as that is below its kth score (an equal one could
still win its tie). Once the walks together would touch as many entries as the block has rows, the rest of the block is scored at once.

A query first searches the block it lies in, in the task that makes the block. The kth score found there goes with it to all other
blocks, most of which it then leaves after a few steps if the data has any structure. Every block meets the queries as they
stream past it: a task holds one block and one batch of queries. Per query at most k rows leave a block.

Left out, as queries and candidates, are null vectors, vectors with a null or non-finite component (or one beyond 2**26 when scaled),
and vectors of another than the commonest number of components (of several, the largest). A row is never its own candidate; another row
with its id is one. Ties go to the smaller id, null ids last. An empty table gives no row; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import in_arrow, stored
from tidemark.llm.vectors import Summary, along_curve

LIMIT = 1 << 26
BLOCK, LEAST_BLOCK, SPREAD = 1 << 15, 256, 64  # rows of a block; small tables are cut into up to SPREAD blocks of at least LEAST_BLOCK rows
AT_ONCE = 256  # queries whose scores with a block are held at once
NONE = -(1 << 62)  # below any score


def block_count(n: int) -> int:
    return max(-(-n // BLOCK), min(SPREAD, -(-n // LEAST_BLOCK)))


class Block:
    """Rows with their sorted lists. Rows are ordered by id, so that of equal scores the first row wins."""

    def __init__(self, ids: pa.Array, rows: np.ndarray, x: np.ndarray, exact: type):
        order = pa.compute.sort_indices(pa.record_batch([ids, pa.array(rows)], ["id", "row"]), sort_keys=[("id", "ascending"), ("row", "ascending")]).to_numpy()
        self.ids, self.rows, self.x = ids.take(pa.array(order)), rows[order], x[order].astype(exact)
        self.by_row = np.argsort(self.rows)
        self.order = np.argsort(self.x, axis=0, kind="stable")
        self.values = np.take_along_axis(self.x, self.order, axis=0)

    def places(self, rows: np.ndarray) -> np.ndarray:
        """Where these rows stand in the block, -1 for others."""
        at = np.minimum(np.searchsorted(self.rows, rows, sorter=self.by_row), len(self.rows) - 1)
        found = self.by_row[at]
        return np.where(self.rows[found] == rows, found, -1)

    def bound(self, up: np.ndarray, down: np.ndarray, steps: int) -> np.ndarray:
        """The most that a row not met in `steps` steps can score: `up` and `down` are the queries' positive and negative parts."""
        return up @ self.values[len(self.x) - 1 - steps] + down @ self.values[steps]

    def search(self, queries: np.ndarray, own: np.ndarray, kth: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(places, scores) of every query's k best rows that score at least its `kth`, best first."""
        n, dims = self.x.shape
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        kth, met = kth.copy(), {}
        best = [(np.zeros(0, np.int64), np.zeros(0, self.x.dtype)) for _ in queries]
        active, steps = np.arange(len(queries)), 0
        while True:
            if steps >= n:
                return best
            active = active[self.bound(up[active], down[active], steps) >= kth[active]]
            further = max(1, 2 * steps)
            if not len(active):
                return best
            if further * dims >= n:
                break
            for q in active.tolist():
                near = np.concatenate([self.order[n - further:n - steps, queries[q] > 0].ravel(), self.order[steps:further, queries[q] < 0].ravel()])
                before = met.get(q, np.full(1, own[q]))
                fresh = np.setdiff1d(near, before)
                met[q] = np.union1d(before, fresh)
                places, scores = np.concatenate([best[q][0], fresh]), np.concatenate([best[q][1], self.x[fresh] @ queries[q]])
                best[q] = self.first(places, scores, kth[q], k)
                if len(best[q][1]) == k:
                    kth[q] = max(kth[q], best[q][1][-1])
            steps = further
        scores = queries[active] @ self.x.T
        mine = np.flatnonzero(own[active] >= 0)
        scores[mine, own[active[mine]]] = 2 * NONE
        every = np.arange(n)
        for q, row in zip(active.tolist(), scores):
            best[q] = self.first(every, row, max(kth[q], NONE), k)
        return best

    @staticmethod
    def first(places: np.ndarray, scores: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        kept = np.flatnonzero(scores >= least)
        if len(kept) > k:
            kept = kept[scores[kept] >= np.partition(scores[kept], len(kept) - k)[len(kept) - k]]
        places, scores = places[kept], scores[kept]
        order = np.lexsort((places, -scores))[:k]
        return places[order], scores[order]


def exact_kind(summary: Summary) -> type:
    """Doubles while all sums of products stay below 2**53, else longs."""
    return np.float64 if summary.dims * summary.largest ** 2 < 1 << 52 else np.int64


def vectors_in(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, dims)


def gathered(batches: list[pa.RecordBatch], dims: int, exact: type) -> Block:
    table = pa.Table.from_batches(batches).combine_chunks()
    x = np.concatenate([vectors_in(b, dims) for b in batches])
    return Block(table.column("id").combine_chunks(), table.column("row").to_numpy(), x, exact)


def seeded(batches: Iterator[pa.RecordBatch], dims: int, exact: type, k: int) -> Iterator[pa.RecordBatch]:
    """A partition's rows with `kth`: the score of the kth best row of their own block, for queries."""
    batches = [b for b in batches if len(b)]
    if not batches:
        return
    block = gathered(batches, dims, exact)
    for batch in batches:
        kth = np.full(len(batch), NONE, np.int64)
        asking = np.flatnonzero(batch.column("asks").to_numpy(zero_copy_only=False))
        for low in range(0, len(asking), AT_ONCE):
            some = asking[low:low + AT_ONCE]
            own = block.places(batch.column("row").to_numpy()[some])
            found = block.search(vectors_in(batch, dims)[some].astype(exact), own, np.full(len(some), NONE, exact), k)
            kth[some] = [int(scores[-1]) if len(scores) == k else NONE for _, scores in found]
        yield batch.append_column("kth", pa.array(kth))


def searched(batches: Iterator[pa.RecordBatch], dims: int, exact: type, k: int) -> Iterator[pa.RecordBatch]:
    """Blocks one after the other, each block's rows before the queries that meet it."""
    current, rows, block = None, [], None
    for batch in batches:
        numbers, asks = batch.column("block").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((numbers[1:] != numbers[:-1]) | (asks[1:] != asks[:-1])) + 1
        for low, high in zip([0, *edges], [*edges, len(batch)]):
            part = batch.slice(low, high - low)
            if not len(part):
                continue
            if numbers[low] != current:
                current, rows, block = numbers[low], [], None
            if not asks[low]:
                rows.append(part)
                continue
            if block is None and rows:
                block, rows = gathered(rows, dims, exact), []
            for at in range(0, len(part) if block else 0, AT_ONCE):
                some = part.slice(at, AT_ONCE)
                own = some.column("row").to_numpy()
                found = block.search(vectors_in(some, dims).astype(exact), block.places(own), some.column("kth").to_numpy().astype(exact), k)
                sizes = [len(p) for p, _ in found]
                places = np.concatenate([p for p, _ in found])
                whose = np.repeat(np.arange(len(some)), sizes)
                scores = np.concatenate([s for _, s in found]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own[whose]), some.column("id").take(pa.array(whose)), block.ids.take(pa.array(places)), pa.array(scores)],
                                                 names=["query_row", "query_id", "found", "score"])


def top_k(df: DataFrame, asks: Column, id: str = "vec_id", column: str = "embedding", factor: int = 256, k: int = 5) -> DataFrame:
    """`query_id`, `rank` (from 1), the id of the row found, `score`, for every row where `asks` holds."""
    kind = dict(df.dtypes)[id]
    summary = Summary(df, column, factor, LIMIT)
    if not summary.n:
        return df.sparkSession.createDataFrame([], f"query_id {kind}, rank int, `{id}` {kind}, score bigint")
    exact, dims, blocks = exact_kind(summary), summary.dims, block_count(summary.n)
    named = df.select(F.col(id).alias("id"), F.col(column).alias("vector"), F.coalesce(asks, F.lit(False)).alias("asks"))
    laid = along_curve(named, "vector", summary, factor, LIMIT, blocks).withColumn("block", F.spark_partition_id())
    rows = stored(in_arrow(laid, lambda batches: seeded(batches, dims, exact, k), f"id {kind}, asks boolean, row bigint, x array<int>, block int, kth bigint"), "sorted")
    count = rows.agg(F.max("block")).first()[0] + 1
    queries = rows.where("asks").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    both = rows.withColumn("asks", F.lit(False)).unionByName(queries)
    met = both.repartitionById(count, F.col("block")).sortWithinPartitions("block", "asks")
    found = in_arrow(met, lambda batches: searched(batches, dims, exact, k), f"query_row bigint, query_id {kind}, found {kind}, score bigint")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("found"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("found").alias(id), "score")
