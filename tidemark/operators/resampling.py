"""Paired bootstrap of two scores, with vectors over the resamples instead of rows per resample.

Every row has a Poisson(1) weight per resample, drawn from its id: one MD5 gives four draws of 32 bits. Map tasks add the weights of equal
scores up as vectors, so what is shuffled is at most one pair of vectors per score, task and batch. Scores are range-partitioned and
sorted once; each slice adds its vectors up, and with the totals of the slices before it gives its share of both metrics of all resamples.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordering import range_layout

AT_ONCE = 1_000  # rows whose weights are held at once
SIDES = ("first", "second")


def poisson_steps() -> list[float]:
    """Below the k-th of these a uniform draw means a count of k. Draws have 32 bits, and 13 has a chance far below 2 ** -32: 12 is the last
    that a draw can reach."""
    steps, total, term = [], 0.0, 0.36787944117144233
    for k in range(12):
        total += term
        steps.append(total)
        term /= k + 1
    return steps


def weights(idents: Sequence[str], resamples: int) -> np.ndarray:
    """[row, resample] Poisson(1) counts."""
    blocks = range(-(-resamples // 4))
    digests = b"".join(hashlib.md5(f"{i}:{k}".encode()).digest() for i in idents for k in blocks)
    draws = np.frombuffer(digests, ">u4").reshape(len(idents), -1)[:, :resamples] / 2.0**32
    return np.searchsorted(poisson_steps(), draws, side="right")


def vectors(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel()))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def weighed(batches: Iterator[pa.RecordBatch], resamples: int) -> Iterator[pa.RecordBatch]:
    """Per side and score of some rows: the weights of positives and negatives."""
    for batch in batches:
        for low in range(0, len(batch), AT_ONCE):
            part = batch.slice(low, AT_ONCE)
            drawn = weights(part.column("ident").to_pylist(), resamples)
            positive = part.column("positive").to_numpy(zero_copy_only=False)[:, None]
            for k, side in enumerate(SIDES):
                scores, at = np.unique(part.column(side).to_numpy(), return_inverse=True)
                pos, neg = np.zeros((2, len(scores), resamples), np.int64)
                np.add.at(pos, at, drawn * positive)
                np.add.at(neg, at, drawn * ~positive)
                yield pa.record_batch([pa.array(np.full(len(scores), k, np.int32)), pa.array(scores), vectors(pos), vectors(neg)], ["side", "score", "pos", "neg"])


def totals(batches: Iterator[pa.RecordBatch], resamples: int) -> Iterator[pa.RecordBatch]:
    """Per slice and side: the sums of both vectors."""
    found: dict = {}
    for batch in batches:
        slices, sides = batch.column("_slice").to_numpy(), batch.column("side").to_numpy()
        pos, neg = matrix(batch.column("pos")), matrix(batch.column("neg"))
        for at in set(zip(slices.tolist(), sides.tolist())):
            mine = (slices == at[0]) & (sides == at[1])
            entry = found.setdefault(at, np.zeros((2, resamples), np.int64))
            entry += pos[mine].sum(axis=0), neg[mine].sum(axis=0)
    if found:
        keys = np.array(list(found))
        sums = np.array(list(found.values()))
        yield pa.record_batch([pa.array(keys[:, 0]), pa.array(keys[:, 1].astype(np.int32)), vectors(sums[:, 0]), vectors(sums[:, 1])], ["slice", "side", "pos", "neg"])


def shares(batches: Iterator[pa.RecordBatch], starts: dict, resamples: int) -> Iterator[pa.RecordBatch]:
    """Per slice and side: the slice's share of won pairs and of summed precision, for every resample."""
    so_far: dict = {}
    out: dict = {}
    waiting: dict = {}  # (slice, side) -> score, pos, neg: equal scores stand together, so the last may go on

    def close(at, pos, neg):
        tp, fp = so_far.setdefault(at, [v.copy() for v in starts[at]])
        tp += pos
        fp += neg
        wins, precision = out.setdefault(at, np.zeros((2, resamples)))
        wins += neg * (tp - pos / 2)
        precision += np.where(pos > 0, pos * (tp / np.maximum(tp + fp, 1)), 0.0)

    for batch in batches:
        pos, neg = matrix(batch.column("pos")), matrix(batch.column("neg"))
        rows = zip(batch.column("_slice").to_pylist(), batch.column("side").to_pylist(), batch.column("score").to_pylist(), pos, neg)
        for piece, side, score, p, n in rows:
            at = (piece, side)
            if at in waiting and waiting[at][0] == score:
                waiting[at] = (score, waiting[at][1] + p, waiting[at][2] + n)
            else:
                if at in waiting:
                    close(at, *waiting[at][1:])
                waiting[at] = (score, p, n)
    for at, (_, p, n) in waiting.items():
        close(at, p, n)
    for (_, side), (wins, precision) in out.items():
        yield pa.record_batch([pa.array(np.full(resamples, side, np.int32)), pa.array(np.arange(resamples, dtype=np.int32)), pa.array(wins), pa.array(precision)],
                              ["side", "resample", "wins", "precision"])


def bootstrap_differences(df: DataFrame, ident: str, label: str, first: str, second: str, resamples: int) -> DataFrame:
    """Per resample: the paired differences in PR-AUC and ROC-AUC between two scores, both over the same resample. A null score is the lowest."""
    lowest = F.lit(float("-inf"))
    rows = df.select(F.col(ident).cast("string").alias("ident"), F.coalesce(F.col(label) == 1, F.lit(False)).alias("positive"),
                     *(F.coalesce(F.col(c).cast("double"), lowest).alias(s) for c, s in zip((first, second), SIDES)))
    counted = rows.mapInArrow(lambda batches: weighed(batches, resamples), "side int, score double, pos array<bigint>, neg array<bigint>")
    # Range bounds are on side and score: rows of one score stay in one slice.
    laid = range_layout(counted, [F.col("side").asc(), F.col("score").desc()])
    sums = laid.mapInArrow(lambda batches: totals(batches, resamples), "slice bigint, side int, pos array<bigint>, neg array<bigint>")
    # To the driver and back to the tasks: two vectors per range partition, and side where two meet in one.
    found = sorted((r["side"], r["slice"], np.array(r["pos"]), np.array(r["neg"])) for r in sums.collect())
    starts, whole = {}, {}
    for side, piece, pos, neg in found:
        before = whole.get(side, (np.zeros(resamples, np.int64), np.zeros(resamples, np.int64)))
        starts[piece, side] = before
        whole[side] = (before[0] + pos, before[1] + neg)
    parts = laid.mapInArrow(lambda batches: shares(batches, starts, resamples), "side int, resample int, wins double, precision double")
    gained = parts.groupBy("resample", "side").agg(F.sum("wins").alias("wins"), F.sum("precision").alias("precision"))
    # One row per side and resample.
    sizes = df.sparkSession.createDataFrame([(side, b, int(p), int(n)) for side, (pos, neg) in whole.items() for b, (p, n) in enumerate(zip(pos, neg))],
                                            "side int, resample int, positives bigint, negatives bigint")
    quality = gained.join(sizes, ["resample", "side"]).select(
        "resample", "side", F.try_divide(F.col("precision"), F.col("positives")).alias("pr_auc"), F.try_divide(F.col("wins"), F.col("positives") * F.col("negatives")).alias("roc_auc"))
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    return quality.groupBy("resample").agg(*((of(0, c) - of(1, c)).alias(f"{c}_gain") for c in ("pr_auc", "roc_auc")))
