"""Best-fit packing planned on the histogram of lengths.

Pieces of documents are at most `capacity` tokens, so a histogram has at most `capacity` rows however many documents there
are. Best-fit decreasing runs over these counts: sequences with equal free space are handled as one run, and the plan says,
for each length, which ranks go to which sequences and offsets. Pieces then take their slots by joining on rank within
length; ranks are counted where the pieces were written and shifted by the counts of earlier parts, so no length, however
frequent, meets in one task.

Null texts are empty: their piece is the end id alone. Repeated rows are packed as often as they occur. An empty table gives
no row. Other columns of `docs` are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import in_arrow, stored, text_slices
from tidemark.llm.tokens import encoder

PIECES = "doc_id bigint, piece int, start bigint, length int, ids_crc32 bigint, part int, in_part bigint"
PLAN = "length int, rank_from bigint, rank_to bigint, first_sequence bigint, per_sequence int, first_offset int"


def piece_starts(n: int, capacity: int) -> list[int]:
    """A text of more than `capacity` tokens is cut from its end into full pieces; the first may be shorter."""
    return [0, *range(n % capacity or capacity, n, capacity)] if n > capacity else [0]


def pieces_of(batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    tokens, part = encoder(path, (end_id,)), TaskContext.get().partitionId()
    seen = np.zeros(capacity + 1, np.int64)
    names = [field.split()[0] for field in PIECES.split(", ")]
    for batch in batches:
        for rows, texts in text_slices(batch, "text"):
            ids, counts = tokens.encode(texts)
            raw, out = memoryview(ids.astype("<u4").tobytes()), []
            low = 0
            for doc, n in zip(rows.column("doc_id").to_pylist(), counts.tolist()):
                starts = piece_starts(n, capacity)
                for piece, (start, end) in enumerate(zip(starts, [*starts[1:], n])):
                    crc = zlib.crc32(raw[4 * (low + start):4 * (low + end)])
                    out.append((doc, piece, start, end - start, crc, part, int(seen[end - start])))
                    seen[end - start] += 1
                low += n
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()))], names)


def plan_slots(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows of PLAN by best-fit decreasing. Work and rows depend on the number of different lengths, not on the counts.

    A run is (first sequence, number of sequences) with the same free space; the fullest that fits is filled first.
    """
    runs: dict[int, list[tuple[int, int]]] = {}
    plan, sequences = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens does not fit {capacity}")
        open_ = [free for free in runs if free >= length]
        heapq.heapify(open_)
        while left:
            while open_ and not runs.get(open_[0]):
                heapq.heappop(open_)
            free = open_[0] if open_ else capacity
            per = free // length  # a sequence that still fits the length stays the fullest and takes the next one too
            if open_:
                first, many = runs[free].pop()
            else:
                first, many = sequences, -(-left // per)
                sequences += many
            used, rest = divmod(left, per)
            if used >= many:
                used, rest = many, 0
            taken = used * per + rest
            plan.append((length, rank, rank + taken, first, per, capacity - free))
            for start, number, room in ((first, used, free - per * length), (first + used, 1 if rest else 0, free - rest * length),
                                        (first + used + bool(rest), many - used - bool(rest), free)):
                if number and room:
                    if room not in runs:
                        runs[room] = []
                    runs[room].append((start, number))
            left, rank = left - taken, rank + taken
    return plan


def pack(docs: DataFrame, path: str, end_id: int, capacity: int = 2048, id: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id`, `piece`, `start`, `length`, `ids_crc32`, `sequence_id` and `offset` of every piece."""
    named = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    pieces = stored(in_arrow(named, lambda batches: pieces_of(batches, path, end_id, capacity), PIECES), "pieces")
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    shifts = by_part.select("length", "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    # At most `capacity` rows to the driver.
    counts = {r["length"]: r["_n"] for r in pieces.groupBy("length").agg(F.count("*").alias("_n")).collect()}
    plan = docs.sparkSession.createDataFrame(plan_slots(counts, capacity), PLAN)
    ranked = pieces.join(shifts, ["length", "part"]).withColumn("rank", F.col("_shift") + F.col("in_part"))
    # Broadcast bound: the plan's rows follow from the number of lengths (at most `capacity`), not from the documents.
    slots = ranked.join(F.broadcast(plan), ["length"]).where("rank >= rank_from AND rank < rank_to")
    nth = F.col("rank") - F.col("rank_from")
    return slots.select(
        "doc_id", "piece", "start", F.col("length").cast("bigint").alias("length"), "ids_crc32",
        (F.col("first_sequence") + F.floor(nth / F.col("per_sequence"))).cast("bigint").alias("sequence_id"),
        (F.col("first_offset") + F.pmod(nth, F.col("per_sequence").cast("bigint")) * F.col("length")).cast("bigint").alias("offset"),
    )
