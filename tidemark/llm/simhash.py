"""SimHash near-duplicates by generalised pigeonhole.

A fingerprint bit is the majority of that bit over the hashes of a text's shingles. Two fingerprints differ in at most `radius`
bits only if, for any split of the 64 bits into partitions with thresholds t_i that sum to radius - partitions + 1, they
differ in at most t_i bits of some partition i. Here

* bits that agree with each other more than chance (on a bounded sample of fingerprints) are grouped into partitions;
* each fingerprint chooses its own thresholds by dynamic programming over the partitions, on candidate counts estimated from
  the sample's partition values: a crowded value gets a low threshold (-1: not probed), a rare one a high one. The whole
  fingerprint with threshold `radius` is one more choice, so crowded neighbourhoods never cost more probes than that;
* it probes all values within its thresholds, and candidates are verified on all bits inside the join.

The sample only steers costs: every choice of thresholds finds all links. Equal fingerprints are merged first, so exact copies
meet as one row. Components are found by alternating star contraction on the links.

Null and empty texts have the fingerprint zero and are linked like any other. Repeated ids keep their rows; a component's id
is the smallest id in it, null if all are. An empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import in_arrow, null_safe_key, stored, text_slices

SAMPLE = 20_000  # fingerprints that steer partitions and thresholds
MAX_ROUNDS = 60
LIMIT_SHINGLES = 1 << 16


def majority(hashes: np.ndarray, n: int) -> int:
    """Bits that more than half of the big-endian 64-bit hashes set."""
    sums = np.zeros(64, np.int64)
    for low in range(0, n, LIMIT_SHINGLES):
        sums += np.unpackbits(hashes[low:low + LIMIT_SHINGLES], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * sums > n).tobytes(), "big")


def fingerprint(text: bytes, size: int, seed: int = 42) -> int:
    from xxhash import xxh64_digest

    words = text.lower().split()  # bytes: only A-Z become small, only ASCII blanks separate
    if not words:
        return 0
    if len(words) <= size:
        return int.from_bytes(xxh64_digest(b" ".join(words), seed), "big")
    shingles = map(b" ".join, zip(*(words[k:] for k in range(size))))
    digests = b"".join([xxh64_digest(s, seed) for s in shingles])
    hashes = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    return majority(hashes, len(hashes))


def fingerprinted(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, texts in text_slices(batch, "text"):
            prints = np.array([fingerprint(t, size) for t in texts], np.uint64)
            yield rows.drop_columns(["text"]).append_column("fp", pa.array(prints.view(np.int64)))


def bits_of(prints: np.ndarray) -> np.ndarray:
    return (prints.view(np.uint64)[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)


def group_bits(prints: np.ndarray, partitions: int) -> list[list[int]]:
    """Equal groups of bits: each starts with the most correlated free bit and takes those most correlated with its own."""
    bits = bits_of(prints).astype(np.float64) if len(prints) else np.zeros((1, 64))
    bits -= bits.mean(axis=0)
    scale = np.sqrt((bits ** 2).sum(axis=0))
    scale[scale == 0] = 1
    related = np.abs((bits.T @ bits) / np.outer(scale, scale))
    np.fill_diagonal(related, 0)
    free, groups = list(range(64)), []
    for k in range(partitions):
        wanted = (64 - sum(map(len, groups))) // (partitions - k)
        group = [max(free, key=lambda b: related[b][free].sum())]
        while len(group) < wanted:
            rest = [b for b in free if b not in group]
            group.append(max(rest, key=lambda b: related[b][group].sum()))
        free = [b for b in free if b not in group]
        groups.append(sorted(group))
    return groups


def flips(bits: list[int], radius: int) -> np.ndarray:
    """Masks of all changes of at most `radius` of the bits."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(bits, r)], np.uint64)


class Thresholds:
    """Per-fingerprint thresholds by dynamic programming over partitions on estimated costs."""

    def __init__(self, sample: np.ndarray, total: int, partitions: int, radius: int):
        self.radius, self.groups = radius, group_bits(sample, partitions)
        self.masks = [np.uint64(sum(1 << b for b in g)) for g in self.groups]
        self.flips = [[flips(g, t) for t in range(radius + 1)] for g in self.groups]
        self.all_flips = flips(list(range(64)), radius)
        self.scale = total / max(len(sample), 1)
        prints = sample.view(np.uint64)
        self.values = [np.unique(prints & m, return_counts=True) for m in self.masks]

    def seen(self, k: int, values: np.ndarray) -> np.ndarray:
        """Estimated rows with these values of partition k; a value outside the sample counts as half a sampled row."""
        known, counts = self.values[k]
        if not len(known):
            return np.full(len(values), self.scale / 2)
        at = np.minimum(np.searchsorted(known, values), len(known) - 1)
        return np.where(known[at] == values, counts[at], 0.5) * self.scale

    def costs(self, prints: np.ndarray) -> np.ndarray:
        """[fingerprint, partition, threshold + 1]: probes plus estimated candidates; a threshold of -1 costs nothing."""
        cost = np.zeros((len(prints), len(self.groups), self.radius + 2))
        for k, mask in enumerate(self.masks):
            own = prints & mask
            known, counts = self.values[k]
            spread = counts.sum() / 2.0 ** len(self.groups[k]) * self.scale if len(known) else 0
            candidates = self.seen(k, own)
            for t in range(self.radius + 1):
                if t == 1:  # neighbours one bit away are looked up
                    for b in self.groups[k]:
                        candidates = candidates + self.seen(k, own ^ np.uint64(1 << b))
                elif t > 1:
                    candidates = candidates + spread * len(self.flips[k][t]) + candidates
                cost[:, k, t + 1] = len(self.flips[k][t]) + candidates
        return cost

    def choose(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Thresholds per fingerprint and partition, and their cost. Sum of (threshold + 1) is radius + 1."""
        cost, budget = self.costs(prints), self.radius + 1
        best = np.full((len(prints), budget + 1), np.inf)
        best[:, 0] = 0
        taken = np.zeros((len(prints), len(self.groups), budget + 1), np.int8)
        for k in range(len(self.groups)):
            options = np.full((len(prints), budget + 1, budget + 1), np.inf)
            for spent in range(budget + 1):
                for own in range(spent + 1):
                    options[:, spent, own] = best[:, spent - own] + cost[:, k, own]
            taken[:, k] = options.argmin(axis=2)
            best = options.min(axis=2)
        left, thresholds = np.full(len(prints), budget), np.zeros((len(prints), len(self.groups)), np.int8)
        rows = np.arange(len(prints))
        for k in reversed(range(len(self.groups))):
            own = taken[rows, k, left]
            thresholds[:, k] = own - 1
            left = left - own
        return thresholds, best[:, budget]


def plan_partitions(sample: np.ndarray, total: int, radius: int) -> Thresholds:
    """The number of partitions whose estimated cost over the sample is least; any finds all links."""
    plans = [Thresholds(sample, total, m, radius) for m in range(1, radius + 2)]
    return min(plans, key=lambda p: np.minimum(p.choose(sample.view(np.uint64))[1], len(p.all_flips)).sum())


ENTRIES = "part int, value bigint, fp bigint"
WHOLE = -1  # the partition of all bits


def entries(prints: np.ndarray, parts: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    part = np.concatenate([np.full(v.size, k, np.int32) for k, v, _ in parts]) if parts else np.zeros(0, np.int32)
    value = np.concatenate([v.ravel() for _, v, _ in parts]) if parts else np.zeros(0, np.uint64)
    own = np.concatenate([prints[who] for _, _, who in parts]) if parts else np.zeros(0, np.uint64)
    return pa.record_batch([pa.array(part), pa.array(value.view(np.int64)), pa.array(own.view(np.int64))], ["part", "value", "fp"])


def indexed(batches: Iterator[pa.RecordBatch], plan: Thresholds) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column("fp").to_numpy().view(np.uint64)
        rows = np.arange(len(prints))
        yield entries(prints, [(k, prints & m, rows) for k, m in enumerate(plan.masks)] + [(WHOLE, prints, rows)])


def probes(batches: Iterator[pa.RecordBatch], plan: Thresholds) -> Iterator[pa.RecordBatch]:
    """All values within each fingerprint's thresholds."""
    for batch in batches:
        for low in range(0, len(batch), 2_000):
            prints = batch.column("fp").to_numpy()[low:low + 2_000].view(np.uint64)
            thresholds, cost = plan.choose(prints)
            whole = np.flatnonzero(cost > len(plan.all_flips))
            thresholds[whole] = -1
            parts = [(WHOLE, prints[whole][:, None] ^ plan.all_flips, np.repeat(whole, len(plan.all_flips)))] if len(whole) else []
            for k, mask in enumerate(plan.masks):
                for t in range(plan.radius + 1):
                    who = np.flatnonzero(thresholds[:, k] == t)
                    if len(who):
                        masks = plan.flips[k][t]
                        parts.append((k, (prints[who] & mask)[:, None] ^ masks, np.repeat(who, len(masks))))
            yield entries(prints, parts)


def links(prints: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b), a < b, of different fingerprints at most `radius` bits apart. `prints` holds each `fp` once."""
    drawn = prints.orderBy(F.xxhash64(F.lit(7), "fp")).limit(SAMPLE).toPandas()["fp"].to_numpy(np.int64)
    plan = plan_partitions(drawn, prints.count(), radius)
    index = in_arrow(prints, lambda batches: indexed(batches, plan), ENTRIES).withColumnRenamed("fp", "found")
    asked = in_arrow(prints, lambda batches: probes(batches, plan), ENTRIES)
    near = (F.col("fp") != F.col("found")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("found"))) <= radius)
    # Sizes before and after Python look alike to the planner, so it is told not to broadcast.
    same = asked.alias("q").join(index.alias("x").hint("merge"), (F.col("q.part") == F.col("x.part")) & (F.col("q.value") == F.col("x.value")) & near)
    return same.select(F.least("fp", "found").alias("a"), F.greatest("fp", "found").alias("b")).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """`node` and `root`, the smallest node of its component, for every node of the pairs, by alternating stars: every
    node's larger neighbours, then its smaller ones, are hung on its smallest neighbour until nothing moves. Neighbours are
    joined to their stored minimum, never gathered, so AQE splits a node of any degree."""
    edges = stored(pairs.select(F.col("a").alias("low"), F.col("b").alias("high")), "links")
    mark = None
    for _ in range(MAX_ROUNDS):
        both = edges.union(edges.select(F.col("high").alias("low"), F.col("low").alias("high"))).toDF("node", "other")
        least = stored(both.groupBy("node").agg(F.min("other").alias("_m")).select("node", F.least("_m", "node").alias("least")), "least")
        large = both.where("other > node").join(least, "node").select(F.col("least").alias("low"), F.col("other").alias("high")).distinct()
        large = stored(large, "large")
        down = stored(large.groupBy("high").agg(F.min("low").alias("least")), "down")
        small = large.join(down, "high").select("least", "low", "high")
        after = stored(small.select(F.col("least").alias("low"), F.col("high")).union(
            small.where("low != least").select(F.col("least").alias("low"), F.col("low").alias("high"))).distinct(), "links")
        before, mark = mark, after.agg(F.count("*"), F.bit_xor(F.xxhash64("low", "high")), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
        edges = after
        if mark == before:
            roots = edges.select(F.col("high").alias("node"), F.col("low").alias("root"))
            return roots.union(edges.select(F.col("low"), F.col("low")).distinct())
    raise RuntimeError(f"components are not settled after {MAX_ROUNDS} rounds")


def classed(docs: DataFrame, radius: int, size: int, id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows with `doc_id`, the text's keys and `fp`; and for every fingerprint that is linked or repeated its component's `root` and `component_id`."""
    whole = F.coalesce(F.col(text), F.lit(""))
    named = docs.select(F.col(id).alias("doc_id"), whole.alias("text"), F.xxhash64(whole).alias("h1"), F.xxhash64(F.lit(1), whole).alias("h2"))
    kind = dict(named.dtypes)["doc_id"]
    rows = stored(in_arrow(named, lambda batches: fingerprinted(batches, size), f"doc_id {kind}, h1 bigint, h2 bigint, fp bigint"), "fingerprints")
    prints = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "prints")
    tree = components(links(prints.select("fp"), radius))
    grouped = stored(prints.join(tree, prints["fp"] == tree["node"], "left").select("fp", "first", "n", "root"), "members")
    linked = grouped.where("root IS NOT NULL")
    smallest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    alone = grouped.where("root IS NULL AND n > 1").select("fp", F.col("fp").alias("root"), F.col("first").alias("component_id"))
    # Stored, so that no aggregate stands above its shuffle: AQE can split the fingerprint of a much copied text.
    return rows, stored(linked.join(smallest, "root").select("fp", "root", "component_id").union(alone), "classes")


def near_duplicates(docs: DataFrame, radius: int = 2, size: int = 3, id: str = "doc_id", text: str = "text") -> DataFrame:
    """`id`, `fingerprint` (16 hex digits) and `component_id` of every row."""
    rows, classes = classed(docs, radius, size, id, text)
    return rows.join(classes, "fp", "left").select(F.col("doc_id").alias(id), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                                                   F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, radius: int = 2, size: int = 3, id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one row of every component: the smallest id (null last), then the smallest text keys; of rows that repeat, one."""
    rows, classes = classed(docs, radius, size, id, text)
    rooted = rows.join(classes, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h1", "h2")).alias("r"))
    chosen = first.select(null_safe_key(F.col("r.doc_id")).alias("key"), F.col("r.h1").alias("h1"), F.col("r.h2").alias("h2"))
    whole = F.coalesce(F.col(text), F.lit(""))
    # The row in one struct: its columns can have any names.
    packed = docs.select(F.struct(*docs.columns).alias("row"), null_safe_key(F.col(id)).alias("key"), F.xxhash64(whole).alias("h1"), F.xxhash64(F.lit(1), whole).alias("h2"))
    keys = ["key", "h1", "h2"]
    return packed.join(chosen, keys, "left_semi").dropDuplicates(keys).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
