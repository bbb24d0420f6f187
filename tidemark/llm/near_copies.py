"""Near copies by the Jaccard similarity of their shingles.

A text's set is that of its distinct `size`-word shingles. Candidates share one of BANDS keys, each made of ROWS minima of the set under
random functions: a pair of similarity 0.8 shares none with a chance of 6e-5, less above. Every candidate is verified on the whole
sets (64-bit hashes of the shingles). A row goes if a row that stays is similar to it, so no chain of copies drops what resembles
nothing that is kept; which row of a group stays is drawn by hash.

A row that is first in all its keys stays, and drops those similar to it: a group of copies of any size is settled by comparing each
with one row. Keys of one row are gone at once, and sets are made only for rows with a shared key. What still shares keys after
ROUNDS of that are mostly texts that have a passage in common and are no copies, and these are told apart without being compared: each
now gets as keys the rarest shingles of its set, by their count over these rows, just enough of them that two similar sets have one
in common (a prefix). A passage that many texts share is not among the rarest of any of them, unless it is nearly all of it. The same
rounds follow on these keys, and last, pairs of the few rows left whose lengths and places in the prefixes allow for the similarity.

Null texts and texts without words are never near copies; texts shorter than a shingle are one shingle. Repeated rows are one row. An
empty table gives no row. All columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import in_arrow, null_safe_key, stored, text_slices

BANDS, ROWS, ROUNDS = 32, 6, 3
_drawn = np.random.default_rng(17)
TIMES = _drawn.integers(1, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
PLUS = _drawn.integers(0, 2**63, BANDS * ROWS, np.uint64)
MIX = _drawn.integers(1, 2**63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
LIMIT_SHINGLES = 1 << 13


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    from xxhash import xxh64_digest

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = {b" ".join(words)} if len(words) <= size else set(map(b" ".join, zip(*(words[k:] for k in range(size)))))
    return np.unique(np.frombuffer(b"".join([xxh64_digest(s, 42) for s in shingles]), ">u8").astype(np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys of a set that is not empty."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for low in range(0, len(hashes), LIMIT_SHINGLES):
        part = hashes[low:low + LIMIT_SHINGLES, None] * TIMES + PLUS
        # The low bits of a product are poor: the high half decides.
        least = np.minimum(least, (part >> np.uint64(32)).min(axis=0))
    mixed = ((least.reshape(BANDS, ROWS) + np.uint64(1)) * MIX)
    mixed ^= mixed >> np.uint64(29)
    keys = np.zeros(BANDS, np.uint64)
    for k in range(ROWS):
        keys = (keys ^ mixed[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(32)
    return keys * np.uint64(BANDS) + np.arange(BANDS, dtype=np.uint64)


def keyed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, texts in text_slices(batch, "text"):
            nodes, sizes, keys = [], [], []
            for node, text in zip(rows.column("node").to_pylist(), texts):
                hashes = shingle_set(text, size)
                if len(hashes):
                    nodes.append(node)
                    sizes.append(len(hashes))
                    keys.append(band_keys(hashes))
            found = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            yield pa.record_batch([pa.array(found.view(np.int64)), pa.array(np.repeat(np.array(nodes, np.int64), BANDS)), pa.array(np.repeat(np.array(sizes, np.int32), BANDS))],
                                  ["key", "node", "n"])


def with_sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, texts in text_slices(batch, "text"):
            sets = [shingle_set(t, size).view(np.int64) for t in texts]
            yield pa.record_batch([rows.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])


def close_sizes(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b).cast("bigint") >= percent * F.greatest(a, b).cast("bigint")


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (first, node) whose sets have a Jaccard similarity of at least `percent`. The nodes' sets come first: where thousands of
    pairs have one `first`, their rows are then large enough for AQE to split."""
    left = sets.select(F.col("node").alias("first"), F.col("shingles").alias("_a"))
    both = pairs.join(sets.withColumnRenamed("shingles", "_b").hint("merge"), "node").join(left.hint("merge"), "first")
    a, b = F.size("_a").cast("bigint"), F.size("_b").cast("bigint")
    common = F.size(F.array_intersect("_a", "_b"))
    return both.where(close_sizes(a, b, percent) & ((100 + percent) * common >= percent * (a + b))).select("first", "node")


def shared_keys(keys: DataFrame) -> DataFrame:
    """The rows of keys of two nodes or more, with the key's `first` node and its size `first_n`."""
    firsts = keys.groupBy("key").agg(F.min(F.struct("node", "n")).alias("_f"), F.max("node").alias("_last")).where("_f.node != _last")
    firsts = firsts.select("key", F.col("_f.node").alias("first"), F.col("_f.n").alias("first_n"))
    return stored(keys.join(stored(firsts, "firsts").hint("merge"), "key"), "shared")


def without(rows: DataFrame, gone: DataFrame, column: str) -> DataFrame:
    return rows.join(gone.select(F.col("node").alias(column)), column, "left_anti")


def settled(shared: DataFrame, sets: DataFrame, percent: int, dropped: list[DataFrame]) -> DataFrame:
    """What still shares keys after ROUNDS rounds; what goes in them is added to `dropped`."""
    kept = [c for c in shared.columns if c not in ("first", "first_n")]
    for _ in range(ROUNDS):
        staying = stored(shared.groupBy("node").agg(F.max(F.col("first") != F.col("node")).alias("later")).where("NOT later").select("node"), "staying")
        asked = shared.where(F.col("first") != F.col("node")).where(close_sizes(F.col("n"), F.col("first_n"), percent)).select("first", "node").distinct()
        # Stored, so that nothing stands above the join and AQE can split a `first` of many rows.
        pairs = stored(asked, "asked").join(staying.select(F.col("node").alias("first")).hint("merge"), "first", "left_semi")
        gone = stored(similar(stored(pairs, "pairs"), sets, percent).select("node").distinct(), "gone")
        dropped.append(gone)
        # A row that stays has been compared with all that share a key with it.
        shared = shared_keys(without(without(shared.select(*kept), gone, "node"), staying, "node"))
    return shared


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """`key`, `node`, its set's size `n` and the key's place `at` for the rarest shingles of every set that other sets have too: of n
    shingles as many that a set with `percent` of them has one of these."""
    each = sets.select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("key"))
    counts = stored(each.groupBy("key").agg(F.count("*").alias("sets")).where("sets > 1"), "counts")
    often = each.join(counts.hint("merge"), "key")
    lists = often.groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("sets", "key"))).alias("common"))
    # Shingles of one set alone come first and are no keys.
    alone, length = F.col("n") - F.size("common"), F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    numbered = lists.select("node", "n", F.posexplode(F.slice("common", 1, F.greatest(length - alone, F.lit(0)).cast("int"))).alias("k", "c"), alone.alias("alone"))
    return stored(numbered.select(F.col("c.key").alias("key"), "node", "n", (F.col("alone") + F.col("k")).alias("at")), "prefixes")


def candidates(shared: DataFrame, percent: int) -> DataFrame:
    """Pairs (first, node) that share a key of their prefixes and can be similar: by their sizes, and by what is left of both sets from there on."""
    left = shared.select("key", F.col("node").alias("first"), F.col("n").alias("_n"), F.col("at").alias("_at"))
    wanted = percent * (F.col("n") + F.col("_n")).cast("bigint")
    rest = F.least(F.col("n") - F.col("at"), F.col("_n") - F.col("_at")).cast("bigint")
    # Before the first shared key nothing is shared: where it is not the first, another key gives the pair.
    possible = (F.col("first") < F.col("node")) & close_sizes(F.col("n"), F.col("_n"), percent) & ((100 + percent) * rest >= wanted)
    right = shared.select("key", "node", "n", "at").alias("r")
    return left.join(right, (left["key"] == F.col("r.key")) & possible).select("first", "node").distinct()


def dropped_nodes(keys: DataFrame, sets_of, percent: int) -> DataFrame:
    """`node` of every row that goes."""
    shared = shared_keys(keys)
    sets = stored(sets_of(shared.select("node").distinct()), "sets")
    dropped: list[DataFrame] = []
    shared = settled(shared, sets, percent, dropped)
    sets = stored(sets.join(shared.select("node").distinct(), "node", "left_semi"), "sets")
    shared = settled(shared_keys(prefixes(sets, percent)), sets, percent, dropped)
    edges = stored(similar(stored(candidates(shared, percent), "pairs"), sets, percent), "edges")
    while not edges.isEmpty():
        staying = edges.select(F.col("first").alias("node")).distinct().join(edges.select("node").distinct(), "node", "left_anti")
        gone = stored(edges.join(staying.select(F.col("node").alias("first")), "first", "left_semi").select("node").distinct(), "gone")
        dropped.append(gone)
        edges = stored(without(without(edges, gone, "node"), gone, "first"), "edges")
    out = dropped[0]
    for more in dropped[1:]:
        out = out.union(more)
    return out


def without_near_copies(docs: DataFrame, percent: int = 80, size: int = 5, id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without the rows whose shingles are similar, by `percent` or more, to those of a row that stays."""
    whole = F.coalesce(F.col(text), F.lit(""))
    node: Column = F.xxhash64(null_safe_key(F.col(id)), whole)
    named = docs.select(node.alias("node"), whole.alias("text"))
    keys = stored(in_arrow(named, lambda batches: keyed(batches, size), "key bigint, node bigint, n int"), "keys")

    def sets_of(nodes: DataFrame) -> DataFrame:
        some = named.join(nodes, "node", "left_semi")
        return in_arrow(some, lambda batches: with_sets(batches, size), "node bigint, shingles array<bigint>").dropDuplicates(["node"])

    gone = stored(dropped_nodes(keys, sets_of, percent).select(F.col("node").alias("gone")), "near_copies")
    # The row in one struct: its columns can have any names.
    packed = docs.select(node.alias("node"), F.struct(*docs.columns).alias("row"))
    return packed.join(gone, F.col("node") == F.col("gone"), "left_anti").dropDuplicates(["node"]).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
