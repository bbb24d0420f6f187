"""Benchmark decontamination by a generalised suffix automaton of the test items' words.

The automaton holds every run of words of every item. Streaming a document's words through it gives, at each word, the
longest run ending there that some item contains; where that is at least `window` words, the last `window` are a window of
an item. Words outside the items' vocabulary, and pairs of words that no item contains, end any match, so only stretches
whose pairs all occur in items are streamed: the rest is ruled out in numpy.

Items are taken in blocks of a bounded number of words, so an automaton's size does not depend on the number of items; each
block reads all documents, and a document's spans meet afterwards, without its text.

Null or empty texts have no words; an item without words has no window; items that share an id count once; a null item id
is named "null". Repeated documents each keep their row. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import NOT_WORD, WORD_BYTES, in_arrow, lower_ascii, spare_names, stored, text_slices, words_between

BLOCK_WORDS = 100_000
END = b"\xff"
HITS = "doc_id {0}, h1 bigint, h2 bigint, n_rows int, n_words bigint, longest int, spans array<bigint>, items array<string>"
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


class Automaton:
    """Suffix automaton of word sequences; `owners` of a state are the items that contain its windows."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next, self.link, self.length = [{}], [-1], [0]
        coded = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for name, words in items if words]
        pairs = set()
        for _, codes in coded:
            last = 0
            for code in codes:
                last = self.extend(last, code)
            pairs.update(zip(codes, codes[1:]))
        size = len(self.vocabulary)
        self.pairs = np.array(sorted(a * size + b for a, b in pairs), np.int64)
        self.shortest = min([window, *(len(codes) for _, codes in coded)])
        self.owners: dict[int, list[str]] = {}
        self.short: dict[int, dict[tuple[int, ...], list[str]]] = {}
        for name, codes in coded:
            if len(codes) < window:
                names = self.short.setdefault(len(codes), {}).setdefault(tuple(codes), [])
                if name not in names:
                    names.append(name)
                continue
            state = 0
            for code in codes:
                state = above = self.next[state][code]
                while above and self.length[above] >= window and (not (held := self.owners.setdefault(above, [])) or held[-1] != name):
                    held.append(name)
                    above = self.link[above]
        self.vocabulary[END] = -2

    def new(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def split(self, state: int, code: int, target: int) -> int:
        """The state for `state`'s longest run followed by `code`, taken out of `target` if that holds longer runs too."""
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self.new(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while state >= 0 and self.next[state].get(code) == target:
            self.next[state][code] = copy
            state = self.link[state]
        return copy

    def extend(self, last: int, code: int) -> int:
        if code in self.next[last]:
            return self.split(last, code, self.next[last][code])
        state = self.new(self.length[last] + 1, 0, {})
        while last >= 0 and code not in self.next[last]:
            self.next[last][code] = state
            last = self.link[last]
        if last >= 0:
            self.link[state] = self.split(last, code, self.next[last][code])
        return state

    def stretches(self, codes: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches [first, end) of words in which every pair occurs in an item, long enough for the shortest window."""
        if self.shortest == 1:
            fits = codes >= 0
        else:
            fits = np.zeros(len(codes), bool)  # whether a word and its follower are a pair of an item
            at = np.flatnonzero((codes[:-1] >= 0) & (codes[1:] >= 0))
            pair = codes[at].astype(np.int64) * (len(self.vocabulary) - 1) + codes[at + 1]
            place = np.minimum(np.searchsorted(self.pairs, pair), max(len(self.pairs) - 1, 0))
            fits[at] = self.pairs[place] == pair if len(self.pairs) else False
        change = np.flatnonzero(np.diff(np.concatenate([[False], fits, [False]]).astype(np.int8)))
        more = 0 if self.shortest == 1 else 1
        for first, end in zip(change[::2].tolist(), change[1::2].tolist()):
            if end + more - first >= self.shortest:
                yield first, end + more

    def match(self, codes: list[int]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Merged spans [first, end) of window words, the items they are of, and the longest match."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        state = length = longest = 0
        for place, code in enumerate(codes):
            while state and code not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if code in self.next[state]:
                state, length = self.next[state][code], length + 1
            longest = max(longest, length)
            reach = 0
            if length >= self.window:
                owner = state
                while self.length[self.link[owner]] >= self.window:
                    owner = self.link[owner]
                items.update(self.owners[owner])
                reach = self.window
            for size, texts in self.short.items():
                if size <= length and (names := texts.get(tuple(codes[place + 1 - size:place + 1]))):
                    items.update(names)
                    reach = max(reach, size)
            if reach:
                first, end = place + 1 - reach, place + 1
                while spans and spans[-1][1] >= first:
                    first = min(first, spans.pop()[0])
                spans.append((first, end))
        return spans, items, longest


_automata: dict[str, Automaton] = {}


def automaton(items: list[tuple[str, bytes]], window: int) -> Automaton:
    """One automaton per worker process at a time: that of the block in hand."""
    key = hashlib.sha256(repr((items, window)).encode()).hexdigest()
    if key not in _automata:
        _automata.clear()
        _automata[key] = Automaton([(name, text.translate(WORD_BYTES).split()) for name, text in items], window)
    return _automata[key]


def word_codes(texts: list[bytes], vocabulary: dict[bytes, int], chunk: int = 4 << 20) -> np.ndarray:
    """Codes of all words, -1 for one that no item has, and -2 behind each text."""
    joined, found, low = (b" " + END + b" ").join(texts) + b" " + END, [], 0
    while low < len(joined):
        high = joined.find(b" ", low + chunk)
        high = len(joined) if high < 0 else high
        words = joined[low:high].translate(WORD_BYTES).split()
        found.append(np.fromiter(map(vocabulary.get, words, repeat(-1)), np.int32, len(words)))
        low = high
    return np.concatenate(found)


def scan(batches: Iterator[pa.RecordBatch], items: list[tuple[str, bytes]], window: int, first: bool) -> Iterator[pa.RecordBatch]:
    """A row for every document with a span in this block of items; the first block gives every document a row."""
    known = automaton(items, window)
    for batch in batches:
        for rows, texts in text_slices(batch, "text"):
            codes = word_codes(texts, known.vocabulary)
            ends = np.flatnonzero(codes == -2)
            starts = np.concatenate([[0], ends[:-1] + 1])
            found: dict[int, tuple[list, set, int]] = {}
            for low, high in known.stretches(codes):
                spans, names, longest = known.match(codes[low:high].tolist())
                doc = int(np.searchsorted(ends, low))
                all_spans, all_names, most = found.setdefault(doc, ([], set(), 0))
                all_spans += [(a + low - int(starts[doc]), b + low - int(starts[doc])) for a, b in spans]
                all_names |= names
                found[doc] = all_spans, all_names, max(most, longest)
            keep = list(range(len(texts))) if first else sorted(d for d, f in found.items() if f[0])
            none = ([], set(), 0)
            each = [found.get(d, none) for d in keep]
            taken = rows.take(pa.array(keep, pa.int64()))
            yield pa.record_batch([
                taken.column("doc_id"), taken.column("h1"), taken.column("h2"), pa.array([int(first)] * len(keep), pa.int32()),
                pa.array((ends - starts)[keep].astype(np.int64)), pa.array([f[2] for f in each], pa.int32()),
                pa.array([[a << 32 | b for a, b in f[0]] for f in each], pa.list_(pa.int64())),
                pa.array([sorted(f[1]) for f in each], pa.list_(pa.string())),
            ], [field.split()[0] for field in HITS.split(", ")])


def text_keys(text: Column) -> tuple[Column, Column]:
    """Two independent hashes that stand for a text in joins."""
    return F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")


def item_blocks(items: DataFrame, id: str, text: str, block_words: int) -> Iterator[list[tuple[str, bytes]]]:
    """Items dealt to blocks by hash; one block at a time passes the driver."""
    named = items.select(F.coalesce(F.col(id).cast("string"), F.lit("null")).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sized = named.withColumn("n", F.size(words_between(lower_ascii(F.col("text")), NOT_WORD)))
    blocks = max(1, -(-(sized.agg(F.sum("n")).first()[0] or 0) // block_words))
    for block in range(blocks):
        rows = named.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block).distinct().collect()
        yield sorted((r["id"], r["text"].encode()) for r in rows)


def hit_spans(docs: DataFrame, items: DataFrame, window: int = 13, id: str = "doc_id", text: str = "text",
              item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: `id`, the text's keys, `n_words`, `longest` match, `spans` (first << 32 | end, in words), `items`."""
    whole = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.col(id).alias("doc_id"), whole.alias("text"), *text_keys(whole))
    kind = dict(keyed.dtypes)["doc_id"]
    found = None
    for k, block in enumerate(item_blocks(items, item_id, item_text, block_words)):
        rows = in_arrow(keyed, lambda batches, block=block, k=k: scan(batches, block, window, k == 0), HITS.format(kind))
        found = rows if found is None else found.union(rows)
    merged = found.groupBy("doc_id", "h1", "h2").agg(
        F.sum("n_rows").alias("n_rows"), F.max("n_words").alias("n_words"), F.max("longest").alias("longest"),
        F.array_sort(F.flatten(F.collect_set("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    each = merged.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("n_rows"))))  # a row again for each that repeats
    return each.select(F.col("doc_id").alias(id), "h1", "h2", "n_words", "longest", "spans", "items")


def covered(spans: Column) -> Column:
    """Words in the union of sorted spans."""
    first, end = lambda s: F.shiftright(s, 32), lambda s: s.bitwiseAND(F.lit((1 << 32) - 1))
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end"))
    step = lambda a, s: F.struct(
        (a["n"] + F.greatest(end(s) - F.greatest(first(s), a["end"]), F.lit(0))).alias("n"), F.greatest(a["end"], end(s)).alias("end"))
    return F.aggregate(spans, zero, step, lambda a: a["n"])


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, coverage: int = 20, **names) -> DataFrame:
    """`n_hit` and `items` of every document, and whether at least one word in `coverage` is hit."""
    found = hit_spans(docs, items, window, **names).withColumn("n_hit", covered(F.col("spans")))
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (coverage * F.col("n_hit") >= F.col("n_words")))


def without_spans(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = batch.column(name)
        rest = batch.drop_columns([name])
        if spans.null_count < len(batch):
            index = rest.schema.get_field_index("text")
            texts = [cut(t, s) if s else t for t, s in zip(rest.column(index).to_pylist(), spans.to_pylist())]
            rest = rest.set_column(index, rest.schema.field(index), pa.array(texts, rest.schema.field(index).type))
        yield rest


def cut(text: str, spans: list[int]) -> str:
    """`text` without the words of the spans and what stands between them."""
    raw, kept, at = text.encode(), [], 0
    words = [m.span() for m in WORD.finditer(raw)]
    for span in spans:
        first, end = span >> 32, span & (1 << 32) - 1
        kept.append(raw[at:max(at, words[first][0])])
        at = max(at, words[end - 1][1])
    return b"".join([*kept, raw[at:]]).decode()


def decontaminated(docs: DataFrame, items: DataFrame, window: int = 13, coverage: int = 20) -> DataFrame:
    """`docs` without the documents of which a `coverage`-th is hit, and without the hit spans of the others."""
    id, one, two, own_1, own_2, spans, much = spare_names(docs, "hit_id", "hit_1", "hit_2", "key_1", "key_2", "hit_spans", "hit_much")
    hits = stored(contamination(docs, items, window, coverage).where("n_hit > 0").select(
        F.col("doc_id").alias(id), F.col("h1").alias(one), F.col("h2").alias(two), F.col("spans").alias(spans), F.col("contaminated").alias(much)).distinct(), "hits")
    h1, h2 = text_keys(F.coalesce(F.col("text"), F.lit("")))
    same = F.col("doc_id").eqNullSafe(F.col(id)) & (F.col(own_1) == F.col(one)) & (F.col(own_2) == F.col(two))
    joined = docs.withColumns({own_1: h1, own_2: h2}).join(hits, same, "left")
    kept = joined.where(~F.coalesce(F.col(much), F.lit(False))).select(*docs.columns, spans)
    return in_arrow(kept, lambda batches: without_spans(batches, spans), docs.schema)
