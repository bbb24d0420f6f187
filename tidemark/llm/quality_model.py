"""A generalised additive model with pairwise interactions, scored by adding table entries.

Training boosts one feature at a time in turn: a shallow tree on the feature's bins fits the gradient of the logistic loss, and
its leaves are added to the feature's lookup table. Then the pairs of features whose coarse grid reduces the loss most get
tables too, boosted in the same cyclic way by one cut on each side. A text's score is the logistic of the intercept plus one
entry per feature and pair.

Features are of the text alone: lengths, shares of characters and words, repetition. Training uses at most `max_rows` labelled
rows, those with the smallest hash of their id, and happens on the driver over their features only. Scoring is one pass over
all texts with the tables, whose size is fixed by features and bins.

Null texts are empty texts and have a score. A label without a document, or a null label, is not used; with no usable label, or only one class,
the score is the smoothed share of label 1 (one half without any). Repeated rows each get their row; columns of other names are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import in_arrow, text_slices

FEATURES = ("words", "mean_word", "long_words", "short_words", "unique_words", "top_word", "repeats", "bigrams", "upper", "digits",
            "symbols", "exclaims", "pipes", "stops", "commas", "others", "lines", "mean_line", "unique_lines", "packed", "marked_words", "upper_words")
BINS, GRID = 32, 8
PART = 1 << 20  # bytes of a text that are split into words at a time
BLANK = re.compile(rb"[ \t-\r]")
LETTERS = re.compile(rb"[A-Za-z\x80-\xff]+")


def share(n: float, of: float) -> float:
    return n / of if of else 0.0


def parts_of(text: bytes) -> Iterator[bytes]:
    """A text in parts of about PART bytes that end at a blank."""
    low = 0
    while low < len(text):
        blank = BLANK.search(text, low + PART) if low + PART < len(text) else None
        high = blank.end() if blank else len(text)
        yield text[low:high]
        low = high


def features_of(text: bytes) -> list[float]:
    """FEATURES of one text. Words and pairs of words are counted over the whole text by their hashes; the words themselves are held part by
    part, so memory is a few bytes a word however long the text is."""
    size = len(text)
    n_words = letters = long_ = short = shouted = repeats = packed = 0
    hashes, odd, last = [], [], None
    squeeze = zlib.compressobj(1)
    for part in parts_of(text):
        packed += len(squeeze.compress(part))
        words = part.split()
        if not words:
            continue
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        n_words += len(words)
        letters += int(lengths.sum())
        long_ += int((lengths > 12).sum())
        short += int((lengths < 3).sum())
        repeats += sum(map(bytes.__eq__, words, words[1:])) + (last == words[0])
        shouted += sum(map(bytes.isupper, words))
        hashes.append(np.fromiter(map(hash, words), np.int64, len(words)))
        odd += {hash(w) for w in set(words) if not w[-1:].isalnum() and w[-1] < 128}
        last = words[-1]
    if size:
        packed += len(squeeze.flush())
    unique = top = bigrams = marked = 0
    if n_words:
        every = np.concatenate(hashes)
        counts = np.unique(every, return_counts=True)[1]
        unique, top, marked = len(counts), int(counts.max()), len(set(odd))
        with np.errstate(over="ignore"):
            bigrams = len(np.unique(every[:-1] * np.int64(6364136223846793005) + every[1:]))
    lines = [line for line in text.split(b"\n") if line.strip()]
    upper = size - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = size - len(text.translate(None, b"0123456789"))
    symbols = size - len(text.translate(None, b"#*$%&<>"))
    return [
        float(np.log1p(n_words)), share(letters, n_words), share(long_, n_words), share(short, n_words), share(unique, n_words), share(top, n_words),
        share(repeats, n_words), share(bigrams, max(n_words - 1, 0)), share(upper, size), share(digits, size), share(symbols, size),
        share(text.count(b"!"), size), share(text.count(b"|"), size), share(text.count(b"."), n_words), share(text.count(b","), n_words),
        share(size - len(text.translate(None, bytes(range(128, 256)))), size), float(np.log1p(len(lines))), share(n_words, len(lines)),
        share(len(set(lines)), len(lines)), share(packed, size), share(marked, max(unique, 1)), share(shouted, n_words),
    ]


class AdditiveModel:
    """Tables of a fitted model. Bins of a feature are separated by its `edges`."""

    def __init__(self, edges: list[np.ndarray], intercept: float):
        self.edges, self.intercept = edges, intercept
        self.tables = [np.zeros(len(e) + 1) for e in edges]
        self.coarse = [np.minimum(np.arange(len(e) + 1) * GRID // (len(e) + 1), GRID - 1) for e in edges]
        self.pairs: list[tuple[int, int, np.ndarray]] = []

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], axis=1)

    def logit(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.intercept)
        for k, values in enumerate(self.tables):
            out += values[bins[:, k]]
        for a, b, values in self.pairs:
            out += values[self.coarse[a][bins[:, a]], self.coarse[b][bins[:, b]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(self.bins(x)), -30, 30)))


def leaves(gradient: np.ndarray, weight: np.ndarray, cuts: int, ridge: float) -> np.ndarray:
    """A tree of `cuts` cuts on ordered bins, each the one that gains most: the step of every bin."""
    bounds = [0, len(gradient)]
    g, h = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(weight)])
    worth = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)
    for _ in range(cuts):
        best = (1e-9, None)
        for a, b in zip(bounds, bounds[1:]):
            if b - a > 1:
                at = np.arange(a + 1, b)
                gain = worth(a, at) + worth(at, b) - worth(a, b)
                k = int(gain.argmax())
                best = max(best, (float(gain[k]), int(at[k])), key=lambda p: p[0])
        if best[1] is None:
            break
        bounds = sorted([*bounds, best[1]])
    step = np.zeros(len(gradient))
    for a, b in zip(bounds, bounds[1:]):
        step[a:b] = (g[b] - g[a]) / (h[b] - h[a] + ridge)
    return step


def quadrants(gradient: np.ndarray, weight: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """The best single cut on each side of a grid: the step of every cell, and the gain."""
    g, h = (np.pad(t.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for t in (gradient, weight))
    size = len(gradient)
    cuts = np.arange(1, size)
    r, c = cuts[:, None], cuts[None, :]
    sums = [(t[r, c], t[r, size] - t[r, c], t[size, c] - t[r, c], t[size, size] - t[r, size] - t[size, c] + t[r, c]) for t in (g, h)]
    gain = sum(a ** 2 / (b + ridge) for a, b in zip(*sums)) - g[-1, -1] ** 2 / (h[-1, -1] + ridge)
    at = np.unravel_index(gain.argmax(), gain.shape)
    values = [s[at] / (w[at] + ridge) for s, w in zip(*sums)]
    step = np.zeros_like(gradient)
    i, j = cuts[at[0]], cuts[at[1]]
    step[:i, :j], step[:i, j:], step[i:, :j], step[i:, j:] = values
    return step, float(gain[at])


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pairs: int = 8, pair_rounds: int = 60, rate: float = 0.1, ridge: float = 3.0) -> AdditiveModel:
    prior = (y.sum() + 1) / (len(y) + 2)
    quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = [np.unique(np.quantile(x[:, k], quantiles)) if len(x) else np.zeros(0) for k in range(len(FEATURES))]
    model = AdditiveModel(edges, float(np.log(prior / (1 - prior))))
    if not len(y) or y.min() == y.max():
        return model
    bins = model.bins(x)
    logit = np.full(len(y), model.intercept)

    def slopes():
        p = 1 / (1 + np.exp(-logit))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for k in range(len(FEATURES)):
            residual, weight = slopes()
            size = len(model.tables[k])
            step = rate * leaves(np.bincount(bins[:, k], residual, size), np.bincount(bins[:, k], weight, size), 2, ridge)
            model.tables[k] += step
            logit += step[bins[:, k]]
    coarse = np.stack([model.coarse[k][bins[:, k]] for k in range(len(FEATURES))], axis=1)
    cell = lambda a, b: coarse[:, a] * GRID + coarse[:, b]
    grid = lambda at, v: np.bincount(at, v, GRID * GRID).reshape(GRID, GRID)
    residual, weight = slopes()
    gains = sorted(((quadrants(grid(cell(a, b), residual), grid(cell(a, b), weight), ridge)[1], a, b)
                    for a in range(len(FEATURES)) for b in range(a)), reverse=True)[:pairs]
    model.pairs = [(a, b, np.zeros((GRID, GRID))) for _, a, b in gains]
    for _ in range(pair_rounds):
        for a, b, values in model.pairs:
            residual, weight = slopes()
            at = cell(a, b)
            step = rate * quadrants(grid(at, residual), grid(at, weight), ridge)[0]
            values += step
            logit += step.ravel()[at]
    return model


def held_out(id: Column) -> Column:
    """Rows whose label is never learnt from."""
    return F.coalesce(F.pmod(F.crc32(id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, texts in text_slices(batch, "text"):
            x = np.array([features_of(t) for t in texts])
            yield pa.record_batch([rows.column("label"), *(pa.array(x[:, k]) for k in range(len(FEATURES)))], ["label", *FEATURES])


def scored(batches: Iterator[pa.RecordBatch], model: AdditiveModel, text: str, drop: bool, name: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, texts in text_slices(batch, text):
            score = model.score(np.array([features_of(t) for t in texts]))
            yield (rows.drop_columns([text]) if drop else rows).append_column(name, pa.array(score))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 20_000, id: str = "doc_id", text: str = "text") -> AdditiveModel:
    """A model of `label` on the labelled rows that are not held out."""
    wanted = labels.select(F.col(id).alias("_id"), F.col(label).cast("double").alias("label")).where(F.col("label").isin(0.0, 1.0) & ~held_out(F.col("_id")))
    # Broadcast bound: `max_rows` ids and labels.
    chosen = wanted.where(F.col("_id").isNotNull()).orderBy(F.xxhash64(F.lit(5), "_id"), "label").limit(max_rows)
    sample = docs.select(F.col(id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "_id")
    rows = in_arrow(sample.select("label", "text"), measured, ", ".join(["label double", *(f"{f} double" for f in FEATURES)]))
    # Ids that repeat in either table could make the join larger than the bound.
    table = rows.orderBy(F.xxhash64(F.lit(5), *FEATURES), "label").limit(max_rows).toPandas()
    return fit(table[list(FEATURES)].to_numpy(float), table["label"].to_numpy(float))


def with_scores(docs: DataFrame, model: AdditiveModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """The kept columns and the score of every row."""
    kinds, drop = dict(docs.dtypes), text not in keep
    rows = docs.select(*[c for c in keep if c != text], text)
    out = ", ".join([*(f"`{c}` {kinds[c]}" for c in rows.columns if c != text or not drop), f"{name} double"])
    return in_arrow(rows, lambda batches: scored(batches, model, text, drop, name), out)
