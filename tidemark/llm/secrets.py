"""Secrets by fixed patterns, and by character Markov models of random strings and ordinary identifiers.

Everything is a DataFrame expression on the text's own row. Places of matches come from the matches and the gaps between them:
a running sum of their lengths. Both models are tables of transition probabilities between ASCII characters, counted with
add-one smoothing from labelled samples; a candidate token is a secret if its log-likelihood under the model of random strings
exceeds that under the other by `min_ratio`.

Null texts have no match. Any number of matches in a text is found. Repeated rows each keep their row; an empty table gives no
row; with no sample of a class its model is the uniform one. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns, in the order in which their kinds are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (
    ("assign", ASSIGN, 12),  # at least 12 characters in group 2
    # Whole runs, so asking for the least length inside the pattern drops the same matches.
    ("access", r"AKIA[A-Z0-9]{14,}", None),
    ("hex", r"[0-9a-f]{16,}", None),
)
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
SPANS = "array<struct<start:int,kind:int,end:int>>"
BLOCK = 256
ASCII = 128


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then(value)` with `value` computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def running_sums(values: Column) -> Column:
    """Inclusive running sums of an array, by sums of blocks: no element sums more than a block and the blocks' sums."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, v: a + v)

    def with_blocks(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: total(F.slice(v, b * BLOCK + 1, F.lit(BLOCK))))
        return let(blocks, lambda s: F.transform(F.sequence(F.lit(0), F.size(v) - 1), lambda i: (
            total(F.slice(s, F.lit(1), F.floor(i / BLOCK).cast("int"))) + total(F.slice(v, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK + 1)))))

    return let(values, with_blocks)


def places(text: Column, pattern: str, kind: int, group: int = 0, least: int | None = None) -> Column:
    """SPANS of the matches of a pattern that never matches nothing, in code points; `group` must have `least` characters."""
    none = F.expr(f"CAST(array() AS {SPANS})")

    def found(matches: Column) -> Column:
        steps = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)), matches, lambda gap, match: F.length(gap) + F.length(match))
        rows = let(running_sums(steps), lambda ends: F.zip_with(matches, ends, lambda match, end: F.struct(
            (end - F.length(match)).alias("start"), F.lit(kind).alias("kind"), end.alias("end"))))
        if least is not None:
            sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length)
            rows = F.filter(let(sizes, lambda n: F.zip_with(rows, n, lambda row, size: F.when(size >= least, row))), lambda row: row.isNotNull())
        return F.when(F.size(matches) == 0, none).otherwise(rows.cast(SPANS))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found)


def base_spans(text: Column) -> Column:
    return F.array_sort(F.concat(*(places(text, pattern, k, 2 if least else 0, least) for k, (_, pattern, least) in enumerate(BASE))))


def base_values(docs: DataFrame, text: str = "text") -> DataFrame:
    """The strings that the base patterns catch: `sample`."""
    whole = F.coalesce(F.col(text), F.lit(""))
    values = F.concat(*(F.regexp_extract_all(whole, F.lit(pattern), F.lit(2 if least else 0)) for _, pattern, least in BASE))
    return docs.select(F.explode(values).alias("sample")).where(F.length("sample") >= 12)


def labelled_samples(docs: DataFrame, id: str = "doc_id", text: str = "text", max_samples: int = 5_000) -> DataFrame:
    """`sample`, `random`: at most `max_samples` strings for each of four kinds, those with the smallest hashes.

    Random: what the base patterns catch in all documents, and base-64 digests of ids. Ordinary: words of letters, and such words
    joined as identifiers are, from the documents with the smallest hashes.
    """
    first = lambda df, *by: df.orderBy(F.xxhash64(F.lit(11), *by), *by).limit(max_samples)
    caught = first(base_values(docs, text).distinct(), "sample")
    digests = first(docs.select(F.base64(F.unhex(F.sha2(F.col(id).cast("string"), 256))).alias("sample")).where("sample IS NOT NULL").distinct(), "sample")
    ids = docs.select(F.col(id).alias("_id")).distinct().orderBy(F.xxhash64(F.lit(11), "_id"), "_id").limit(max_samples // 10)  # without texts
    some = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(ids), "_id", "left_semi")  # bound: `max_samples` / 10 ids
    words = some.select(F.filter(F.split(F.coalesce("_text", F.lit("")), r"[^A-Za-z]+"), lambda w: F.length(w) >= 4).alias("w"))
    pairs = words.select(F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 2, F.lit(0))), lambda i: F.slice(F.col("w"), i + 1, F.lit(3)))).alias("p"))
    pairs = pairs.where(F.size("p") > 0)
    plain = first(pairs.select(F.element_at("p", 1).alias("sample")).distinct(), "sample")
    joined = first(pairs.select(F.explode(F.array(F.lower(F.array_join("p", "_")), F.array_join(F.transform("p", F.initcap), ""))).alias("sample")).distinct(), "sample")
    return (caught.union(digests).withColumn("random", F.lit(1))).union(plain.union(joined).withColumn("random", F.lit(0)))


def codes(sample: Column) -> Column:
    return F.transform(F.regexp_extract_all(sample, F.lit("."), F.lit(0)), F.ascii)


def log_ratios(samples: DataFrame) -> list[float]:
    """log P(next | character, random) - log P(next | character, ordinary) for all pairs of ASCII codes: a table of fixed size."""
    coded = samples.select("random", codes(F.col("sample")).alias("c")).where(F.size("c") > 1)
    steps = coded.select("random", F.explode(F.zip_with(F.slice("c", 1, F.size("c") - 1), F.slice("c", 2, F.size("c") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("s"))
    counted = steps.where(f"s.a < {ASCII} AND s.b < {ASCII}").groupBy("random", "s.a", "s.b").agg(F.count("*").alias("n")).collect()  # at most 2 * 128 * 128 rows
    pairs, totals = {}, {}
    for r in counted:
        pairs[r["random"], r["a"], r["b"]] = r["n"]
        totals[r["random"], r["a"]] = totals.get((r["random"], r["a"]), 0) + r["n"]
    chance = lambda k, a, b: math.log((pairs.get((k, a, b), 0) + 1) / (totals.get((k, a), 0) + ASCII))
    return [round(chance(1, a, b) - chance(0, a, b), 6) for a in range(ASCII) for b in range(ASCII)]


def table_of(ratios: list[float]) -> Column:
    """The ratios as one constant array."""
    return F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")


def ratio_of(token: Column, table: Column) -> Column:
    """Sum of the log ratios of a token's steps."""
    return let(codes(token), lambda c: F.aggregate(
        F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: F.element_at(table, a * ASCII + b + 1)),
        F.lit(0.0), lambda total, v: total + v))


def find_secrets(docs: DataFrame, ratios: list[float], min_ratio: float = 12.0, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The kept columns, `base` and `model` spans (kind: index in BASE; the model's comes behind them). The model adds tokens that
    base spans do not cover wholly, whole."""
    model = len(BASE)
    # The text's alias is drawn so that no kept column has it.
    named = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_secret_text"))
    based = named.withColumn("base", base_spans(F.col("_secret_text")))
    table = table_of(ratios)

    def scored(spans: Column) -> Column:
        tokens = F.regexp_extract_all(F.col("_secret_text"), F.lit(CANDIDATE), F.lit(0))
        # How far sorted base spans cover a token from its start on.
        reached = lambda s: F.aggregate("base", s["start"], lambda at, b: F.when(b["start"] <= at, F.greatest(at, b["end"])).otherwise(at))
        free = lambda s: reached(s) < s["end"]
        rows = F.zip_with(spans, tokens, lambda s, t: F.when(free(s) & (ratio_of(t, table) >= min_ratio), s))
        return F.filter(rows, lambda s: s.isNotNull())

    added = let(places(F.col("_secret_text"), CANDIDATE, model), lambda s: F.when(F.size(s) == 0, s).otherwise(scored(s)))
    return based.select(*keep, "base", added.alias("model"))


def spans_text(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    names = F.array(*(F.lit(n) for n, _, _ in BASE), F.lit("model"))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def count_of(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
