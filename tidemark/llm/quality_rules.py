"""Quality rules whose thresholds adapt to each language and source.

Measures of every document are summarised, per language and source, in quantile sketches: counts of logarithmic buckets, whose
quantiles are within `ACCURACY` of the value. Sketches merge by adding counts, so they are summed partially before the shuffle, a
source of any size included, and a group too small to speak for itself takes the sketch of its language or of all documents.
A measure fails beyond the outer fence of its group: `FENCE` interquartile ranges from the quartiles, and `FLOOR` at least, so that a
measure that is the same nearly everywhere does not fail by a trifle. Quartiles hold while less than a quarter of a group is junk on a
side, and the share that fails grows with the junk. Quartiles of n rows are off by about a range / sqrt(n): the reach of the fence is wider
by WIDEN / sqrt(n) of itself, at every n. Thresholds are one row per group, stored before the join: the planner broadcasts them only if
they are small.

Null texts have no words and fail the base rule. Null languages and sources are groups of their own. Repeated rows each keep their row;
an empty table gives no row; only the named columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import BLANKS, null_safe_key, stored, words_between

SYMBOLS = r"[^#*$%&|<>]+"
ACCURACY = 0.01
GAMMA = (1 + ACCURACY) / (1 - ACCURACY)
FENCE, WIDEN, MIN_ROWS = 3.0, 6.0, 200
FLOOR = {"word_length": 0.5, "symbol_share": 0.02, "dup_line_share": 0.05, "repeat_share": 0.2}
# Measures and the sides on which they can fail.
MEASURES = {
    "word_length": ("low", "high"), "symbol_share": ("high",), "dup_line_share": ("high",), "repeat_share": ("high",),
}


def repeated_words(windows: Column) -> Column:
    """Words in windows of three (given by their hashes, in order) that occur twice or more: equal ones are neighbours once sorted."""
    placed = F.array_sort(F.zip_with(windows, F.sequence(F.lit(1), F.size(windows)), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    many = F.size(windows)

    def again(sorted_: Column) -> Column:
        same = lambda a, b: F.element_at(sorted_, a)["h"] == F.element_at(sorted_, b)["h"]
        at = F.filter(F.sequence(F.lit(1), many), lambda k: F.when(k > 1, same(k, F.greatest(k - 1, F.lit(1)))).otherwise(F.lit(False))
                      | F.when(k < many, same(k, F.least(k + 1, many))).otherwise(F.lit(False)))
        return F.size(F.array_distinct(F.flatten(F.transform(at, lambda k: F.transform(F.sequence(F.lit(0), F.lit(2)), lambda d: F.element_at(sorted_, k)["i"] + d)))))

    return F.element_at(F.transform(F.array(placed), again), 1)


def measures(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """The kept columns, `n_words`, `word_chars`, `n_symbols`, `n_dup_lines`, `n_repeat_words`, and whether the base rule fails."""
    whole = F.coalesce(F.col(text), F.lit(""))
    split = docs.select(*keep, whole.alias("_whole"), words_between(F.col(text), BLANKS).alias("_words"),
                        F.filter(F.split(whole, "\n", -1), lambda line: F.btrim(line, F.lit(" \t\n\x0b\f\r")) != "").alias("_lines"))
    size = F.size("_words")
    # A window's hash takes all three words; two windows of a text with one hash are as good as impossible.
    hashed = F.transform("_words", lambda w: F.xxhash64(w))
    shifted = lambda k: F.slice(F.col("_h"), F.lit(k), F.greatest(F.size("_h") - 2, F.lit(0)))
    windows = F.transform(F.arrays_zip(shifted(1).alias("a"), shifted(2).alias("b"), shifted(3).alias("c")), lambda t: F.xxhash64(t["a"], t["b"], t["c"]))
    counted = split.select(*keep, size.cast("bigint").alias("n_words"), F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
                           F.length(F.regexp_replace("_whole", SYMBOLS, "")).cast("bigint").alias("n_symbols"),
                           (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
                           F.when(size > 2, hashed).otherwise(F.expr("CAST(array() AS array<bigint>)")).alias("_h"))
    tripled = counted.select(*[c for c in counted.columns if c != "_h"], windows.alias("_windows"))
    different = F.size(F.array_distinct("_windows")) == F.size("_windows")
    out = tripled.withColumn("n_repeat_words", F.when(different, 0).otherwise(repeated_words(F.col("_windows"))).cast("bigint")).drop("_windows")
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def with_shares(rows: DataFrame) -> DataFrame:
    of = lambda n, d: F.when(F.col(d) > 0, F.col(n) / F.col(d)).otherwise(0.0)
    return rows.withColumns({"word_length": of("word_chars", "n_words"), "symbol_share": of("n_symbols", "word_chars"),
                             "dup_line_share": of("n_dup_lines", "n_words"), "repeat_share": of("n_repeat_words", "n_words")})


def bucket_of(value: Column) -> Column:
    """Bucket 0 holds no more than a millionth; bucket b holds values up to a millionth times GAMMA ** b."""
    return F.when(value <= 1e-6, 0).otherwise(F.ceil(F.log(value / 1e-6) / math.log(GAMMA))).cast("int")


def value_of(bucket: Column) -> Column:
    return F.when(bucket == 0, 0.0).otherwise(1e-6 * F.pow(F.lit(GAMMA), bucket) * 2 / (1 + GAMMA))


def sketches(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts per group, measure and bucket."""
    each = rows.select(*by, F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), bucket_of(F.col(m)).alias("bucket")) for m in MEASURES))).alias("m"))
    return each.groupBy(*by, "m.measure", "m.bucket").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, by: list[str]) -> DataFrame:
    return sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, by: str, wanted: dict[str, float]) -> DataFrame:
    """A row per group and measure: `total` and the wanted quantiles."""
    # A window's rows are the buckets of one sketch: a few thousand at most.
    along = Window.partitionBy(by, "measure").orderBy("bucket")
    all_ = Window.partitionBy(by, "measure")
    summed = sketch.withColumns({"_upto": F.sum("n").over(along), "total": F.sum("n").over(all_)})
    found = {name: F.min(F.when(F.col("_upto") >= F.greatest(F.ceil(F.lit(q) * F.col("total")), F.lit(1)), value_of(F.col("bucket")))).alias(name) for name, q in wanted.items()}
    return summed.groupBy(by, "measure").agg(F.max("total").alias("total"), *found.values())


def thresholds(rows: DataFrame, lang: str, source: str) -> DataFrame:
    """A row per language and source: `low_<measure>` and `high_<measure>`."""
    keyed = rows.withColumns({"_lang": null_safe_key(F.col(lang)), "_source": null_safe_key(F.col(source))})
    own = stored(sketches(keyed, ["_lang", "_source"]), "sketches")
    wanted = {"low": 0.25, "high": 0.75}
    group = F.concat_ws("\x00", "_lang", "_source")
    scopes = [("group", own.withColumn("scope", group)), ("lang", own.withColumn("scope", F.col("_lang"))), ("all", own.withColumn("scope", F.lit("all")))]
    levels = [quantiles(merged(frame, ["scope"]), "scope", wanted).withColumn("level", F.lit(name)) for name, frame in scopes]
    every = stored(levels[0].union(levels[1]).union(levels[2]), "quantiles")
    levels = {}
    for name in ("group", "lang", "all"):
        levels[name] = every.where(F.col("level") == name).select(
            F.col("scope").alias(f"_{name}_scope"), F.col("measure").alias(f"_{name}_measure"), F.struct("total", *wanted).alias(f"_{name}_q"))
    best = own.select("_lang", "_source", "measure").distinct()
    for name, key in (("group", group), ("lang", F.col("_lang")), ("all", F.lit("all"))):
        best = best.join(levels[name], (F.col(f"_{name}_scope") == key) & (F.col(f"_{name}_measure") == F.col("measure")), "left")
    chosen = F.when(F.col("_group_q.total") >= MIN_ROWS, F.col("_group_q")).when(F.col("_lang_q.total") >= MIN_ROWS, F.col("_lang_q")).otherwise(F.col("_all_q"))
    spread = F.col("q.high") - F.col("q.low")
    floor = F.element_at(F.create_map(*(F.lit(v) for pair in FLOOR.items() for v in pair)), F.col("measure"))
    reach = F.greatest(FENCE * spread, floor) * (1 + WIDEN / F.sqrt("q.total"))
    bounds = best.select("_lang", "_source", "measure", chosen.alias("q")).select(
        "_lang", "_source", "measure", (F.col("q.low") - reach).alias("low"), (F.col("q.high") + reach).alias("high"))
    wide = [F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{side}_{m}") for m, sides in MEASURES.items() for side in sides]
    return stored(bounds.groupBy("_lang", "_source").agg(*wide), "thresholds")


def apply_rules(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """`id`, the measures, `base_failed` and `kept` of every row. Thresholds are taken over the documents that pass the base rule."""
    named = docs.select(F.col(id).alias("_id"), F.col(lang).alias("_l"), F.col(source).alias("_s"), F.col(text).alias("_text"))
    rows = with_shares(stored(measures(named, ["_id", "_l", "_s"], "_text"), "measures"))
    limits = thresholds(rows.where("NOT base_failed"), "_l", "_s")
    joined = rows.withColumns({"_own_lang": null_safe_key(F.col("_l")), "_own_source": null_safe_key(F.col("_s"))}).join(
        limits, (F.col("_own_lang") == F.col("_lang")) & (F.col("_own_source") == F.col("_source")), "left")
    failed = F.lit(False)
    for m, sides in MEASURES.items():
        for side in sides:
            beyond = F.col(m) < F.col(f"low_{m}") if side == "low" else F.col(m) > F.col(f"high_{m}")
            failed = failed | F.coalesce(beyond, F.lit(False))
    return joined.select(F.col("_id").alias(id), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         (~F.col("base_failed") & ~failed).alias("kept"))
