"""Boilerplate lines by their frequency within a site.

A line's pages are the different texts of its host that hold it. It is boilerplate there, and leaves the host's texts, if its pages are
more than a ratio of the host's pages and at least a number of them. Both depend on its words: a line of up to SHORT words takes
`max_ratio` and `min_pages`; a line of w words (SHORT / w)**2 of that ratio, and over LONG words LONG_PAGES pages, for nobody writes
a long line twice. Exact copies are one page, so copying a document makes no boilerplate of it. Lines are compared without blanks at
either end; blank lines are never counted nor dropped.

A host of any size spreads: pages are counted by host, line and text first, then by host and line, with partial sums before each
shuffle. What is joined back is one row per host with its boilerplate lines: at most the host's lines per page
divided by `max_ratio`. It is broadcast only while all hosts together have no more than BROADCAST_LINES lines, which are counted;
beyond that documents are joined by host and a salt, which a third of all rows with one host cannot crowd.

A null host is a host of its own; null texts stay null, have no lines and are no pages; repeated rows are one page; an empty table
gives no row; all columns of `docs` are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BLANKS, null_safe_key, spare_names, stored

SALTS = 64
BROADCAST_LINES = 100_000  # of 16 bytes
SHORT, LONG, LONG_PAGES = 10, 50, 3
BLANK = " \t\n\x0b\f\r"


def line_key(line: Column) -> Column:
    """128 bits that stand for a line without its outer blanks."""
    bare = F.btrim(line, F.lit(BLANK))
    return F.struct(F.xxhash64(bare).alias("h1"), F.xxhash64(F.lit(1), bare).alias("h2"))


def counted_line(line: Column) -> Column:
    """The line's key and its words."""
    bare = F.btrim(line, F.lit(BLANK))
    return F.struct(F.xxhash64(bare).alias("h1"), F.xxhash64(F.lit(1), bare).alias("h2"), F.size(F.split(bare, BLANKS)).alias("words"))


def has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANK)) != ""


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def boilerplate(docs: DataFrame, host: str, text: str, max_ratio: float, min_pages: int) -> DataFrame:
    """`host`, `h1`, `h2` of every boilerplate line."""
    pages = docs.where(F.col(text).isNotNull()).select(null_safe_key(F.col(host)).alias("host"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("page"))
    own = F.array_distinct(F.transform(F.filter(lines_of(F.col("text")), has_word), counted_line))
    each = pages.select("host", "page", F.explode(own).alias("line"))
    lines = each.groupBy("host", "line.h1", "line.h2").agg(F.count_distinct("page").alias("pages"), F.min("line.words").alias("words"))
    totals = pages.groupBy("host").agg(F.count_distinct("page").alias("total"))
    often = lines.where(F.col("pages") >= F.when(F.col("words") > LONG, LONG_PAGES).otherwise(min_pages))
    length = F.greatest(F.col("words"), F.lit(SHORT))
    return often.join(totals, "host").where(F.col("pages") * length * length > max_ratio * SHORT * SHORT * F.col("total")).select("host", "h1", "h2")


def without_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = 0.05, min_pages: int = 5,
                        counts: tuple[str, str] | None = None) -> DataFrame:
    """`docs` with the boilerplate lines gone from `text`; `counts` names two more columns: lines before, and dropped."""
    found = stored(boilerplate(docs, host, text, max_ratio, min_pages), "boilerplate")
    line_host, drop, own_host, line_salt, own_salt, kept = spare_names(docs, "line_host", "drop", "own_host", "line_salt", "own_salt", "kept")
    per_host = found.groupBy(F.col("host").alias(line_host)).agg(F.collect_list(F.struct("h1", "h2")).alias(drop))
    spread = docs.withColumn(own_host, null_safe_key(F.col(host)))
    same = F.col(own_host) == F.col(line_host)
    if found.count() <= BROADCAST_LINES:
        joined = spread.join(F.broadcast(per_host), same, "left")
    else:
        salted = per_host.withColumn(line_salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        spread = spread.withColumn(own_salt, F.pmod(F.xxhash64(text), F.lit(SALTS)).cast("int"))
        joined = spread.join(salted.hint("merge"), same & (F.col(own_salt) == F.col(line_salt)), "left")
    keep = F.filter(lines_of(F.col(text)), lambda line: ~(has_word(line) & F.array_contains(F.col(drop), line_key(line))))
    cleaned = joined.withColumn(kept, F.when(F.col(drop).isNotNull() & F.col(text).isNotNull(), keep))
    out = F.when(F.col(kept).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    columns = [out.alias(c) if c == text else F.col(c) for c in docs.columns]
    if counts:
        lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines_of(F.col(text))))
        dropped = F.when(F.col(kept).isNull(), 0).otherwise(lines - F.size(kept))
        columns += [lines.cast("bigint").alias(counts[0]), dropped.cast("bigint").alias(counts[1])]
    return cleaned.select(*columns)
