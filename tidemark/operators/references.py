"""Foreign keys and checks that compare a row with the row it points to."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config.model import Reference, TableSpec
from tidemark.operators.gates import Gate, share_gate
from tidemark.operators.lookups import attach
from tidemark.operators.reports import percent

Reader = Callable[[str], DataFrame]

# Orphan shares, in percent, above which the run warns or fails.
ORPHAN_WARN_PCT = 1.0
ORPHAN_FAIL_PCT = 5.0


def orphan_flag(df: DataFrame, ref: Reference, parent: DataFrame, name: str | None = None,
                carry: Mapping[str, str] | None = None) -> DataFrame:
    """dq_invalid_orphan_<parent>: the key matches no parent row. A null is an orphan only where the reference is
    not optional. `parent` holds each key once; `carry` (new column -> parent column) brings values along in the
    same join, for checks that compare the row with its parent."""
    carry = dict(carry or {})
    known = parent.select(F.col(ref.parent_column).alias("_key"), F.lit(True).alias("_hit"), *[F.col(c).alias(f"_take_{n}") for n, c in carry.items()])
    joined = attach(df, known, {ref.column: "_key"}, {"_found": "_hit", **{n: f"_take_{n}" for n in carry}})
    value = F.col(ref.column)
    orphan = F.when(value.isNull(), F.lit(not ref.optional)).otherwise(F.col("_found").isNull())
    return joined.withColumn(name or f"dq_invalid_orphan_{ref.parent}", orphan).drop("_found")


def add_orphan_flags(df: DataFrame, spec: TableSpec, read: Reader, carry: Mapping[str, Mapping[str, str]] | None = None) -> DataFrame:
    """One join per reference; `carry` maps a parent table to the columns wanted from it."""
    for ref in spec.references:
        if not ref.known_broken:
            parent = read(ref.parent).where(F.col(ref.parent_column).isNotNull())
            df = orphan_flag(df, ref, parent, carry=(carry or {}).get(ref.parent))
    return df


def contradicts_parent(df: DataFrame, parent: DataFrame, on: dict[str, str], take: dict[str, str],
                       flags: dict[str, Column]) -> DataFrame:
    """Flags computed from the parent's values. A missing parent leaves them null: the orphan flag already
    says so."""
    return attach(df, parent, on, take).withColumns(flags).drop(*take)


def last_child_mismatch(df: DataFrame, children: DataFrame, key: str, child_time: str, recorded: str,
                        flag: str) -> DataFrame:
    """Flags a parent whose recorded last date is not its children's last date; no children, no flag."""
    latest = children.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(child_time).alias("_last"))
    calc = f"{recorded}_calc"
    joined = attach(df, latest, {key: key}, {calc: "_last"})
    actual, stated = F.to_date(calc), F.to_date(recorded)
    return joined.withColumn(flag, actual.isNotNull() & (stated.isNull() | (stated != actual)))


def unmatched_rows(df: DataFrame, ref: Reference, parent: DataFrame) -> DataFrame:
    """One row: non-null values of `ref` without a parent. For keys that carry no flag."""
    keys = parent.select(F.col(ref.parent_column).alias("_key"))
    child = df.where(F.col(ref.column).isNotNull()).select(ref.column)
    return child.join(keys, F.col(ref.column) == F.col("_key"), "left_anti").agg(F.count("*").alias("orphans"))


def reference_report(df: DataFrame, spec: TableSpec, read: Reader) -> DataFrame:
    """One row per reference: checked rows, orphans, share and status."""
    flagged = [r for r in spec.references if not r.known_broken]
    aggregates = [F.count("*").alias("child_rows")]
    for i, r in enumerate(spec.references):
        aggregates.append(F.count_if(F.col(r.column).isNull()).alias(f"nulls_{i}"))
        if r in flagged:
            aggregates.append(F.count_if(F.col(f"dq_invalid_orphan_{r.parent}")).alias(f"orphans_{i}"))
    counts = df.agg(*aggregates)
    for i, r in enumerate(spec.references):
        if r.known_broken:
            loose = unmatched_rows(df, r, read(r.parent)).withColumnRenamed("orphans", f"_loose_{i}")
            # one aggregate row next to one aggregate row
            counts = counts.withColumn("_one", F.lit(1)).join(F.broadcast(loose.withColumn("_one", F.lit(1))), "_one")
            extra = F.lit(0) if r.optional else F.col(f"nulls_{i}")
            counts = counts.withColumn(f"orphans_{i}", F.col(f"_loose_{i}") + extra).drop(f"_loose_{i}", "_one")
    entries = []
    for i, r in enumerate(spec.references):
        rows, nulls = F.col("child_rows"), F.col(f"nulls_{i}")
        entries.append(F.struct(
            F.lit(spec.name).alias("child_table"), F.lit(r.column).alias("child_column"),
            F.lit(r.parent).alias("parent_table"), F.lit(r.parent_column).alias("parent_column"),
            F.lit(r.optional).alias("nullable"), rows.alias("child_rows"), nulls.alias("null_rows"),
            (rows - nulls if r.optional else rows).alias("checked_rows"), F.col(f"orphans_{i}").alias("orphan_rows"),
            F.lit(r.known_broken).alias("note"),
        ))
    flat = counts.select(F.inline(F.array(*entries)))
    share = percent(F.col("orphan_rows"), F.col("checked_rows"))
    return flat.withColumn("orphan_pct", share).withColumn(
        "status", reference_status(F.col("note"), F.col("checked_rows"), F.col("orphan_pct"))
    ).select("child_table", "child_column", "parent_table", "parent_column", "nullable", "child_rows", "null_rows",
             "checked_rows", "orphan_rows", "orphan_pct", "status", "note")


def reference_status(note: Column, checked: Column, share: Column) -> Column:
    return (
        F.when(note != "", "known_broken")
        .when(checked == 0, "not_checkable")
        .when(share > ORPHAN_FAIL_PCT, "fail")
        .when(share > ORPHAN_WARN_PCT, "warn")
        .otherwise("ok")
    )


def orphan_gates(spec: TableSpec) -> list[Gate]:
    """At most ORPHAN_FAIL_PCT percent of the checked rows of a reference may be orphans; known broken references are not gated."""
    return [share_gate("orphans", f"{spec.name}.{r.column}", F.col(f"dq_invalid_orphan_{r.parent}"), ORPHAN_FAIL_PCT, F.col(r.column).isNotNull() if r.optional else F.lit(True))
            for r in spec.references if not r.known_broken]


def fill_word(df: DataFrame, column: str, word: str, value: Column) -> DataFrame:
    """Replaces the whole word `word` in a text with `value`; the text is null when there is none. Changed rows are
    marked in <column>_imputed."""
    pattern = rf"\b{word}\b"
    broken = F.col(column).rlike(pattern)
    replaced = F.regexp_replace(F.col(column), F.lit(pattern), value)
    return df.withColumns({f"{column}_imputed": broken & value.isNotNull(), column: F.when(broken, replaced).otherwise(F.col(column))})


def fill_from_parent(df: DataFrame, parent: DataFrame, on: dict[str, str], value: str, column: str, word: str) -> DataFrame:
    """fill_word with a value of the parent row."""
    return fill_word(attach(df, parent, on, {"_value": value}), column, word, F.col("_value")).drop("_value")
