"""Table contracts compiled to column predicates: row flags, per-check counts and findings."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config.model import Catalog, TableSpec
from tidemark.functions.calendar import business_day
from tidemark.operators.lookups import attach
from tidemark.operators.reports import table_counts

# The kinds of contract check, also used as flag and report names.
KINDS = ("required_missing", "not_allowed", "out_of_range", "outside_dataset", "date_order", "not_unique")
FLAG = "dq_invalid_"


@dataclass(frozen=True)
class Check:
    """`broken` is true on a row that fails, and null or false otherwise."""

    kind: str
    column: str
    broken: Column
    wording: str


def repeats_column(column: str) -> str:
    return f"_repeats_{column}"


def mark_repeats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds, for each unique column, whether the row's value occurs more than once. Counting and joining back
    the repeated values keeps a hot value (or the nulls) out of a single window task."""
    for c in columns:
        repeated = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("_n")).where("_n > 1")
        repeated = repeated.select(F.col(c), F.lit(True).alias("_hit"))
        df = attach(df, repeated, {c: c}, {repeats_column(c): "_hit"})
        df = df.withColumn(repeats_column(c), F.coalesce(repeats_column(c), F.lit(False)))
    return df


def compile_checks(spec: TableSpec, catalog: Catalog) -> list[Check]:
    """The table's checks. Keys and references get no required_missing: missing_key and the orphan flags
    cover them. A null fails nothing except required_missing."""
    covered = set(spec.key) | {r.column for r in spec.references}
    checks = []
    for c in spec.kept_columns:
        value = F.col(c)
        if c in spec.required and c not in covered:
            checks.append(Check("required_missing", c, value.isNull(), "not null"))
        if c in spec.allowed:
            options = spec.allowed[c]
            checks.append(Check("not_allowed", c, ~value.isin(*options), "one of " + ", ".join(map(str, options))))
        if c in spec.ranges:
            low, high = spec.ranges[c]
            if high is None:
                checks.append(Check("out_of_range", c, value < low, f">= {low}"))
            else:
                checks.append(Check("out_of_range", c, ~value.between(low, high), f"{low} to {high}"))
        if c == spec.event_time:
            first, last = F.lit(catalog.start).cast("date"), F.lit(catalog.end).cast("date")
            inside = business_day(value, spec.day_start).between(first, last)
            words = f"between {catalog.start} and {catalog.end}"
            if spec.day_start != "00:00:00":
                words += f", business day from {spec.day_start}"
            checks.append(Check("outside_dataset", c, ~inside, words))
    for earlier, later in spec.in_order:
        checks.append(Check("date_order", later, F.col(earlier) > F.col(later), f"{earlier} <= {later}"))
    for c in spec.unique:
        checks.append(Check("not_unique", c, F.col(repeats_column(c)), f"unique({c})"))
    for name in (*spec.allowed, *spec.ranges, *([spec.event_time] if spec.event_time else []), *spec.unique):
        if name not in spec.types:
            raise ValueError(f"{spec.name}: contract names unknown column {name}")
    return checks


def add_contract_flags(df: DataFrame, spec: TableSpec, catalog: Catalog) -> DataFrame:
    """dq_invalid_<kind>: true when any column fails a check of that kind."""
    marked = mark_repeats(df, spec.unique)
    flags: dict[str, Column] = {}
    for check in compile_checks(spec, catalog):
        name = FLAG + check.kind
        # a null (the rule could not be evaluated) counts as not fired
        fired = F.coalesce(check.broken, F.lit(False))
        flags[name] = fired if name not in flags else flags[name] | fired
    return marked.withColumns(flags).drop(*[repeats_column(c) for c in spec.unique]) if flags else df


def full_counts(df: DataFrame, spec: TableSpec, catalog: Catalog) -> DataFrame:
    """Flags, imputations, filled columns and contract checks of a built table, counted in one pass."""
    return table_counts(mark_repeats(df, spec.unique), spec, compile_checks(spec, catalog))


def failing_counts(df: DataFrame, spec: TableSpec, catalog: Catalog) -> DataFrame:
    """One row: failing rows per `<kind>:<column>`, in a single pass."""
    checks = compile_checks(spec, catalog)
    marked = mark_repeats(df, spec.unique)
    return marked.agg(F.count("*").alias("rows"), *[F.count_if(c.broken).alias(f"{c.kind}:{c.column}") for c in checks])


def melt(one_row: DataFrame, columns: Sequence[str], name: str, value: str, keep: Sequence[str] = ()) -> DataFrame:
    """The given columns of a (one-row) frame as rows, without collecting it."""
    if not columns:
        return one_row.select(*keep, F.lit("").alias(name), F.lit(0).cast("bigint").alias(value)).limit(0)
    pairs = F.array(*[F.struct(F.lit(c).alias(name), F.col(f"`{c}`").cast("bigint").alias(value)) for c in columns])
    return one_row.select(*keep, F.inline(pairs))


def findings(df: DataFrame, spec: TableSpec, catalog: Catalog) -> DataFrame:
    """One row per failed check of a written table: missing columns and wrong types (SCHEMA), then failed
    checks and repeated keys (DATA)."""
    spark = df.sparkSession
    actual = dict(df.dtypes)
    schema_rows = []
    for c in spec.kept_columns:
        if c not in actual:
            schema_rows.append((spec.name, "SCHEMA", "COLUMN_NOT_IN_DATAFRAME", c, "column_in_dataframe",
                                f"column '{c}' not in dataframe"))
        elif actual[c] != spec.sql_type(c):
            schema_rows.append((spec.name, "SCHEMA", "WRONG_DATATYPE", c, f"dtype('{spec.sql_type(c)}')",
                                f"expected column '{c}' to have type {spec.sql_type(c)}, got {actual[c]}"))
    layout = "table string, category string, error_type string, column string, check string, error string"
    schema_findings = spark.createDataFrame(schema_rows, layout)

    present = [k for k in compile_checks(spec, catalog) if k.column in actual]
    marked = mark_repeats(df, spec.unique)
    labels = {f"{k.kind}:{k.column}": k for k in present}
    counted = marked.agg(*[F.count_if(k.broken).alias(n) for n, k in labels.items()])
    words = {n: k.wording for n, k in labels.items()}
    failed = melt(counted, list(labels), "_label", "_n").where("_n > 0")
    meaning = spark.createDataFrame(
        [(n, k.column, k.kind, words[n], "SERIES_CONTAINS_NULLS" if k.kind == "required_missing" else
          "DATAFRAME_CHECK" if k.kind != "not_unique" else "DUPLICATES") for n, k in labels.items()],
        "_label string, column string, check string, error string, error_type string",
    ) if labels else None
    repeated_key = (
        df.groupBy(*spec.key).agg(F.count("*").alias("_n")).where(F.col("_n") > 1).agg(F.count("*").alias("_n"))
        .where("_n > 0")
        .select(F.lit(spec.name).alias("table"), F.lit("DATA").alias("category"), F.lit("DUPLICATES").alias("error_type"),
                F.lit(",".join(spec.key)).alias("column"), F.lit("unique_key").alias("check"),
                F.lit(f"key ({', '.join(spec.key)}) is repeated").alias("error"))
    )
    out = schema_findings.unionByName(repeated_key)
    if meaning is not None:
        data = failed.join(F.broadcast(meaning), "_label").select(  # one row per check of the contract
            F.lit(spec.name).alias("table"), F.lit("DATA").alias("category"), "error_type", "column", "check", "error"
        )
        out = out.unionByName(data)
    return out


def render_markdown(catalog: Catalog) -> str:
    """The contracts as documentation, one table per section."""
    lines = ["# Data contracts", "", "Rendered from the table configuration. Rows that break a contract are kept and flagged."]
    for spec in catalog.tables.values():
        lines += ["", f"## {spec.name}", "", f"Primary key: `{', '.join(spec.key)}`."]
        whole = [f"{a} <= {b}" for a, b in spec.in_order] + [f"unique({c})" for c in spec.unique]
        if whole:
            lines.append("Table checks: " + "; ".join(f"`{w}`" for w in whole) + ".")
        lines += ["", "| Column | Type | Required | Rule |", "|---|---|---|---|"]
        by_column: dict[str, list[str]] = {}
        for k in compile_checks(spec, catalog):
            if k.kind in ("not_allowed", "out_of_range", "outside_dataset"):
                by_column.setdefault(k.column, []).append(k.wording)
        for c in spec.kept_columns:
            rule = "; ".join(by_column.get(c, []))
            lines.append(f"| `{c}` | {spec.sql_type(c)} | {'yes' if c in spec.required else ''} | {rule} |")
    return "\n".join(lines) + "\n"
