"""Quality reports as DataFrames, and the view that joins them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config.model import TableSpec
from tidemark.operators.flags import IMPUTED, flag_columns

# Report layouts.
REPORT_SCHEMAS = {
    "duplicates": "table string, rows_in long, rows_out long, rows_removed long, duplicate_keys long, "
                  "exact_duplicates long, conflicting_keys long, conflicting_duplicates long, run_at string",
    "rules": "table string, rule string, failing_rows long, rows long, failing_pct double, run_at string",
    "foreign_keys": "child_table string, child_column string, parent_table string, parent_column string, "
                    "nullable boolean, child_rows long, null_rows long, checked_rows long, orphan_rows long, "
                    "orphan_pct double, status string, note string, run_at string",
    "contracts": "table string, category string, error_type string, column string, check string, error string, "
                 "run_at string",
    "arrivals": "table string, rows long, rows_with_lag long, late_rows long, late_pct double, "
                "processed_before_event long, lag_p50 long, lag_p90 long, lag_p99 long, lag_max int, same_day long, "
                "one_day long, two_to_seven_days long, eight_to_thirty_days long, over_thirty_days long, "
                "status string, run_at string",
    "volumes": "table string, raw_rows long, silver_rows long, expected_rows long, vs_expected_pct double, "
               "file_days long, missing_days long, missing_day_list array<string>, unusual_days array<string>, "
               "rows_filed_on_other_day long, status string, run_at string",
    "gates": "gate string, subject string, measured double, allowed double, checked_rows long, status string, run_at string",
    "exclusions": "table string, rows_in long, rows_excluded long, excluded_by_reason map<string,long>, "
                  "run_at string",
}
CONTRACT_KINDS = ("required_missing", "not_allowed", "out_of_range", "outside_dataset", "date_order", "not_unique")


def rounded(value: Column, digits: int) -> Column:
    """A double to some decimals as SQL engines round it, by the double's own value. `round` with decimals goes by its shortest text, so a half
    that the double lies just below (8.0025) would go up."""
    scale = F.lit(10.0 ** digits)
    return F.round(value * scale) / scale


def percent(part: Column, whole: Column) -> Column:
    """100 x part / whole to three decimals; 0 for an empty whole."""
    return F.coalesce(rounded(F.try_divide(part * F.lit(100.0), whole), 3), F.lit(0.0))


def table_counts(df: DataFrame, spec: TableSpec, checks: Sequence = ()) -> DataFrame:
    """One row with everything the rule report needs: rows, invalid rows, a count per flag, per imputation, per
    filled source column and per contract check. One pass."""
    imputed = [c for c in df.columns if c.endswith(IMPUTED)]
    present = [c for c in spec.source_columns if c in df.columns]
    return df.agg(
        F.count("*").alias("rows"),
        F.count_if(~F.col("dq_is_valid")).alias("invalid"),
        *[F.count_if(F.col(c)).alias(f"flag:{c.removeprefix('dq_invalid_')}") for c in flag_columns(df)],
        *[F.count_if(F.col(c)).alias(f"imputed:{c.removesuffix(IMPUTED)}") for c in imputed],
        *[F.count(F.col(c)).alias(f"filled:{c}") for c in present],
        *[F.count_if(k.broken).alias(f"check:{k.kind}:{k.column}") for k in checks],
    )


def rule_report(counts: DataFrame, table: str) -> DataFrame:
    """A row per flag, per imputed column, per contract check, and per source column that is empty in every
    row (all_null:<column>)."""
    rows = []
    for name in counts.columns:
        value = F.col(f"`{name}`")
        kind, _, rest = name.partition(":")
        if kind in ("flag", "check", "imputed"):
            rule = name if kind == "imputed" else rest
            rows.append(F.struct(F.lit(rule).alias("rule"), value.alias("failing_rows"), F.lit(True).alias("shown")))
        elif kind == "filled":
            empty = (value == 0) & (F.col("rows") > 0)
            rows.append(F.struct(F.lit(f"all_null:{rest}").alias("rule"), F.col("rows").alias("failing_rows"),
                                 empty.alias("shown")))
    out = counts.select("rows", F.inline(F.array(*rows))).where("shown").drop("shown")
    return out.select(F.lit(table).alias("table"), "rule", "failing_rows", "rows",
                      percent(F.col("failing_rows"), F.col("rows")).alias("failing_pct"))


def null_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of nulls per column, in percent."""
    counted = df.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    pairs = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in columns]
    return counted.select("rows", F.inline(F.array(*pairs))).select(
        "column_name", F.coalesce(rounded(F.try_divide(F.col("nulls") * 100.0, F.col("rows")), 2), F.lit(0.0)).alias("pct_null")
    )


# ---- The summary view ----

def _line(layer, report, table, check_type, name, failing, total, pct, status, detail) -> list[Column]:
    return [
        F.lit(layer).alias("layer"), F.lit(report).alias("report"), table.alias("table_name"),
        check_type.alias("check_type"), name.alias("check_name"), failing.cast("bigint").alias("failing_rows"),
        total.cast("bigint").alias("total_rows"), pct.cast("double").alias("failing_pct"), status.alias("status"),
        detail.cast("string").alias("detail"), F.col("run_at"),
    ]


def _first_ten(days: str) -> Column:
    listed = F.concat(F.lit(" ("), F.array_join(F.slice(F.col(days), 1, 10), ", "), F.lit(")"))
    return F.when(F.size(days) > 0, listed).otherwise("")


def _share(part: str, whole: str) -> Column:
    return F.try_divide(F.col(part) * 100.0, F.col(whole))


def summary_view(reports: dict[str, DataFrame]) -> DataFrame:
    """All reports in one shape, each (report, table) at its latest run. A contract kind's own flag is left
    out of the rules: its per-column rows say the same in more detail."""
    none = F.lit(None)
    table = F.col("table")
    parts = []
    if "rules" in reports:
        rule = F.col("rule")
        kind = (F.when(rule.startswith("imputed:"), "imputation").when(rule.startswith("all_null:"), "empty_column")
                .when(rule.contains(":"), "contract").otherwise("flag"))
        status = (F.when(F.col("failing_rows") == 0, "ok").when(rule.startswith("imputed:"), "imputed")
                  .otherwise("flagged"))
        parts.append(reports["rules"].where(~rule.isin(*CONTRACT_KINDS)).select(*_line(
            "silver", "rules", table, kind, rule, F.col("failing_rows"), F.col("rows"), F.col("failing_pct"), status, none)))
    if "foreign_keys" in reports:
        name = F.concat(F.col("child_column"), F.lit(" -> "), F.col("parent_table"))
        parts.append(reports["foreign_keys"].select(*_line(
            "silver", "foreign_keys", F.col("child_table"), F.lit("foreign_key"), name, F.col("orphan_rows"),
            F.col("checked_rows"), F.col("orphan_pct"), F.col("status"), F.col("note"))))
    if "duplicates" in reports:
        for column in ("exact_duplicates", "conflicting_duplicates"):
            detail = none if column == "exact_duplicates" else F.format_string(
                "%d keys had more than one version", F.col("conflicting_keys"))
            status = F.when(F.col(column) > 0, "removed").otherwise("ok")
            parts.append(reports["duplicates"].select(*_line(
                "silver", "duplicates", table, F.lit("duplicates"), F.lit(column), F.col(column), F.col("rows_in"),
                _share(column, "rows_in"), status, detail)))
    if "contracts" in reports:
        name = F.concat(F.col("column"), F.lit(": "), F.col("check"))
        parts.append(reports["contracts"].select(*_line(
            "silver", "contracts", table, F.lit("contract_finding"), name, none, none, none, F.lit("fail"), F.col("error"))))
    if "arrivals" in reports:
        lag = F.format_string("lag p50 %d, p90 %d, p99 %d, max %d days", *[F.col(f"lag_{p}") for p in ("p50", "p90", "p99", "max")])
        parts.append(reports["arrivals"].select(*_line(
            "silver", "arrivals", table, F.lit("late_arrival"), F.lit("late_rows"), F.col("late_rows"),
            F.col("rows_with_lag"), F.col("late_pct"), F.when(F.col("late_rows") > 0, "warn").otherwise("ok"), lag)))
    if "volumes" in reports:
        detail = F.format_string(
            "%s raw rows vs %s in the dictionary (%s%%); %s days without a file%s; %s unusual days%s; "
            "%s rows filed under another day",
            F.col("raw_rows"), F.col("expected_rows"), F.col("vs_expected_pct"), F.col("missing_days"),
            _first_ten("missing_day_list"), F.size("unusual_days"), _first_ten("unusual_days"),
            F.coalesce("rows_filed_on_other_day", F.lit(0)))
        parts.append(reports["volumes"].select(*_line(
            "silver", "volumes", table, F.lit("volume"), F.lit("volume"), none, F.col("raw_rows"), none, F.col("status"), detail)))
    if "exclusions" in reports:
        status = F.when(F.col("rows_excluded") > 0, "excluded").otherwise("ok")
        parts.append(reports["exclusions"].select(*_line(
            "gold", "exclusions", table, F.lit("exclusion"), F.lit("rows_excluded"), F.col("rows_excluded"),
            F.col("rows_in"), _share("rows_excluded", "rows_in"), status, F.to_json("excluded_by_reason"))))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    newest = F.max("run_at").over(Window.partitionBy("report", "table_name"))
    return (
        every.withColumn("_newest", newest).where(F.col("run_at") == F.col("_newest")).drop("_newest")
        .withColumn("failing_pct", F.round("failing_pct", 3))
        .withColumn("run_at", F.col("run_at").try_cast("timestamp"))
    )


def problems_first(summary: DataFrame) -> DataFrame:
    """Everything that is not ok, the largest share first and shares that do not exist last."""
    return summary.where(F.col("status") != "ok").orderBy(F.col("failing_pct").desc_nulls_last(), "table_name", "check_name")
