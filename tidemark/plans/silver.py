"""Delivered files to typed, deduplicated and flagged tables, with their reports and gates."""

from __future__ import annotations

import itertools
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config.bank import BANK, CURRENCIES, FX_MAX_FILLED_DAYS
from tidemark.config.model import Catalog, TableSpec
from tidemark.functions.cleaning import clean
from tidemark.operators import contracts, references, reports
from tidemark.operators.arrivals import add_arrival_lag, arrival_report, session_start, volume_report
from tidemark.operators.dedup import duplicate_report, keep_latest, latest_order
from tidemark.operators.flags import fold_validity
from tidemark.operators.gates import as_report, enforce, write_through
from tidemark.operators.rates import gap_gates
from tidemark.plans.table_rules import apply_rules
from tidemark.sources.readers import read_bronze, read_table
from tidemark.sources.sinks import append_report, rewrite


def deduplicated(raw: DataFrame, spec: TableSpec, catalog: Catalog = BANK) -> DataFrame:
    """Typed rows, one per key. Compared after cleaning, so two spellings of nothing are not a conflict."""
    return newest_rows(clean(raw, spec), spec, catalog)


def newest_rows(typed: DataFrame, spec: TableSpec, catalog: Catalog = BANK) -> DataFrame:
    return keep_latest(typed, spec.key, latest_order(spec, typed.columns, catalog.end), spec.source_columns,
                       [F.col("_source_file").desc()])


# What a row needs from the row it points to: table -> parent -> new column -> parent column. The values come with
# the orphan check's join, so a parent is joined once.
CARRIED = {
    "transactions": {"products": {"_owner": "customer_id", "_opened": "opening_date"}},
    "call_transcripts": {"call_center_interactions": {"_caller": "customer_id", "_anchor": "interaction_date"}},
    "satisfaction_surveys": {"call_center_interactions": {"_caller": "customer_id", "_anchor": "interaction_date"}},
    "campaign_sends": {"marketing_campaigns": {"_promoted": "promoted_product"}},
}


def cross_table(df: DataFrame, table: str, transactions: DataFrame | None) -> DataFrame:
    """Rows that contradict the row they point to, and values filled from it. A missing parent leaves the flags
    null: the orphan flag already says so."""
    if table == "products" and transactions is not None:
        return references.last_child_mismatch(df, transactions, "product_id", "transaction_date",
                                              "last_transaction_date", "dq_invalid_last_txn_mismatch")
    if table == "transactions":
        return df.withColumns({
            "dq_invalid_product_owner_mismatch": F.col("customer_id") != F.col("_owner"),
            "dq_invalid_before_product_opening": F.to_date("transaction_date") < F.col("_opened")}).drop("_owner", "_opened")
    if table in ("call_transcripts", "satisfaction_surveys"):
        return df.withColumn("dq_invalid_interaction_customer_mismatch", F.col("customer_id") != F.col("_caller")).drop("_caller")
    if table == "campaign_sends":
        return references.fill_word(df, "subject", "nan", F.col("_promoted")).drop("_promoted")
    return df


def arrival_lag(df: DataFrame, spec: TableSpec, catalog: Catalog) -> DataFrame:
    """Lag from the business day of the row's anchor: its own event, its session's first, or its parent's."""
    if "process_date" not in spec.types or not (spec.event_time or spec.lag_anchor):
        return df
    starts_at = spec.day_start
    if spec.lag_anchor == "parent":  # the anchor came with the reference
        starts_at = catalog["call_center_interactions"].day_start
    elif spec.lag_anchor == "session":
        df = session_start(df, "session_id", spec.event_time, "_anchor")
    else:
        df = df.withColumn("_anchor", F.col(spec.event_time))
    return add_arrival_lag(df, "_anchor", starts_at).drop("_anchor")


def build_table(kept: DataFrame, spec: TableSpec, catalog: Catalog, read, transactions: DataFrame | None = None) -> DataFrame:
    """Deduplicated rows with every rule's flag, imputations, lag and validity."""
    df = apply_rules(kept, spec.name)
    df = contracts.add_contract_flags(df, spec, catalog)
    df = references.add_orphan_flags(df, spec, read, CARRIED.get(spec.name))
    df = cross_table(df, spec.name, transactions)
    df = arrival_lag(df, spec, catalog)
    return fold_validity(df).withColumn("_processed_at", F.current_timestamp())


def run_silver(spark: SparkSession, root: str, tables: Iterable[str] | None = None, catalog: Catalog = BANK,
               database: str = "") -> None:
    """Builds the tables parents first. Every report is written before a gate may fail the run.

    A delivery is parsed once, into typed Parquet; deduplication and the volume report then read only the columns
    they need from that. Products are checked against their transactions, which in turn point to products: only
    the deduplicated transactions matter for that, so they are stored once and read by both.
    """
    order = catalog.build_order(tables)
    read = lambda name: read_table(spark, root, "silver", name)

    def delivered(name: str) -> DataFrame:
        rewrite(clean(read_bronze(spark, root, catalog[name]), catalog[name]), f"{root}/staging/delivered/{name}/")
        return read_table(spark, root, "staging/delivered", name)

    typed: dict[str, DataFrame] = {}
    traded = None
    if "products" in order and "transactions" in catalog.tables:
        if "transactions" in order:
            typed["transactions"] = delivered("transactions")
            rewrite(newest_rows(typed["transactions"], catalog["transactions"], catalog), f"{root}/staging/newest/transactions/")
            traded = read_table(spark, root, "staging/newest", "transactions")
        else:
            traded = read("transactions")

    found: dict[str, list[DataFrame]] = {n: [] for n in ("duplicates", "rules", "foreign_keys", "contracts", "arrivals", "volumes")}
    verdicts: list[tuple] = []
    for name in order:
        spec = catalog[name]
        raw = typed.get(name)
        if raw is None:
            raw = delivered(name)
        kept = traded if name == "transactions" and traded is not None else newest_rows(raw, spec, catalog)
        built = build_table(kept, spec, catalog, read, traded if name == "products" else None)
        gates = references.orphan_gates(spec)
        if name == "daily_exchange_rates":
            built, more = gap_gates(built, list(itertools.permutations(CURRENCIES, 2)), catalog.start, catalog.end, FX_MAX_FILLED_DAYS)
            gates += more
        verdicts += write_through(built, gates, lambda df, spec=spec: rewrite(
            df, f"{root}/silver/{spec.name}/", spec.partition_by or None, f"{database}.{spec.name}" if database else None), drop=["_fill_run"])

        written = read(name)
        found["duplicates"].append(duplicate_report(written, name))
        found["rules"].append(reports.rule_report(contracts.full_counts(written, spec, catalog), name))
        if spec.references:
            found["foreign_keys"].append(references.reference_report(written, spec, read))
        found["contracts"].append(contracts.findings(written, spec, catalog))
        if "arrival_lag_days" in written.columns:
            found["arrivals"].append(arrival_report(written, name))
        found["volumes"].append(volume_report(raw, written, name, catalog.start, catalog.end, spec.expected_rows))

    # one file-backed frame per table: each report is a union of small aggregates, written without collecting
    for name, parts in found.items():
        for part in parts:
            append_report(part, f"{root}/silver/_{name}/")
    if verdicts:
        append_report(as_report(spark, verdicts), f"{root}/silver/_gates/")
    enforce(verdicts)
