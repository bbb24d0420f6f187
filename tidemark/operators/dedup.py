"""Deterministic keep-latest and duplicate statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordering import latest_per_key

COPIES, VERSIONS, MISSING_KEY = "dq_copies", "dq_versions", "dq_invalid_missing_key"


def content_hash(columns: Sequence[str]) -> Column:
    """Hash of a row's content. xxhash64 skips nulls, so (null, 'a') and ('a', null) would collide: which
    columns are null is hashed as well."""
    return F.xxhash64(*[F.col(c) for c in columns], *[F.col(c).isNull() for c in columns])


def any_null(columns: Sequence[str]) -> Column:
    found = F.lit(False)
    for c in columns:
        found = found | F.col(c).isNull()
    return found


def keep_latest(df: DataFrame, key: Sequence[str], order: Sequence[Column], content: Sequence[str],
                then: Sequence[Column] = ()) -> DataFrame:
    """One row per key: the first in `order`, then the larger content hash, then `then`. Adds how many rows
    and how many distinct contents the key had. Rows without a key stay, one each.

    The winner comes from a ranked group limit, which Spark also applies before the shuffle; the counts come
    from a two-step aggregate over (key, hash) only. Neither sends a hot key's rows to one task, and both
    results are partitioned by the key, so joining them moves nothing.
    """
    key = list(key)
    hashed = df.withColumn("_content", content_hash(content))
    keyed = hashed.where(~any_null(key))
    winners = latest_per_key(keyed, key, [*order, F.col("_content").desc(), *then])
    counts = (
        keyed.groupBy(*key, "_content").agg(F.count("*").alias("_n"))
        .groupBy(*key).agg(F.sum("_n").cast("int").alias(COPIES), F.count("*").cast("int").alias(VERSIONS))
    )
    kept = winners.join(counts, key).withColumn(MISSING_KEY, F.lit(False))
    keyless = hashed.where(any_null(key)).withColumns(
        {COPIES: F.lit(1), VERSIONS: F.lit(1), MISSING_KEY: F.lit(True)}
    )
    return kept.unionByName(keyless).select(*df.columns, COPIES, VERSIONS, MISSING_KEY)


def latest_order(spec, columns: Sequence[str], dataset_end: str) -> list[Column]:
    """Newest delivery, then newest update (an update after the data ends cannot win), then newest
    process_date."""
    order = [F.col("ingest_date").desc()]
    if spec.updated_by:
        updated = F.col(spec.updated_by)
        order.append(F.when(F.to_date(updated) <= F.lit(dataset_end).cast("date"), updated).desc_nulls_last())
    if "process_date" in columns:
        order.append(F.col("process_date").desc_nulls_last())
    return order


def duplicate_report(kept: DataFrame, table: str) -> DataFrame:
    """Rows in and out, and what was removed as an exact copy or as another version of a key."""
    stats = kept.agg(
        F.count("*").alias("rows_out"),
        F.count_if(F.col(COPIES) > 1).alias("duplicate_keys"),
        F.coalesce(F.sum(F.col(COPIES) - F.col(VERSIONS)), F.lit(0)).alias("exact_duplicates"),
        F.count_if(F.col(VERSIONS) > 1).alias("conflicting_keys"),
        F.coalesce(F.sum(F.col(VERSIONS) - 1), F.lit(0)).alias("conflicting_duplicates"),
        F.coalesce(F.sum(COPIES), F.lit(0)).alias("rows_in"),
    )
    return stats.select(
        F.lit(table).alias("table"), "rows_in", "rows_out", (F.col("rows_in") - F.col("rows_out")).alias("rows_removed"),
        "duplicate_keys", "exact_duplicates", "conflicting_keys", "conflicting_duplicates",
    )
