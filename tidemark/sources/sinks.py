"""Sinks: full rewrites, appended reports, replaced partitions, key-value upserts and read-back checks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.calendar import month_key
from tidemark.operators.ordering import latest_per_key, md5_bucket


def rewrite(df: DataFrame, path: str, month_of: str | None = None, register_as: str | None = None) -> None:
    """Replaces a whole table; with `month_of` it is partitioned by that column's month."""
    out = df.withColumn("year_month", month_key(F.col(month_of))) if month_of else df
    writer = out.write.format("parquet").mode("overwrite").option("partitionOverwriteMode", "static")
    if month_of:
        writer = writer.partitionBy("year_month")
    if register_as:
        writer.option("path", path).saveAsTable(register_as)
    else:
        writer.save(path)


def append_report(df: DataFrame, path: str) -> None:
    df.withColumn("run_at", F.current_timestamp()).write.mode("append").json(path)


def replace_partition(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Replaces only the partitions present in `df`, so a rerun for one date leaves the others alone."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def verify_written(df: DataFrame, expected_rows: int, never_null: Sequence[str] = (),
                   where: Column | None = None) -> None:
    """Re-reads what was written: row count, and columns that may not be null."""
    rows = df if where is None else df.where(where)
    found = rows.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in never_null]).first()
    if found["n"] != expected_rows:
        raise RuntimeError(f"wrote {expected_rows} rows but read {found['n']} back")
    empty = [c for c in never_null if found[c]]
    if empty:
        raise RuntimeError(f"null values in {empty} after writing")


def upsert_items(stored: DataFrame | None, puts: DataFrame, key: Sequence[str] = ("PK", "SK"),
                 newest: Column | None = None) -> DataFrame:
    """The item table after puts: an item of the same key is replaced, nothing is deleted. If a batch holds a
    key twice, the last one by `newest` wins (or the larger item, so that reruns agree)."""
    rest = [c for c in puts.columns if c not in key]
    order = [newest.desc_nulls_last()] if newest is not None else []
    order += [F.to_json(F.struct(*rest)).desc()] if rest else [F.col(key[0])]
    fresh = latest_per_key(puts, list(key), order)
    if stored is None:
        return fresh
    untouched = stored.join(fresh.select(*key), list(key), "left_anti")
    return untouched.unionByName(fresh, allowMissingColumns=True)


def read_back_differences(expected: DataFrame, found: DataFrame, key: Sequence[str] = ("PK", "SK")) -> DataFrame:
    """Items that should exist and are missing, or exist with other attributes."""
    attributes = [c for c in expected.columns if c not in key]
    left = expected.select(*key, F.struct(*attributes).alias("_want"))
    right = found.select(*[F.col(k).alias(f"_f_{k}") for k in key],
                         F.struct(*attributes).alias("_got"))
    match = F.lit(True)
    for k in key:
        match = match & F.col(k).eqNullSafe(F.col(f"_f_{k}"))
    joined = left.join(right, match, "left")
    problem = F.when(F.col("_got").isNull(), "missing").when(~F.col("_want").eqNullSafe(F.col("_got")), "different")
    return joined.withColumn("problem", problem).where("problem IS NOT NULL").select(*key, "problem")


def put_items(items: DataFrame, open_client: Callable[[], object], put_batch: Callable[[object, list[dict]], None],
              batch_size: int = 25) -> None:
    """Sends items to an external store from the executors, one client per partition. Puts are idempotent, so a
    retried task only repeats them."""

    def send(rows):
        client, batch = open_client(), []
        for row in rows:
            batch.append({k: v for k, v in row.asDict(recursive=True).items() if v is not None})
            if len(batch) == batch_size:
                put_batch(client, batch)
                batch = []
        if batch:
            put_batch(client, batch)

    items.foreachPartition(send)


def shard(df: DataFrame, id_column: str, shards: int, number: int | None = None) -> DataFrame:
    """Adds the row's shard, or keeps one shard. The same id lands in the same shard everywhere."""
    numbered = df.withColumn("shard", md5_bucket(F.col(id_column), shards))
    return numbered if number is None else numbered.where(F.col("shard") == number).drop("shard")


def dry_run(items: DataFrame, served: Column) -> DataFrame:
    """What a load would do: rows read, rows served, and one item to look at."""
    payload = F.to_json(F.struct(*[F.col(c) for c in items.columns]))
    return items.agg(
        F.count("*").alias("rows_read"), F.count_if(served).alias("rows_served"),
        F.min(F.when(served, payload)).alias("sample_item"),
    )
