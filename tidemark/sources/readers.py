"""Sources: strict-header CSV deliveries, Parquet tables, JSON reports and evaluation runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config.model import TableSpec
from tidemark.operators.flags import usable_rows
from tidemark.operators.reports import REPORT_SCHEMAS

FOLDER_COLUMNS = ("year", "month", "day")  # the event's own date says the same


def _csv_schema(spec: TableSpec) -> str:
    return ", ".join(f"`{c}` string" for c in spec.source_columns)


def _with_lineage(df: DataFrame) -> DataFrame:
    with_file = df.withColumn("_source_file", F.col("_metadata.file_path"))
    return with_file.drop(*[c for c in FOLDER_COLUMNS if c in df.columns])


def read_bronze(spark: SparkSession, root: str, spec: TableSpec) -> DataFrame:
    """A delivered table as text. Each file's header must be the declared columns by name and position; a file
    that differs fails the read and is named. Folder names (ingest_date=, year=...) become columns."""
    reader = spark.read.schema(_csv_schema(spec)).option("header", True).option("enforceSchema", False)
    return _with_lineage(reader.option("multiLine", True).option("escape", '"').csv(f"{root}/bronze/{spec.name}/"))


def stream_bronze(spark: SparkSession, root: str, spec: TableSpec, files_per_batch: int = 1000) -> DataFrame:
    """The same delivery as a stream of new files."""
    folders = "ingest_date date"
    reader = spark.readStream.schema(f"{_csv_schema(spec)}, {folders}").option("header", True)
    reader = reader.option("enforceSchema", False).option("multiLine", True).option("escape", '"')
    return _with_lineage(reader.option("maxFilesPerTrigger", files_per_batch).csv(f"{root}/bronze/{spec.name}/"))


def ingest(df: DataFrame, root: str, spec: TableSpec, ingest_date: str, daily_by: str | None = None) -> None:
    """Writes one delivery under ingest_date=, as one folder or as year=/month=/day= folders."""
    missing = [c for c in spec.source_columns if c not in df.columns]
    if missing:
        raise ValueError(f"{spec.name}: delivery lacks {missing}")
    target = f"{root}/bronze/{spec.name}/ingest_date={ingest_date}"
    out = df.select(*[F.col(c).cast("string") for c in spec.source_columns])
    writer_options = {"header": True, "escape": '"', "quoteAll": True}
    if daily_by is None:
        out.write.mode("overwrite").options(**writer_options).csv(target)
        return
    day = F.try_to_date(F.col(daily_by))
    folders = {"year": F.date_format(day, "yyyy"), "month": F.date_format(day, "MM"), "day": F.date_format(day, "dd")}
    out.withColumns(folders).write.mode("overwrite").partitionBy(*folders).options(**writer_options).csv(target)


def read_table(spark: SparkSession, root: str, zone: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{zone}/{name}/")


def read_columns(df: DataFrame, columns: Sequence[str], reasons: Sequence[str] = (),
                 where: Column | None = None) -> DataFrame:
    """Named columns of a table, without rows that break `reasons`; both reach the Parquet scan where Spark
    can push them."""
    kept = df if where is None else df.where(where)
    return usable_rows(kept, reasons).select(*columns)


def classify_columns(df: DataFrame, wanted: Sequence[str], known: Sequence[str] = ()) -> list[str]:
    """Source columns that are neither wanted nor known to be left out. A wanted column that is missing is an
    error."""
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    return sorted(set(df.columns) - set(wanted) - set(known))


def digital_daily(events: DataFrame, customer: str, ts: str, is_login: Column) -> DataFrame:
    """Events and logins per customer and day: all that features need of the largest table."""
    return (
        events.where(F.col(customer).isNotNull())
        .groupBy(F.col(customer).alias("customer_id"), F.to_date(ts).alias("day"))
        .agg(F.count("*").alias("events"), F.count_if(is_login).alias("logins"))
    )


def read_report(spark: SparkSession, root: str, zone: str, name: str) -> DataFrame:
    """An append-only JSON report; run_at stays ISO text, so the largest is the latest."""
    return spark.read.schema(REPORT_SCHEMAS[name]).json(f"{root}/{zone}/_{name}/")


RUN_SCHEMA = (
    "run struct<created_at: string, git_commit: string, live: boolean>, config string, suite string, case_id string, "
    "passed boolean, expected string, actual string, tags array<string>, detail struct<policies: array<string>, "
    "metrics: struct<requests: bigint, input_tokens: bigint, output_tokens: bigint, latency_ms: double, "
    "retries: bigint, fallback_used: boolean, cost_usd: double>>"
)


def read_run(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """An evaluation run: its header row (config kept as JSON text) and its case rows. Blank lines are not rows."""
    lines = spark.read.schema(RUN_SCHEMA).json(path)
    header = lines.where(F.col("run").isNotNull()).select("run", "config")
    cases = lines.where(F.col("run").isNull() & F.col("case_id").isNotNull()).drop("run", "config")
    return header, cases
