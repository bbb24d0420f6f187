"""Structured Streaming forms of the session, metric, quality and ingest jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.config.model import Catalog, TableSpec
from tidemark.functions.cleaning import clean
from tidemark.operators.contracts import FLAG, compile_checks
from tidemark.operators.dedup import any_null
from tidemark.operators.flags import fold_validity
from tidemark.plans.conversations import IDLE_MINUTES, METRIC_BUFFERS, latency_counts, metric_columns


def read_stream(spark: SparkSession, folder: str, name: str, schema, files: int = 100) -> DataFrame:
    """A folder's Parquet files as a stream of arriving files, at most `files` in a trigger."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files).parquet(folder)


def with_event_time(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """Event time as a UTC timestamp, with a watermark."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def sessions(df: DataFrame, user: str, ts: str, idle_minutes: int = IDLE_MINUTES, delay: str = "10 minutes") -> DataFrame:
    """Session windows; one is emitted once the watermark has passed its end plus the idle time."""
    return with_event_time(df, ts, delay).groupBy(F.session_window(ts, f"{idle_minutes} minutes").alias("_s"), user).agg(
        F.count("*").alias("events"), F.max(ts).alias("session_end")
    ).select(user, F.col("_s.start").alias("session_start"), "session_end", "events")


def open_sessions(spark: SparkSession, checkpoint: str, user: str) -> DataFrame:
    """The sessions that `sessions` has not closed yet, as they stand."""
    rows = state_of(spark, checkpoint)
    return rows.select(f"key.{user}", F.col("value.session_window.start").alias("session_start"), F.col("value.max").alias("session_end"), F.col("value.count").alias("events"))


def turn_metrics(df: DataFrame, ts: str, window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    return with_event_time(df, ts, delay).groupBy(F.window(ts, window).alias("window")).agg(*metric_columns())


def open_metrics(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The windows that `turn_metrics` has not closed yet, as they stand."""
    return open_windows(spark, checkpoint, METRIC_BUFFERS)


def run_latency_counts(df: DataFrame, ts: str, target: str, checkpoint: str) -> DataFrame:
    """The latency counts of what has arrived. Every batch writes those of its own turns, which add up: no state, nothing is too late, and a batch
    that is repeated replaces its folder."""
    at = df.withColumn(ts, F.col(ts).cast("timestamp"))

    def store(batch: DataFrame, number: int) -> None:
        latency_counts(batch, ts).write.mode("overwrite").parquet(f"{target}/batch={number}")

    run_batches(at.select(ts, "latency_ms"), store, checkpoint)
    latency = df.schema["latency_ms"].dataType.simpleString()
    return df.sparkSession.read.schema(f"start timestamp, latency {latency}, turns bigint").parquet(target)


def late_marked(df: DataFrame, ts: str, arrived: str, late_after_days: int = 1) -> DataFrame:
    """Late rows are marked and kept: the mark compares arrival with event time, no watermark drops them."""
    lag = F.datediff(F.to_date(arrived), F.to_date(ts))
    return df.withColumn("arrival_lag_days", lag).withColumn("is_late", lag > late_after_days)


def late_counts(df: DataFrame, ts: str, arrived: str, window: str = "1 day", delay: str = "10 minutes") -> DataFrame:
    """Rows and late rows per arrival window, so that late rows are counted when they come."""
    marked = late_marked(df, ts, arrived).withColumn("_arrived", F.col(arrived).cast("timestamp")).withWatermark("_arrived", delay)
    return marked.groupBy(F.window("_arrived", window).alias("window")).agg(F.count("*").alias("rows"), F.count_if("is_late").alias("late_rows"))


LATE_BUFFERS = "rows bigint, late_rows bigint"


def open_late_counts(spark: SparkSession, checkpoint: str) -> DataFrame:
    return open_windows(spark, checkpoint, LATE_BUFFERS)


# ---- What the watermark has not closed when a stream stops ----

def state_of(spark: SparkSession, checkpoint: str, variable: str | None = None) -> DataFrame:
    """The state of a stream's one stateful operator after its last batch, or one variable of it."""
    reader = spark.read.format("statestore")
    return (reader.option("stateVarName", variable) if variable else reader).load(checkpoint)


def open_windows(spark: SparkSession, checkpoint: str, buffers: str) -> DataFrame:
    """`window` and the aggregates of the windows still in the state: `buffers` names them in their order, each with the type of its one
    buffer (an average has two, so sums and counts are kept instead)."""
    rows = state_of(spark, checkpoint)
    return rows.select("key.window", F.col("value").cast(f"struct<{buffers.replace(' ', ':').replace(',:', ', ')}>").alias("v")).select("window", "v.*")


def quota_alarms(df: DataFrame, ts: str, requests: str, per_minute: float, delay: str = "2 minutes") -> DataFrame:
    counted = with_event_time(df, ts, delay).groupBy(F.window(ts, "1 minute").alias("window")).agg(F.sum(requests).alias("requests"))
    return counted.where(F.col("requests") > per_minute).select(F.col("window.start").alias("minute"), "requests")


def first_arrivals(df: DataFrame, key: list[str], ts: str, delay: str) -> DataFrame:
    """Each key once within the watermark; its state is dropped when the watermark has passed."""
    return with_event_time(df, ts, delay).dropDuplicatesWithinWatermark(key)


# ---- Incremental ingest ----

def row_flags(df: DataFrame, spec: TableSpec, catalog: Catalog) -> DataFrame:
    """The contract flags that need no other row; uniqueness and references wait for the batch table."""
    flags: dict = {f"{FLAG}missing_key": any_null(spec.key)}
    for check in compile_checks(spec, catalog):
        if check.kind != "not_unique":
            fired = F.coalesce(check.broken, F.lit(False))
            name = FLAG + check.kind
            flags[name] = fired if name not in flags else flags[name] | fired
    return fold_validity(df.withColumns(flags))


def ingest(stream: DataFrame, spec: TableSpec, catalog: Catalog) -> DataFrame:
    """Delivered rows typed and flagged as their files arrive."""
    return row_flags(clean(stream, spec), spec, catalog)


def run_available(df: DataFrame, target: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Processes what has arrived into Parquet and stops: the same query then runs on the next delivery."""
    query = df.writeStream.outputMode(mode).format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    started = query.trigger(availableNow=True).start()
    started.awaitTermination()
    return started


def run_batches(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    started = df.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    started.awaitTermination()
    return started
