"""Late arrivals and delivered volumes: warnings, never failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import business_day, clock_seconds, seconds_of_day
from tidemark.operators.lookups import attach
from tidemark.operators.reports import percent, rounded

# Fixed values.
LATE_AFTER_DAYS = 1
VOLUME_TOLERANCE_PCT = 20.0
DAY_LOW, DAY_HIGH = 0.5, 2.0  # times the median of the same weekday
FILE_DAY = r"year=(\d{4})/month=(\d{2})/day=(\d{2})"  # the day a file was delivered for


def session_start(df: DataFrame, session: str, ts: str, name: str) -> DataFrame:
    """Adds the first time of each row's session. Aggregate and join back: no session is held by one task."""
    first = df.where(F.col(session).isNotNull()).groupBy(session).agg(F.min(ts).alias("_first"))
    return attach(df, first, {session: session}, {name: "_first"})


def add_arrival_lag(df: DataFrame, anchor: str, starts_at: str, processed: str = "process_date", either_day: bool = True) -> DataFrame:
    """business_date of the anchor, days from it to `processed`, whether that is late, and the flag for a row
    processed before its day. With `either_day` an event in the second of the day's start may belong to the day before too; without it
    the day begins there for every event."""
    at, done = F.col(anchor), F.col(processed)
    day = business_day(at, starts_at)
    on_the_dot = F.lit(either_day) & (seconds_of_day(at) == clock_seconds(starts_at)) & (done == F.date_sub(day, 1))
    lag = F.datediff(done, F.col("business_date"))
    return (
        df.withColumn("business_date", F.when(on_the_dot, F.date_sub(day, 1)).otherwise(day))
        .withColumn("arrival_lag_days", lag)
        .withColumn("is_late_arrival", F.col("arrival_lag_days") > LATE_AFTER_DAYS)
        .withColumn("dq_invalid_processed_before_event", F.col("arrival_lag_days") < 0)
    )


def arrival_report(df: DataFrame, table: str) -> DataFrame:
    """The lag distribution in one pass. There are few different lags, so their counts give exact quantiles."""
    lag = F.col("arrival_lag_days")
    stats = df.agg(
        F.count("*").alias("rows"), F.count(lag).alias("rows_with_lag"),
        F.count_if(F.col("is_late_arrival")).alias("late_rows"),
        F.count_if(lag < 0).alias("processed_before_event"),
        *[F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY arrival_lag_days)").cast("bigint").alias(f"lag_p{p}") for p in (50, 90, 99)], F.max(lag).alias("lag_max"),
        F.count_if(lag == 0).alias("same_day"), F.count_if(lag == 1).alias("one_day"),
        F.count_if(lag.between(2, 7)).alias("two_to_seven_days"),
        F.count_if(lag.between(8, 30)).alias("eight_to_thirty_days"), F.count_if(lag > 30).alias("over_thirty_days"),
    )
    warn = (F.col("late_rows") > 0) | (F.col("processed_before_event") > 0)
    return stats.select(
        F.lit(table).alias("table"), "rows", "rows_with_lag", "late_rows",
        percent(F.col("late_rows"), F.col("rows_with_lag")).alias("late_pct"), "processed_before_event",
        "lag_p50", "lag_p90", "lag_p99", "lag_max",
        "same_day", "one_day", "two_to_seven_days", "eight_to_thirty_days", "over_thirty_days",
        F.when(warn, "warn").otherwise("ok").alias("status"),
    )


def file_day(path: Column) -> Column:
    parts = [F.regexp_extract(path, FILE_DAY, i) for i in (1, 2, 3)]
    return F.try_to_date(F.concat_ws("-", *parts))


def unusual_days(per_day: DataFrame, day: str = "day", n: str = "n") -> DataFrame:
    """Days far from the median of their weekday. One row per day goes in, so a weekday's group is bounded by
    the calendar."""
    usual = F.median(n).over(Window.partitionBy(F.weekday(day)))
    return (
        per_day.withColumn("usual", usual)
        .where((F.col(n) < DAY_LOW * F.col("usual")) | (F.col(n) > DAY_HIGH * F.col("usual")))
    )


def missing_days(per_day: DataFrame, start: str, end: str, day: str = "day") -> DataFrame:
    """Calendar days of the dataset that have no row."""
    spark = per_day.sparkSession
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    calendar = spark.range(1).select(F.explode(F.sequence(first, last)).alias(day))
    return calendar.join(per_day, day, "left_anti")


def volume_report(raw: DataFrame, silver_rows: DataFrame, table: str, start: str, end: str,
                  expected: int | None, processed: str | None = "process_date") -> DataFrame:
    """Raw rows against the dictionary; for daily tables also missing days, unusual days and rows in a file
    for another day. Day lists are bounded by the calendar."""
    day = file_day(F.col("_source_file"))
    elsewhere = F.lit(False)
    if processed and processed in raw.columns:
        elsewhere = F.try_to_date(F.trim(F.col(processed).cast("string"))) != day
    per_day = raw.select(day.alias("day"), elsewhere.alias("_elsewhere")).groupBy("day").agg(
        F.count("*").alias("n"), F.count_if(F.col("_elsewhere")).alias("elsewhere"))
    dated = per_day.where(F.col("day").isNotNull())
    one = F.lit(1).alias("_one")
    totals = per_day.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("raw_rows"), F.count("day").alias("_days"),
                         F.sum(F.when(F.col("day").isNotNull(), F.col("elsewhere"))).alias("_elsewhere")).select("*", one)
    gaps = missing_days(dated, start, end).agg(F.array_sort(F.collect_list(F.col("day").cast("string"))).alias("_gaps")).select("*", one)
    label = F.concat_ws(":", F.col("day").cast("string"), F.col("n").cast("string"))
    odd = unusual_days(dated).agg(F.array_sort(F.collect_list(label)).alias("_odd")).select("*", one)
    counted = silver_rows.agg(F.count("*").alias("silver_rows")).select("*", one)
    # four one-row aggregates side by side
    joined = totals
    for side in (gaps, odd, counted):
        joined = joined.join(F.broadcast(side), "_one")
    daily = F.col("_days") > 0
    empty = F.array().cast("array<string>")
    off = rounded(F.lit(100.0) * (F.col("raw_rows") / F.lit(expected) - 1), 3) if expected else F.lit(None).cast("double")
    out = joined.select(
        F.lit(table).alias("table"), "raw_rows", "silver_rows", F.lit(expected).cast("bigint").alias("expected_rows"),
        off.alias("vs_expected_pct"), F.when(daily, F.col("_days")).alias("file_days"),
        F.when(daily, F.col("_gaps")).otherwise(empty).alias("missing_day_list"),
        F.when(daily, F.col("_odd")).otherwise(empty).alias("unusual_days"),
        F.when(daily, F.col("_elsewhere")).alias("rows_filed_on_other_day"),
    ).withColumn("missing_days", F.size("missing_day_list").cast("bigint"))
    warn = (
        (F.abs(F.coalesce("vs_expected_pct", F.lit(0.0))) > VOLUME_TOLERANCE_PCT) | (F.col("missing_days") > 0)
        | (F.size("unusual_days") > 0) | (F.coalesce("rows_filed_on_other_day", F.lit(0)) > 0)
    )
    return out.withColumn("status", F.when(warn, "warn").otherwise("ok")).select(
        "table", "raw_rows", "silver_rows", "expected_rows", "vs_expected_pct", "file_days", "missing_days",
        "missing_day_list", "unusual_days", "rows_filed_on_other_day", "status")
