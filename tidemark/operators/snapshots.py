"""Point-in-time windows. A snapshot T is an exclusive midnight cutoff: history is before T, labels from T on.

A range join of events with snapshots would plan as a nested loop. Here every row carries the short list of
snapshots whose window holds it and is exploded over that list: linear in the rows, no join.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SNAPSHOT, AGE = "snapshot_date", "age_days"


def _dates(cutoffs: Sequence[date]) -> Column:
    return F.array(*[F.lit(c) for c in cutoffs])


def history(df: DataFrame, day: str, cutoffs: Sequence[date], lookback_days: int | None = None) -> DataFrame:
    """Each row once per snapshot after its day (and at most `lookback_days` after it). Adds the days between."""
    inside = lambda t: (F.col(day) < t) & (
        F.lit(True) if lookback_days is None else F.datediff(t, F.col(day)) <= lookback_days)
    exploded = df.select("*", F.explode(F.filter(_dates(cutoffs), inside)).alias(SNAPSHOT))
    return exploded.withColumn(AGE, F.datediff(F.col(SNAPSHOT), F.col(day)))


def future(df: DataFrame, day: str, cutoffs: Sequence[date], horizon_days: int) -> DataFrame:
    """Each row once per snapshot T with day in [T, T + horizon)."""
    inside = lambda t: (F.col(day) >= t) & (F.datediff(F.col(day), t) < horizon_days)
    return df.select("*", F.explode(F.filter(_dates(cutoffs), inside)).alias(SNAPSHOT))


def around(df: DataFrame, day: str, cutoffs: Sequence[date], lookback_days: int, horizon_days: int) -> DataFrame:
    """Each row once per snapshot T with day in [T - lookback, T + horizon)."""
    inside = lambda t: (F.datediff(t, F.col(day)) <= lookback_days) & (F.datediff(F.col(day), t) < horizon_days)
    return df.select("*", F.explode(F.filter(_dates(cutoffs), inside)).alias(SNAPSHOT))


def sum_if(condition: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0))


def within(days: int) -> Column:
    return F.col(AGE) <= days


def between_ages(after: int, until: int) -> Column:
    """Older than `after` days and at most `until` days old."""
    return (F.col(AGE) > after) & (F.col(AGE) <= until)
