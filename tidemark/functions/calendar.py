"""Dates, business days, schedules and windows."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds_of_day(ts: Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def clock_seconds(clock: str) -> int:
    hours, minutes, seconds = (int(part) for part in clock.split(":"))
    return hours * 3600 + minutes * 60 + seconds


def business_day(ts: Column, starts_at: str) -> Column:
    """The business day of a time: before `starts_at` it is still the previous day."""
    day = F.to_date(ts)
    opening = clock_seconds(starts_at)
    if opening == 0:
        return day
    return F.when(seconds_of_day(ts) < opening, F.date_sub(day, 1)).otherwise(day)


def whole_years(start: Column, end: Column) -> Column:
    """Age: days over 365.25, rounded down."""
    return F.floor(F.datediff(end, start) / 365.25)


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def expiry_text(day: Column) -> Column:
    return F.date_format(day, "MM/yyyy")


def utc_text(ts: Column, micros: bool = False) -> Column:
    """Fixed-width UTC text: 2026-06-17T10:03:04Z, or with six decimals. Sorts like time."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'" if micros else "yyyy-MM-dd'T'HH:mm:ss'Z'")


def days_between(first: Column, last: Column) -> Column:
    """One row per day of a period, to be used in a select."""
    return F.explode(F.sequence(first, last))


# ---- Snapshot schedules: a few dozen dates, planned on the driver ----

def _month_start(day: date, months: int = 0) -> date:
    index = day.year * 12 + day.month - 1 + months
    return date(index // 12, index % 12 + 1, 1)


def snapshot_schedule(first_event: date, last_event: date, horizon_days: int, history_days: int,
                      every_months: int = 1) -> list[date]:
    """Month starts with `history_days` of data before them and a full label window after them. With
    `every_months` 3 the dates fall on quarter starts, with 2 on every second month from January."""
    earliest = first_event + timedelta(days=history_days)
    step = _month_start(earliest) if earliest.day == 1 else _month_start(earliest, 1)
    while (step.month - 1) % every_months:
        step = _month_start(step, 1)
    dates = []
    while step + timedelta(days=horizon_days) <= last_event:
        dates.append(step)
        step = _month_start(step, every_months)
    return dates


def chronological_split(snapshots: list[date], train_until: date, validate_until: date,
                        horizon_days: int) -> dict[str, list[date]]:
    """train / validation / test by date. Raises if a label window reaches into a later split."""
    parts: dict[str, list[date]] = {"train": [], "validation": [], "test": []}
    for day in snapshots:
        name = "train" if day <= train_until else "validation" if day <= validate_until else "test"
        parts[name].append(day)
    for early, late in (("train", "validation"), ("validation", "test")):
        if parts[early] and parts[late] and max(parts[early]) + timedelta(days=horizon_days) > min(parts[late]):
            raise ValueError(f"a {early} label window reaches into {late}")
    return parts


def split_name(day: Column, train_until: date, validate_until: date) -> Column:
    return (
        F.when(day <= F.lit(train_until), "train")
        .when(day <= F.lit(validate_until), "validation")
        .otherwise("test")
    )


def label_overlap_days(snapshots: list[date], horizon_days: int) -> int:
    """How far consecutive label windows overlap."""
    gaps = [(b - a).days for a, b in zip(snapshots, snapshots[1:])]
    return max(0, horizon_days - min(gaps)) if gaps else 0
