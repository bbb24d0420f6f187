"""Quantiles as mergeable sketches: KLL sketches stored as binary columns, merged into longer windows without a second look at the rows.

A sketch of parameter `k` is exact up to k values and has a rank error of about `rank_error(k)` beyond; its size grows with
the logarithm of what it has seen. Nulls are not values; the quantiles of a sketch without values are null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SKETCH_K = 4096


def rank_error(k: int = SKETCH_K) -> float:
    """The normalised rank error that a sketch keeps with 99 % confidence."""
    return 2.296 / k**0.9021


def sketch(value: str | Column, k: int = SKETCH_K) -> Column:
    return F.kll_sketch_agg_double(F.col(value).cast("double") if isinstance(value, str) else value.cast("double"), F.lit(k))


def merged(sketches: str | Column, k: int = SKETCH_K) -> Column:
    return F.kll_merge_agg_double(sketches, F.lit(k))


def quantile(sketches: str | Column, p: float) -> Column:
    """The least value whose share of values at or below it is at least p."""
    return F.when(F.kll_sketch_get_n_double(sketches) > 0, F.kll_sketch_get_quantile_double(sketches, F.lit(float(p))))


def quantile_columns(sketches: str, prefix: str, percents: Sequence[int]) -> list[Column]:
    return [quantile(sketches, p / 100).alias(f"{prefix}_p{p}") for p in percents]


def rolled_up(df: DataFrame, start: str, unit: str, sketches: str, counts: Sequence[str] = (), keys: Sequence[str] = ()) -> DataFrame:
    """Windows that begin at `start`, with their counts and sketch, merged into hours, days or months."""
    return df.groupBy(F.date_trunc(unit, start).alias(start), *keys).agg(*(F.sum(c).alias(c) for c in counts), merged(sketches).alias(sketches))
