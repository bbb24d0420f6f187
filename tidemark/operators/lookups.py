"""Lookup joins against keyed tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def attach(df: DataFrame, dimension: DataFrame, on: Mapping[str, str], take: Mapping[str, str],
           spread_nulls: bool = True) -> DataFrame:
    """Left join to a table that is unique on `on`'s values; `take` maps new column -> dimension column.

    No size hint is given: Spark broadcasts when its statistics say the table is small, and AQE splits the
    partition of a hot key otherwise. Rows with a null key match nothing but would all meet in one
    partition, so they carry a spreading value as a second join key.
    """
    renamed = {source: f"_dim_{i}" for i, source in enumerate(on.values())}
    side = dimension.select(
        *[F.col(c).alias(alias) for c, alias in renamed.items()],
        *[F.col(c).alias(new) for new, c in take.items()],
    )
    condition: Column | None = None
    missing: Column = F.lit(False)
    for left, right in on.items():
        equal = F.col(left) == F.col(renamed[right])
        condition = equal if condition is None else condition & equal
        missing = missing | F.col(left).isNull()
    if spread_nulls:
        hashable = [c for c, t in df.dtypes if "map<" not in t and "variant" not in t]
        spread = F.when(missing, F.xxhash64(*hashable).bitwiseOR(F.lit(1))).otherwise(F.lit(0))  # never 0 for a row without a key
        df = df.withColumn("_spread", spread)
        side = side.withColumn("_no_spread", F.lit(0).cast("bigint"))
        condition = condition & (F.col("_spread") == F.col("_no_spread"))
    return df.join(side, condition, "left").drop(*renamed.values(), "_spread", "_no_spread")


def small_table(spark, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A configuration table; its size is fixed by the configuration, so it may be broadcast."""
    return F.broadcast(spark.createDataFrame(list(rows), schema))


def map_value(mapping: Mapping, key: Column) -> Column:
    """mapping[key] as a column, null for a key that is not in it."""
    pairs = [F.lit(item) for pair in mapping.items() for item in pair]
    return F.create_map(*pairs)[key]


def latest_before(df: DataFrame, keys: Sequence[str], day: str, as_of: Column, values: Sequence[str]) -> DataFrame:
    """As-of lookup by aggregation: each key's values on its latest day not after `as_of`."""
    picked = F.max_by(F.struct(day, *values), F.col(day)).alias("_latest")
    return df.where(F.col(day) <= as_of).groupBy(*keys).agg(picked).select(
        *keys, *[F.col(f"_latest.{c}").alias(c) for c in (day, *values)]
    )
