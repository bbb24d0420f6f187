"""Exact global numbering, running totals and quantiles without a single-task window.

`Window.orderBy(...)` with no partition sends every row to one task, and a window partitioned by a hot key
sends that key's rows to one task. Both are replaced here by a range layout: rows are range-partitioned and
sorted on the full order, each slice is numbered where it lies, and a slice's start comes from the totals
of the slices before it. The only unpartitioned window left runs over one row per slice.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

_SLICE, _OFFSET = "_slice", "_offset"
_ROW_BITS = 33  # monotonically_increasing_id keeps the row in the low 33 bits, the partition above


def range_layout(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """`df` sorted over range partitions, with `_slice` (partition) and `_offset` (row in it, from 0).

    Range bounds are sampled, so two evaluations may disagree; the result is checkpointed once and both
    the rows and the slice totals are read from it.
    """
    row_id = F.monotonically_increasing_id()
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row_id", row_id)
    return cut_lineage(
        laid.select(
            *df.columns,
            F.shiftright("_row_id", _ROW_BITS).alias(_SLICE),
            F.col("_row_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias(_OFFSET),
        )
    )


def global_row_number(df: DataFrame, order: Sequence[Column], name: str = "position",
                      total: str | None = None) -> DataFrame:
    """1-based number of every row in `order`, which must be total for reruns to agree; with `total`, also the
    number of rows, which the slices already know."""
    laid = range_layout(df, order)
    before = Window.orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = laid.groupBy(_SLICE).agg(F.count("*").alias("_n")).select(
        _SLICE, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(everything).alias("_total")
    )
    # Broadcast bound: one row per range partition.
    numbered = laid.join(F.broadcast(starts), _SLICE)
    extra = [F.col("_total").alias(total)] if total else []
    return numbered.select(*df.columns, (F.col("_start") + F.col(_OFFSET) + 1).alias(name), *extra)


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[Column], totals: Mapping[str, Column],
                   marks: Mapping[str, tuple[str, Column]] | None = None) -> DataFrame:
    """Inclusive running sums per key along `order`; a key of any size spreads over several slices. An entry of `marks`, a total of values
    that are not negative and a condition, gives that total as it was at the latest row that meets the condition (null before one)."""
    keys, marks = list(keys), marks or {}
    # One never-null key column: windows, slice sums and the join below then share one partitioning, and a null key
    # is a key like any other.
    key = F.struct(*keys) if keys else F.lit(0)
    prepared = df.withColumns({**totals, **{f"_met_{n}": met for n, (_, met) in marks.items()}, "_key": key})
    laid = range_layout(prepared, [*(F.col(k).asc() for k in keys), *order])
    on = [_SLICE, "_key"]
    within = Window.partitionBy(*on).orderBy(_OFFSET).rowsBetween(Window.unboundedPreceding, 0)
    local = laid.withColumns({f"_run_{n}": F.sum(n).over(within) for n in totals})
    # A total never falls, so the latest one is the largest.
    at_mark = {n: F.when(F.col(f"_met_{n}"), F.col(f"_run_{t}")) for n, (t, _) in marks.items()}
    local = local.withColumns({f"_at_{n}": F.max(c).over(within) for n, c in at_mark.items()}) if marks else local
    slice_sums = local.groupBy(*on).agg(*[F.sum(n).alias(f"_sum_{n}") for n in totals], *[F.max(f"_at_{n}").alias(f"_last_{n}") for n in marks])
    # At most one row per slice and key: a key contributes as many rows as the slices it spans.
    earlier = Window.partitionBy("_key").orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    starts = slice_sums.select(*on, *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_start_{n}") for n in totals], *(f"_last_{n}" for n in marks))
    starts = starts.withColumns({f"_from_{n}": F.max(F.col(f"_start_{t}") + F.col(f"_last_{n}")).over(earlier) for n, (t, _) in marks.items()}) if marks else starts
    if not keys:
        starts = F.broadcast(starts)  # one row per range partition
    kept = [c for c in df.columns if c not in totals]
    return local.join(starts, on).select(*kept, *[(F.col(f"_run_{n}") + F.col(f"_start_{n}")).alias(n) for n in totals],
                                         *[F.coalesce(F.col(f"_at_{n}") + F.col(f"_start_{t}"), F.col(f"_from_{n}")).alias(n) for n, (t, _) in marks.items()])


def pages(df: DataFrame, keys: Sequence[str], order: Sequence[Column], rows: int, name: str = "page") -> DataFrame:
    """`df` with the page (from 0) its row is on when every key's rows are laid out in `order`, `rows` to a page. Pages are contiguous, and a key of
    any size spreads over tasks."""
    numbered = running_totals(df, keys, order, {"_row_of_key": F.lit(1)})
    return numbered.withColumn(name, F.floor((F.col("_row_of_key") - 1) / rows).cast("int")).drop("_row_of_key")


def join_by_group(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on group keys where null is a group like any other: the keys meet as one struct, which is never
    null and hashes like the key of running_totals."""
    rest = [c for c in right.columns if c not in keys]
    side = right.select(F.struct(*keys).alias("_key"), *rest)
    return left.withColumn("_key", F.struct(*keys)).join(side, "_key").drop("_key")


def exact_quantiles(df: DataFrame, value: str, probabilities: Mapping[str, float],
                    keys: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolated quantiles per key, one column per entry of `probabilities`.

    Values are counted first, so ties collapse before the sort; no task ever holds a key's values."""
    keys = list(keys)
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    sizes = counted.groupBy(*keys).agg(F.sum("_n").alias("_size"))
    scanned = running_totals(counted, keys, [F.col(value).asc()], {"_upto": F.col("_n")})
    scanned = join_by_group(scanned, sizes, keys) if keys else scanned.withColumn("_size", sizes.scalar())
    picks = []
    for name, p in probabilities.items():
        at = F.lit(float(p)) * (F.col("_size") - 1)
        for side, index in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            inside = (index >= F.col("_upto") - F.col("_n")) & (index < F.col("_upto"))
            picks.append(F.max(F.when(inside, F.col(value).cast("double"))).alias(f"_{side}_{name}"))
    found = scanned.groupBy(*keys).agg(F.max("_size").alias("_size"), *picks)
    out = []
    for name, p in probabilities.items():
        at = F.lit(float(p)) * (F.col("_size") - 1)
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((low + (high - low) * (at - F.floor(at))).alias(name))
    return found.select(*keys, *out)


def nearest_ranks(counted: DataFrame, value: str, weight: str, percents: Sequence[int], keys: Sequence[str], prefix: str, total: str = "rows") -> DataFrame:
    """Per key the least values whose share of values at or below them is at least so many per cent, and the sum of the weights, from a frame
    whose rows stand for `weight` rows each. Nulls count as rows and are not values; no task ever holds a key's values."""
    keys = list(keys)
    scanned = running_totals(counted, keys, [F.col(value).asc()], {"_upto": F.when(F.col(value).isNotNull(), F.col(weight)).otherwise(0)})
    sizes = scanned.groupBy(*keys).agg(F.max("_upto").alias("_size"))
    place = lambda p: F.floor((F.col("_size") * p + 99) / F.lit(100).cast("decimal(3,0)"))
    picks = [F.min(F.when(F.col("_upto") >= place(p), F.col(value))).alias(f"{prefix}_p{p}") for p in percents]
    return join_by_group(scanned, sizes, keys).groupBy(*keys).agg(F.sum(weight).alias(total), *picks)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first `n` rows per key. Spark plans a group limit on both sides of the shuffle, so a hot key
    ships at most `n` rows per map task."""
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(ranked)).where(F.col("_place") <= n).drop("_place")


def _shared_ranks(counted: DataFrame, value: str, weight: str, name: str, ascending: bool = True) -> DataFrame:
    """`_value` and its mean rank, as a share of all rows, for every value of a frame whose rows stand for `weight` rows each."""
    sizes = counted.groupBy(value).agg(F.sum(weight).alias("_m"))
    direction = F.col(value).asc() if ascending else F.col(value).desc()
    scanned = running_totals(sizes, [], [direction], {"_upto": F.col("_m")})
    size = sizes.agg(F.sum("_m")).scalar()
    return scanned.select(F.col(value).alias("_value"), ((F.col("_upto") - (F.col("_m") - 1) / 2) / size).alias(name))


def average_rank(df: DataFrame, value: str, name: str, ascending: bool = True) -> DataFrame:
    """Rank over all rows with ties sharing their mean rank, as a share of the row count."""
    counted = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    ranks = _shared_ranks(counted, value, "_n", name, ascending)
    return df.join(ranks, F.col(value) == F.col("_value"), "left").drop("_value")


def spearman(df: DataFrame, left: str, right: str, name: str = "spearman") -> DataFrame:
    """Rank correlation: the correlation of the two average ranks. Equal pairs are counted first, so no value, however frequent,
    brings its rows to a join."""
    pairs = cut_lineage(df.where(F.col(left).isNotNull() & F.col(right).isNotNull()).groupBy(left, right).agg(F.count("*").alias("_n")))
    ranked = pairs
    for value, rank in ((left, "_x"), (right, "_y")):
        ranked = ranked.join(_shared_ranks(pairs, value, "_n", rank), F.col(value) == F.col("_value")).drop("_value")
    x, y = F.col("_x") - 0.5, F.col("_y") - 0.5  # close to the mean of ranks, so that the sums keep their digits
    sums = ranked.agg(F.sum("_n").alias("n"), F.sum(F.col("_n") * x).alias("sx"), F.sum(F.col("_n") * y).alias("sy"), F.sum(F.col("_n") * x * y).alias("sxy"),
                     F.sum(F.col("_n") * x * x).alias("sxx"), F.sum(F.col("_n") * y * y).alias("syy"))
    together = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    apart = F.sqrt((F.col("sxx") - F.col("sx") ** 2 / F.col("n")) * (F.col("syy") - F.col("sy") ** 2 / F.col("n")))
    return sums.select(F.try_divide(together, apart).alias(name))


def top_fraction(df: DataFrame, score: str, tie: str, fraction: float, name: str = "in_top") -> DataFrame:
    """Marks the ceil(fraction x rows) highest scores; ties go to the smaller `tie` value."""
    numbered = global_row_number(df, [F.col(score).desc(), F.col(tie).asc()], "_position", "_size")
    taken = F.ceil(F.lit(fraction).cast("decimal(8,6)") * F.col("_size"))
    return numbered.withColumn(name, F.col("_position") <= taken).drop("_position", "_size")


def share_tiers(df: DataFrame, score: str, tie: str, high: float, medium: float,
                name: str = "tier") -> DataFrame:
    """high / medium / low by rank: the top ceil(high x n), then up to ceil((high + medium) x n)."""
    numbered = global_row_number(df, [F.col(score).desc(), F.col(tie).asc()], "_position", "_size")
    # decimal arithmetic, so that 0.2 + 0.3 is one half and ceil() cannot step over it
    cut_high = F.ceil(F.lit(high).cast("decimal(6,4)") * F.col("_size"))
    cut_medium = F.ceil((F.lit(high).cast("decimal(6,4)") + F.lit(medium).cast("decimal(6,4)")) * F.col("_size"))
    place = F.col("_position")
    tier = F.when(place <= cut_high, "high").when(place <= cut_medium, "medium").otherwise("low")
    return numbered.withColumn(name, tier).drop("_position", "_size")


def tier_thresholds(tiered: DataFrame, score: str, tier: str = "tier") -> DataFrame:
    """Lowest score inside the high and medium tiers."""
    lowest = lambda t: F.min(F.when(F.col(tier) == t, F.col(score)))
    return tiered.agg(lowest("high").alias("high_min_score"), lowest("medium").alias("medium_min_score"))


def hash_ordered_sample(df: DataFrame, id_column: str, n: int, seed: str = "0") -> DataFrame:
    """A repeatable sample of exactly `n` rows: the `n` smallest hashes of (id, seed)."""
    mix = F.md5(F.concat_ws(":", F.col(id_column).cast("string"), F.lit(seed)))
    return df.orderBy(mix, F.col(id_column)).limit(n)


def hash_bucket_sample(df: DataFrame, id_column: str, buckets: int, keep: int = 0) -> DataFrame:
    """The rows whose id hashes into bucket `keep`: the same customers on every run and every table."""
    return df.where(md5_bucket(F.col(id_column), buckets) == keep)


def md5_bucket(value: Column, buckets: int) -> Column:
    """A bucket number other engines can recompute: the first 8 hex digits of md5, modulo `buckets`."""
    return F.pmod(F.conv(F.substring(F.md5(value.cast("string")), 1, 8), 16, 10).cast("bigint"), F.lit(buckets))


def unit_draw(*parts: Column) -> Column:
    """A repeatable draw in [0, 1) from the given values."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
