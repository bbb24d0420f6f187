"""Classification and ranking metrics as distributed jobs, each per group of `keys` if wanted.

Scores are counted first, so ties collapse; running totals follow the score order over range partitions. No
group is ever held by one task, and a slice per snapshot or segment is just one more key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordering import global_row_number, join_by_group, running_totals, unit_draw


def score_curve(df: DataFrame, score: str, label: str, keys: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """Per distinct score, from the highest: positives and negatives there (pos, neg) and so far (tp, fp)."""
    w = F.lit(1) if weight is None else weight
    counted = df.groupBy(*keys, F.col(score).alias("score")).agg(
        F.sum(F.when(F.col(label) == 1, w).otherwise(0)).alias("pos"), F.sum(F.when(F.col(label) == 1, 0).otherwise(w)).alias("neg"))
    return running_totals(counted, keys, [F.col("score").desc()], {"tp": F.col("pos"), "fp": F.col("neg")})


def ranking_quality(df: DataFrame, score: str, label: str, keys: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """ROC-AUC with tied scores counted half, and step-wise average precision."""
    curve = score_curve(df, score, label, keys, weight)
    positives, negatives = F.sum("pos"), F.sum("neg")
    wins = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    precision = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))
    out = curve.groupBy(*keys).agg(
        F.try_divide(wins, positives * negatives).alias("roc_auc"),
        F.try_divide(F.sum(F.col("pos") * precision), positives).alias("pr_auc"),
        positives.alias("positives"), (positives + negatives).alias("rows"))
    return out.withColumn("prevalence", F.try_divide(F.col("positives"), F.col("rows")))


def best_f1_threshold(df: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """The score threshold with the largest F1; of equal ones the lowest."""
    keys = list(keys)
    curve = score_curve(df, score, label, keys)
    totals = curve.groupBy(*keys).agg(F.sum("pos").alias("_positives"))
    joined = join_by_group(curve, totals, keys) if keys else curve.withColumn("_positives", totals.scalar())
    f1 = F.try_divide(2.0 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("_positives"))
    best = F.max(F.struct(F.round(f1, 12).alias("f1"), (-F.col("score")).alias("low"))).alias("_best")
    return joined.withColumn("_f1", f1).groupBy(*keys).agg(best).select(
        *keys, (-F.col("_best.low")).alias("threshold"), F.col("_best.f1").alias("f1"))


def confusion(df: DataFrame, predicted: Column, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Counts and precision, recall and F1 of a yes/no prediction."""
    yes, real = F.coalesce(predicted, F.lit(False)), F.col(label) == 1
    out = df.groupBy(*keys).agg(
        F.count_if(yes & real).alias("tp"), F.count_if(yes & ~real).alias("fp"),
        F.count_if(~yes & real).alias("fn"), F.count_if(~yes & ~real).alias("tn"))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return out.withColumns({
        "precision": zero(F.col("tp"), F.col("tp") + F.col("fp")), "recall": zero(F.col("tp"), F.col("tp") + F.col("fn")),
        "f1": zero(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))})


def top_quality(df: DataFrame, score: str, label: str, tie: str, fractions: Sequence[float]) -> DataFrame:
    """Recall, precision and lift among the highest scores, for several fractions, from one numbering."""
    order = [F.col(score).desc(), F.col(tie).asc()]
    numbered = global_row_number(df.select(score, label, tie), order, "_position", "_rows")
    taken = lambda f: F.ceil(F.lit(f).cast("decimal(8,6)") * F.col("_rows")).cast("bigint")
    hits = [F.count_if((F.col("_position") <= taken(f)) & (F.col(label) == 1)).alias(f"_hits_{i}") for i, f in enumerate(fractions)]
    counted = numbered.groupBy("_rows").agg(F.count_if(F.col(label) == 1).alias("_positives"), *hits)
    rows = F.array(*[F.struct(F.lit(float(f)).alias("fraction"), taken(f).alias("taken"), F.col(f"_hits_{i}").alias("hits"))
                     for i, f in enumerate(fractions)])
    flat = counted.select("_rows", "_positives", F.inline(rows))
    precision = F.try_divide(F.col("hits"), F.col("taken"))
    return flat.select(
        "fraction", "taken", "hits", F.try_divide(F.col("hits"), F.col("_positives")).alias("recall"), precision.alias("precision"),
        F.try_divide(precision, F.try_divide(F.col("_positives"), F.col("_rows"))).alias("lift"))


def feature_aucs(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """ROC-AUC of every single feature, and how far it is from a coin toss either way."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    long = df.select(label, F.inline(pairs))
    return ranking_quality(long, "value", label, ["feature"]).select(
        "feature", "roc_auc", F.greatest(F.col("roc_auc"), 1 - F.col("roc_auc")).alias("oriented"))


def interval(differences: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and 95 % percentile interval of each column; one row per resample goes in."""
    aggregates = []
    for c in columns:
        aggregates += [F.avg(c).alias(f"{c}_mean"), F.percentile(c, F.lit(0.025)).alias(f"{c}_low"), F.percentile(c, F.lit(0.975)).alias(f"{c}_high")]
    return differences.agg(*aggregates)


def mean_difference(df: DataFrame, first: str, second: str) -> DataFrame:
    """Mean of first - second over groups, with its normal 95 % interval."""
    gap = F.col(first) - F.col(second)
    stats = df.agg(F.avg(gap).alias("mean"), F.try_divide(F.stddev_samp(gap), F.sqrt(F.count(gap))).alias("_error"), F.count(gap).alias("groups"))
    return stats.select("mean", (F.col("mean") - 1.96 * F.col("_error")).alias("low"), (F.col("mean") + 1.96 * F.col("_error")).alias("high"), "groups")


# ---- Ranking within small groups (a handful of candidates per group) ----

def ranked_groups(df: DataFrame, group: Sequence[str], rank: str, relevance: str, tie: str, k: int = 3) -> DataFrame:
    """Per group: NDCG@k, whether the first is relevant, recall@k and whether anything relevant is in the top k."""
    ideal = F.row_number().over(Window.partitionBy(*group).orderBy(F.col(relevance).desc(), F.col(tie).asc()))
    marked = df.select(*group, F.col(rank).alias("_rank"), F.col(relevance).alias("_rel"), ideal.alias("_ideal"))
    gain = lambda place: (F.pow(F.lit(2.0), F.col("_rel")) - 1) / F.log2(F.col(place) + 1.0)
    top, good = F.col("_rank") <= k, F.col("_rel") > 0
    sums = marked.groupBy(*group).agg(
        F.sum(F.when(top, gain("_rank")).otherwise(0.0)).alias("_dcg"),
        F.sum(F.when(F.col("_ideal") <= k, gain("_ideal")).otherwise(0.0)).alias("_idcg"),
        F.count_if(top & good).alias("_hits"), F.count_if(good).alias("_relevant"), F.count_if(good & (F.col("_rank") == 1)).alias("_first"))
    return sums.select(*group, F.try_divide(F.col("_dcg"), F.col("_idcg")).alias("ndcg"), F.col("_first").alias("precision_at_1"),
                       F.try_divide(F.col("_hits"), F.col("_relevant")).alias("recall"), (F.col("_hits") > 0).cast("int").alias("hit"))


def mean_ranking(df: DataFrame, group: Sequence[str], rank: str, relevance: str, tie: str, k: int = 3,
                 keys: Sequence[str] = ()) -> DataFrame:
    """Group metrics averaged, overall or per `keys` (which must be part of the group)."""
    return ranked_groups(df, group, rank, relevance, tie, k).groupBy(*keys).agg(
        F.avg("ndcg").alias("ndcg"), F.avg("precision_at_1").alias("precision_at_1"), F.avg("recall").alias("recall"),
        F.avg("hit").alias("hit_rate"), F.count("*").alias("groups"))


def random_expectation(df: DataFrame, group: Sequence[str], relevance: str, tie: str, draws: int = 20, k: int = 3) -> DataFrame:
    """What a random order scores on average over repeatable draws."""
    drawn = df.select(*group, relevance, tie, F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    chance = unit_draw(*[F.col(c) for c in (*group, tie, "draw")])
    place = F.row_number().over(Window.partitionBy(*group, "draw").orderBy("_chance", tie))
    ranked = drawn.withColumn("_chance", chance).withColumn("_place", place)
    per_draw = mean_ranking(ranked, [*group, "draw"], "_place", relevance, tie, k, ["draw"])
    return per_draw.agg(*[F.avg(c).alias(c) for c in ("ndcg", "precision_at_1", "recall", "hit_rate")])


def within_tolerance(measured: Mapping[str, float], reported: Mapping[str, float], tolerance: float = 1.5e-4) -> None:
    """The replication gate: stops when a metric does not reproduce its reported value."""
    off = {k: (measured.get(k), v) for k, v in reported.items() if measured.get(k) is None or abs(measured[k] - v) > tolerance}
    if off:
        raise ValueError(f"metrics do not reproduce the reported values: {off}")
