"""Scores for every registered customer: model scores with tiers, and named fallbacks without a score."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.gates import Gate, none_gate
from tidemark.operators.ordering import exact_quantiles, share_tiers, tier_thresholds
from tidemark.plans.features import FEATURES, SNAPSHOT, cutoff_for
from tidemark.session import cut_lineage

# Fixed values.
NEW_CUSTOMER_DAYS = 90
HIGH_SHARE, MEDIUM_SHARE = 0.20, 0.30
NO_ACTIVITY, TOO_NEW, NO_DATA = "no_eligible_txn_365d", "insufficient_history_new_customer", "insufficient_data"
FALLBACK_TIERS = {NO_ACTIVITY: "high", TOO_NEW: "new_customer", NO_DATA: "unknown"}
MODEL_TIERS = ("high", "medium", "low")
SCORE_COLUMNS = ("customer_id", "as_of_date", "model_version", "model_eligible", "scoring_source", "risk_score",
                 "risk_tier", "reason_code")
SUMMARY_QUANTILES = (0.0, 0.1, 0.25, 0.5, 0.75, 0.8, 0.9, 1.0)


def all_finite(columns: Sequence[str]) -> Column:
    ok = F.lit(True)
    for c in columns:
        value = F.col(c).cast("double")
        ok = ok & value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return ok


def score_customers(customers: DataFrame, rows: DataFrame, scores: DataFrame, as_of: date, model_version: str,
                    inputs: Sequence[str] = FEATURES) -> DataFrame:
    """`rows`: feature rows at this cutoff. `scores`: customer_id, score for them. A customer who registers
    later is not one yet; one without usable inputs gets a reason instead of an invented score."""
    cutoff = F.lit(cutoff_for(as_of))
    registered = F.to_date("registration_date")
    universe = customers.where(registered.isNull() | (registered < cutoff)).select("customer_id", registered.alias("_registered"))
    known = rows.where(F.col(SNAPSHOT) == cutoff).select("customer_id", F.lit(True).alias("_known"), all_finite(inputs).alias("_usable"))
    joined = universe.join(known, "customer_id", "left").join(scores.select("customer_id", F.col("score").alias("_score")), "customer_id", "left")
    by_model = F.coalesce(F.col("_usable"), F.lit(False)) & F.col("_score").isNotNull()
    reason = (
        F.when(by_model, None).when(F.col("_known"), NO_DATA).when(F.col("_registered").isNull(), NO_DATA)
        .when(F.datediff(cutoff, "_registered") < NEW_CUSTOMER_DAYS, TOO_NEW).otherwise(NO_ACTIVITY))
    # a narrow table used for the tiers and for the result: computed once
    judged = cut_lineage(joined.select("customer_id", by_model.alias("model_eligible"), F.when(by_model, F.col("_score")).alias("risk_score"),
                           reason.alias("reason_code")))
    tiers = share_tiers(judged.where("model_eligible").select("customer_id", "risk_score"), "risk_score", "customer_id",
                        HIGH_SHARE, MEDIUM_SHARE, "_tier").select("customer_id", "_tier")
    fallback = F.lit(None).cast("string")
    for name, tier in FALLBACK_TIERS.items():
        fallback = F.when(F.col("reason_code") == name, tier).otherwise(fallback)
    return judged.join(tiers, "customer_id", "left").select(
        "customer_id", F.lit(as_of).alias("as_of_date"), F.lit(model_version).alias("model_version"), "model_eligible",
        F.when(F.col("model_eligible"), "model").otherwise("fallback").alias("scoring_source"), "risk_score",
        F.coalesce("_tier", fallback).alias("risk_tier"), "reason_code")


def invariants() -> dict[str, Column]:
    """What must hold for every row of a score table."""
    model, fallback = F.col("model_eligible"), ~F.col("model_eligible")
    expected = F.lit(None).cast("string")
    for name, tier in FALLBACK_TIERS.items():
        expected = F.when(F.col("reason_code") == name, tier).otherwise(expected)
    return {
        "model_score_not_probability": fallback | F.col("risk_score").between(0, 1),
        "model_tier_or_reason": fallback | (F.col("risk_tier").isin(*MODEL_TIERS) & F.col("reason_code").isNull()),
        "fallback_with_score": model | F.col("risk_score").isNull(), "fallback_tier_disagrees": model | (F.col("risk_tier") == expected),
        "source_disagrees": (F.col("scoring_source") == "model") == model}


def invariant_violations(scores: DataFrame) -> DataFrame:
    """One row: how many rows break each rule a score table must keep."""
    fails = lambda c: F.count_if(~F.coalesce(c, F.lit(False)))
    counted = scores.agg(F.count("*").alias("rows"), *(fails(rule).alias(name) for name, rule in invariants().items()), F.lit(1).alias("_one"))
    repeated = scores.groupBy("customer_id").agg(F.count("*").alias("_n")).where("_n > 1").agg(
        F.count("*").alias("repeated_customers"), F.lit(1).alias("_one"))
    return counted.join(F.broadcast(repeated), "_one").drop("_one")  # one row each


def score_gates(model_version: str, as_of: date) -> list[Gate]:
    """The rules of a score table as gates of the job that publishes it, and that all its rows are of one model version and day."""
    other = lambda column, value: F.count_if(~F.col(column).eqNullSafe(F.lit(value)))
    return [none_gate("invariant", name, ~rule) for name, rule in invariants().items()] + [
        Gate("other_version", model_version, other("model_version", model_version), 0), Gate("other_day", str(as_of), other("as_of_date", as_of), 0)]


def validate_scores(scores: DataFrame, model_version: str | None = None, as_of: date | None = None) -> None:
    """Raises on columns, invariants, or more than one model version or date."""
    if tuple(scores.columns) != SCORE_COLUMNS:
        raise ValueError(f"columns {scores.columns} are not {list(SCORE_COLUMNS)}")
    found = {k: v for k, v in invariant_violations(scores).first().asDict().items() if v and k != "rows"}
    if found:
        raise ValueError(f"score rows break {found}")
    spread = scores.agg(F.min("model_version").alias("v1"), F.max("model_version").alias("v2"),
                        F.min("as_of_date").alias("d1"), F.max("as_of_date").alias("d2")).first()
    if spread.v1 != spread.v2 or spread.d1 != spread.d2:
        raise ValueError("scores of several model versions or dates")
    if (model_version and spread.v1 != model_version) or (as_of and spread.d1 != as_of):
        raise ValueError(f"scores are of {spread.v1} on {spread.d1}")


def check_as_of(as_of: date, activity: DataFrame, ts: str = "ts") -> None:
    """A date after the last day of data cannot be scored."""
    last = activity.agg(F.max(F.to_date(ts))).first()[0]
    if last is None or as_of > last:
        raise ValueError(f"as-of {as_of} is after the last day of data ({last})")


def counts_by(scores: DataFrame) -> DataFrame:
    """Rows per source, tier and reason."""
    return scores.groupBy("scoring_source", "risk_tier", "reason_code").agg(F.count("*").alias("customers"))


def score_summary(scores: DataFrame) -> DataFrame:
    """One row: totals, tier thresholds, mean and quantiles of the model scores."""
    one = F.lit(1).alias("_one")
    totals = scores.agg(
        F.count("*").alias("customers"), F.count_if("model_eligible").alias("model_eligible"),
        *[F.count_if(F.col("reason_code") == r).alias(r) for r in FALLBACK_TIERS],
        *[F.count_if(F.col("risk_tier") == t).alias(f"tier_{t}") for t in ("high", "medium", "low", "new_customer", "unknown")],
        F.avg("risk_score").alias("score_mean"), one)
    model = scores.where("model_eligible")
    marks = exact_quantiles(model, "risk_score", {f"score_q{int(q * 100)}": q for q in SUMMARY_QUANTILES}).select("*", one)
    edges = tier_thresholds(model, "risk_score", "risk_tier").select("*", one)
    # one row each
    return totals.join(F.broadcast(marks), "_one", "left").join(F.broadcast(edges), "_one", "left").drop("_one")
