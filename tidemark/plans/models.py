"""Spark ML models for the engagement target: boosted trees, linear probe, click probe and their checks."""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.metrics import ranking_quality
from tidemark.operators.ordering import average_rank, global_row_number
from tidemark.plans.features import FEATURES, TARGET
from tidemark.session import cut_lineage, ensure_checkpoint_dir

# The tuned parameters that Spark's trees can express.
TREES = {"maxIter": 77, "stepSize": 0.05, "maxDepth": 6, "minInstancesPerNode": 50, "featureSubsetStrategy": "0.8",
         "subsamplingRate": 1.0, "seed": 7}
NOT_TRANSACTIONAL = ("tenure_days", "products_opened", "sends_180d", "opens_180d", "clicks_180d", "days_since_last_click",
                     "contacts_180d", "complaints_180d", "logins_90d", "digital_active_days_90d", "days_since_last_login")
TRANSACTIONAL = tuple(f for f in FEATURES if f not in NOT_TRANSACTIONAL)


def boosted_trees(inputs: Sequence[str] = FEATURES, label: str = TARGET, **parameters) -> Pipeline:
    trees = GBTClassifier(featuresCol="_inputs", labelCol=label, **{**TREES, **parameters})
    return Pipeline(stages=[VectorAssembler(inputCols=list(inputs), outputCol="_inputs"), trees])


def single_split_trees(inputs: Sequence[str] = FEATURES, label: str = TARGET, **parameters) -> Pipeline:
    """The additive check: without interactions, how much is lost?"""
    return boosted_trees(inputs, label, **{"maxDepth": 1, **parameters})


def signed_log(column: str) -> str:
    return f"signum({column}) * log1p(abs({column}))"


def linear_probe(inputs: Sequence[str] = FEATURES, label: str = TARGET) -> Pipeline:
    """Signed log1p, standardised, logistic regression."""
    logs = ", ".join(f"{signed_log(c)} AS _log_{c}" for c in inputs)
    return Pipeline(stages=[
        SQLTransformer(statement=f"SELECT *, {logs} FROM __THIS__"),
        VectorAssembler(inputCols=[f"_log_{c}" for c in inputs], outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_inputs", withMean=True, withStd=True),
        LogisticRegression(featuresCol="_inputs", labelCol=label, maxIter=200, tol=1e-4)])


def click_probe(with_channel: bool, numbers: Sequence[str] = ("past_delivered", "past_click_rate", "past_open_rate"),
                label: str = "clicked") -> Pipeline:
    """Standardised history, optionally with the one-hot channel; an unseen channel has no effect."""
    stages = [VectorAssembler(inputCols=list(numbers), outputCol="_numbers"),
              StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True, withStd=True)]
    parts = ["_scaled"]
    if with_channel:
        stages += [StringIndexer(inputCol="send_channel", outputCol="_channel", handleInvalid="keep"),
                   OneHotEncoder(inputCol="_channel", outputCol="_one_hot", handleInvalid="keep", dropLast=True)]
        parts.append("_one_hot")
    stages += [VectorAssembler(inputCols=parts, outputCol="_inputs"),
               LogisticRegression(featuresCol="_inputs", labelCol=label, maxIter=200)]
    return Pipeline(stages=stages)


def fitted(pipeline: Pipeline, rows: DataFrame) -> PipelineModel:
    """A fitted model as it is saved. A model straight from the fit holds its training summary and with that the session, which cannot go to tasks once
    the session has observed a write (`gates`); a saved one is only its parameters."""
    path = f"{ensure_checkpoint_dir(rows.sparkSession).rstrip('/')}/fitted-{uuid.uuid4().hex}"
    pipeline.fit(rows).write().overwrite().save(path)
    return PipelineModel.load(path)


def channel_rate_score(train: DataFrame, rows: DataFrame) -> DataFrame:
    """The channel's click rate on training rows as a score; 0 for a channel never seen. One row per channel."""
    rates = train.groupBy("send_channel").agg(F.avg("clicked").alias("channel_rate"))
    return rows.join(rates, "send_channel", "left").na.fill(0.0, ["channel_rate"])


def channel_rates(rows: DataFrame) -> DataFrame:
    return rows.groupBy("send_channel").agg(F.count("*").alias("sends"), F.avg("clicked").alias("click_rate"), F.avg("opened").alias("open_rate"))


def predict(model: PipelineModel, rows: DataFrame, name: str = "score") -> DataFrame:
    """The probability of the positive class beside the input columns."""
    return model.transform(rows).select(*rows.columns, F.element_at(vector_to_array("probability"), 2).alias(name))


def rule_scores(rows: DataFrame) -> DataFrame:
    """The rules a model must beat: nothing, recency, frequency, and the mean of both percentile ranks."""
    ranked = average_rank(rows, "days_since_last_txn", "_recency")
    ranked = average_rank(ranked, "txn_count_90d", "_frequency", ascending=False)
    return ranked.withColumns({
        "rule_majority": F.lit(0.0), "rule_recency": F.col("days_since_last_txn").cast("double"),
        "rule_frequency": -F.col("txn_count_90d").cast("double"), "rule_ranks": (F.col("_recency") + F.col("_frequency")) / 2,
    }).drop("_recency", "_frequency")


def compare_scores(rows: DataFrame, scores: Mapping[str, str], label: str, keys: Sequence[str] = ()) -> DataFrame:
    """ROC-AUC and PR-AUC of several score columns in one job."""
    pairs = F.array(*[F.struct(F.lit(n).alias("model"), F.col(c).cast("double").alias("_score")) for n, c in scores.items()])
    return ranking_quality(rows.select(label, *keys, F.inline(pairs)), "_score", label, ["model", *keys])


def ablation(train: DataFrame, valid: DataFrame, without: Sequence[str], label: str = TARGET, build=linear_probe,
             inputs: Sequence[str] = FEATURES) -> DataFrame:
    """The same model with and without some features, on the same validation rows."""
    kept = [f for f in inputs if f not in without]
    scored = predict(fitted(build(inputs, label), train), valid, "_with")
    scored = predict(fitted(build(kept, label), train), scored, "_without")
    return compare_scores(scored, {"all features": "_with", "without " + ", ".join(without): "_without"}, label)


def shuffles(rows: int, features: Sequence[str], repeats: int, seed: str) -> list[tuple[str, int, int, int]]:
    """(feature, repeat, factor, shift): position p of the rows takes the feature from position (factor * p + shift) mod rows, which is
    a bijection as the factor has no divisor in common with the number of rows. Positions are drawn by hash, so neighbours are strangers."""
    out = []
    for feature in features:
        for repeat in range(repeats):
            drawn = int(hashlib.md5(f"{seed}:{feature}:{repeat}".encode()).hexdigest(), 16)
            factor = drawn % rows
            while math.gcd(factor, rows) != 1:
                factor = (factor + 1) % rows if rows > 1 else 1
            out.append((feature, repeat, factor, drawn // rows % rows))
    return out


def permutation_importance(model: PipelineModel, rows: DataFrame, features: Sequence[str], label: str, ident: Sequence[str],
                           seed: str = "7", repeats: int = 1) -> DataFrame:
    """PR-AUC lost when a feature's values are dealt out anew, the mean over `repeats`. Rows are numbered once, by hash; each value goes to
    the row that a keyed bijection on the numbers names, and all variants are scored in one pass."""
    key = F.concat_ws(":", *[F.col(c).cast("string") for c in ident])
    base = rows.withColumn("_id", key)
    order = [F.md5(F.concat_ws(":", F.lit(seed), F.col("_id"))), F.col("_id")]
    numbered = cut_lineage(global_row_number(base.drop("_id").withColumn("_id", key), order, "_n", "_rows").drop("_id"))
    first = numbered.select("_rows").first()
    if first is None:
        return rows.sparkSession.createDataFrame([], "feature string, pr_auc_drop double")
    deals = shuffles(first["_rows"], features, repeats, seed)
    # One entry per feature and repeat: the row's own position and the value it takes there.
    taken = F.array(*[F.struct(F.lit(k).alias("deal"), ((F.col("_n") - 1) * F.lit(a).cast("decimal(20,0)") + F.lit(b)).alias("_from")) for k, (_, _, a, b) in enumerate(deals)])
    asked = numbered.select("_n", F.inline(taken)).select("_n", "deal", (F.col("_from") % first["_rows"] + 1).cast("bigint").alias("_from"))
    source = F.array(*[F.col(f).cast("double") for f in features])
    values = numbered.select(F.col("_n").alias("_from"), source.alias("_values"))
    at = F.element_at(F.array(*[F.lit(features.index(f) + 1) for f, *_ in deals]), F.col("deal") + 1)
    dealt = asked.join(values, "_from").select("_n", "deal", F.element_at("_values", at).alias("_value"))
    plain = numbered.select("_n", F.lit(-1).alias("deal"), F.lit(None).cast("double").alias("_value"))
    stacked = numbered.join(dealt.unionByName(plain), "_n")
    kinds = dict(rows.dtypes)
    for k, feature in enumerate(features):
        mine = [i for i, d in enumerate(deals) if d[0] == feature]
        stacked = stacked.withColumn(feature, F.when(F.col("deal").isin(mine), F.col("_value").cast(kinds[feature])).otherwise(F.col(feature)))
    scored = predict(model, stacked.select("deal", *rows.columns), "_score")
    # One row per deal.
    quality = ranking_quality(scored, "_score", label, ["deal"]).select("deal", "pr_auc")
    names = rows.sparkSession.createDataFrame([(k, d[0]) for k, d in enumerate(deals)], "deal int, feature string")
    whole = quality.where("deal = -1").select(F.col("pr_auc").alias("_whole"), F.lit(1).alias("_one"))
    dropped = quality.join(F.broadcast(names), "deal").withColumn("_one", F.lit(1)).join(F.broadcast(whole), "_one")
    return dropped.groupBy("feature").agg(F.avg(F.col("_whole") - F.col("pr_auc")).alias("pr_auc_drop"))


def reload_difference(model: PipelineModel, path: str, rows: DataFrame, ident: Sequence[str]) -> float:
    """Saves the model, loads it back and returns the largest difference in its predictions."""
    model.write().overwrite().save(path)
    again = PipelineModel.load(path)
    before = predict(model, rows, "_a").select(*ident, "_a")
    after = predict(again, rows, "_b").select(*ident, "_b")
    return before.join(after, list(ident)).agg(F.max(F.abs(F.col("_a") - F.col("_b")))).first()[0]


def population_matches(rows: DataFrame, reported: Mapping[date, int]) -> None:
    """The replication gate's first half: snapshot populations equal the reported ones (one row per snapshot)."""
    found = {r[0]: r[1] for r in rows.groupBy("snapshot_date").agg(F.count("*")).collect()}
    if found != dict(reported):
        raise ValueError(f"population differs: {found} is not {dict(reported)}")


def binned(value: Column, edges: Sequence[float]) -> Column:
    """The right-closed bin (edge, next edge] as text; null outside."""
    out = F.lit(None).cast("string")
    for low, high in zip(edges, edges[1:]):
        out = F.when((value > low) & (value <= high), F.lit(f"({low:g}, {high:g}]")).otherwise(out)
    return out


def bucket_rates(rows: DataFrame, column: str, edges: Sequence[float], label: str) -> DataFrame:
    """How often the label is 1 in each bin."""
    return rows.withColumn("bucket", binned(F.col(column), edges)).where("bucket IS NOT NULL").groupBy("bucket").agg(
        F.count("*").alias("customers"), F.avg(label).alias("rate"))
