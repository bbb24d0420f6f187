"""Ranking spending categories per customer and snapshot: features, labels, rankings and their diagnostics."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.metrics import ranked_groups
from tidemark.operators.ordering import global_row_number
from tidemark.session import cut_lineage
from tidemark.operators.snapshots import AGE, SNAPSHOT, around, between_ages, future, history, sum_if, within

WINDOWS = (30, 90, 180)
LOOKBACK_DAYS = 365
GROUP = ["customer_id", SNAPSHOT]
# The blend's tuning grid; the last one is popularity with history only breaking ties.
BETAS = (0.0, 0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 1e9)


def daily_spend(spend: DataFrame) -> DataFrame:
    """customer_id, ts, category, amount_usd -> counts and exact sums per day."""
    usd = F.col("amount_usd").cast("decimal(18,6)")
    return spend.groupBy("customer_id", F.to_date("ts").alias("day"), "category").agg(
        F.count("*").alias("n"), F.sum(usd).alias("usd"), F.count("amount_usd").alias("n_usd"), F.max("ts").alias("last_ts"))


def _windows(prefix: str = ""):
    out = []
    for w in WINDOWS:
        out.append(F.sum(F.when(within(w), F.col("usd"))).cast("double").alias(f"{prefix}spend_usd_{w}d"))
        out.append(sum_if(within(w), F.col("n")).alias(f"{prefix}txn_count_{w}d"))
    return out


def category_features(per_day: DataFrame, cutoffs: Sequence[date], categories: Sequence[str], horizon_days: int) -> DataFrame:
    """One row per customer active in [T - 365d, T + horizon), snapshot and category; features use days before T
    only. The grid is an explode over the configured categories."""
    past = history(per_day, "day", cutoffs, LOOKBACK_DAYS)
    people = around(per_day.select("customer_id", "day").distinct(), "day", cutoffs, LOOKBACK_DAYS, horizon_days)
    grid = people.select(*GROUP).distinct().select(*GROUP, F.explode(F.array(*[F.lit(c) for c in categories])).alias("category"))
    per_category = past.groupBy(*GROUP, "category").agg(
        *_windows(), sum_if(between_ages(30, 90), F.col("n")).alias("_prior60"), F.min(AGE).alias("days_since_last_txn"),
        F.sum(F.when(within(180), F.col("usd"))).cast("double").alias("_usd180"), sum_if(within(180), F.col("n_usd")).alias("_n180"),
        F.max("last_ts").alias("last_ts_used"))
    # the customer's totals come from the category rows: no second pass over the history
    customer = per_category.groupBy(*GROUP).agg(
        *[F.sum(F.col(f"spend_usd_{w}d").cast("decimal(18,6)")).cast("double").alias(f"cust_spend_usd_{w}d") for w in WINDOWS],
        *[F.sum(f"txn_count_{w}d").alias(f"cust_txn_count_{w}d") for w in WINDOWS],
        F.min("days_since_last_txn").alias("cust_days_since_last_txn"),
        F.count_if(F.col("txn_count_180d") > 0).alias("cust_n_categories_180d"))
    popular = popularity(per_day, cutoffs).where(F.col("category").isin(*categories))
    joined = (
        grid.join(per_category, [*GROUP, "category"], "left").join(customer, GROUP, "left")
        # at most one row per snapshot and configured category
        .join(F.broadcast(popular), [SNAPSHOT, "category"], "left"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    columns = []
    for w in WINDOWS:
        columns += [zero(f"spend_usd_{w}d").alias(f"spend_usd_{w}d"), zero(f"txn_count_{w}d").alias(f"txn_count_{w}d"),
                    share(f"spend_usd_{w}d", f"cust_spend_usd_{w}d").alias(f"spend_share_{w}d"),
                    share(f"txn_count_{w}d", f"cust_txn_count_{w}d").alias(f"count_share_{w}d"),
                    zero(f"cust_spend_usd_{w}d").alias(f"cust_spend_usd_{w}d"), zero(f"cust_txn_count_{w}d").alias(f"cust_txn_count_{w}d")]
    return joined.select(
        *GROUP, "category", *columns, "days_since_last_txn", F.try_divide(F.col("_usd180"), F.col("_n180")).alias("avg_txn_usd_180d"),
        (zero("txn_count_30d") / 30.0 - zero("_prior60") / 60.0).alias("count_trend_30d_vs_prior60d"),
        (share("spend_usd_30d", "cust_spend_usd_30d") - share("spend_usd_90d", "cust_spend_usd_90d")).alias("spend_share_trend_30d_vs_90d"),
        "cust_days_since_last_txn", zero("cust_n_categories_180d").alias("cust_n_categories_180d"), "global_count_share_90d", "last_ts_used")


def popularity(per_day: DataFrame, cutoffs: Sequence[date], days: int = 90) -> DataFrame:
    """Each category's share of all transactions in the days before T. The window runs over one row per
    category and snapshot."""
    counted = history(per_day, "day", cutoffs, days).groupBy(SNAPSHOT, "category").agg(F.sum("n").alias("_n"))
    share = F.col("_n") / F.sum("_n").over(Window.partitionBy(SNAPSHOT))
    return counted.select(SNAPSHOT, "category", share.alias("global_count_share_90d"))


def category_labels(features: DataFrame, per_day: DataFrame, cutoffs: Sequence[date], horizon_days: int) -> DataFrame:
    """What each candidate turned out to be in [T, T + horizon), with shares within the group."""
    ahead = future(per_day, "day", cutoffs, horizon_days).groupBy(*GROUP, "category").agg(
        F.sum("usd").cast("double").alias("fut_spend_usd"), F.sum("n").alias("fut_txn_count"))
    totals = ahead.groupBy(*GROUP).agg(F.sum(F.col("fut_spend_usd").cast("decimal(18,6)")).cast("double").alias("_usd"), F.sum("fut_txn_count").alias("_n"))
    joined = features.select(*GROUP, "category").join(ahead, [*GROUP, "category"], "left").join(totals, GROUP, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return joined.select(
        *GROUP, "category", zero(F.col("fut_spend_usd")).alias("fut_spend_usd"), zero(F.col("fut_txn_count")).alias("fut_txn_count"),
        zero(F.try_divide("fut_spend_usd", "_usd")).alias("fut_spend_share"), zero(F.try_divide("fut_txn_count", "_n")).alias("fut_count_share"))


def graded(labels: DataFrame) -> DataFrame:
    """Relevance as yes/no, as a count capped at 2 or 3, and as thirds of the future spend."""
    n, share = F.col("fut_txn_count"), F.col("fut_spend_share")
    thirds = F.when(n == 0, 0).when(share < 1 / 3, 1).when(share < 2 / 3, 2).otherwise(3)
    return labels.withColumns({
        "rel_binary": (n > 0).cast("int"), "rel_count": F.least(n, F.lit(2)).cast("int"),
        "rel_fine": F.least(n, F.lit(3)).cast("int"), "rel_spend_share": thirds})


def active_groups(rows: DataFrame, relevance: str = "rel_binary") -> DataFrame:
    """Rows of groups with anything relevant."""
    alive = rows.where(F.col(relevance) > 0).select(*GROUP).distinct()
    return rows.join(alive, GROUP, "left_semi")


def with_ranks(rows: DataFrame) -> DataFrame:
    """Two orders of each group's candidates: own spend (then longer history, popularity, name) and popularity."""
    group = Window.partitionBy(*GROUP)
    popular = [F.col("global_count_share_90d").desc(), F.col("category").asc()]
    own = [F.col("spend_usd_90d").desc(), F.col("spend_usd_180d").desc(), *popular]
    return rows.withColumns({"rank_spend90": F.row_number().over(group.orderBy(*own)),
                             "rank_popularity": F.row_number().over(group.orderBy(*popular))})


def evaluation_rows(per_day: DataFrame, cutoffs: Sequence[date], categories: Sequence[str], horizon_days: int) -> DataFrame:
    """Candidates of active groups with features, relevance and both rankings."""
    features = category_features(per_day, cutoffs, categories, horizon_days)
    labels = graded(category_labels(features, per_day, cutoffs, horizon_days))
    return with_ranks(active_groups(features.join(labels, [*GROUP, "category"])))


def blend_curve(rows: DataFrame, relevance: str, betas: Sequence[float] = BETAS, k: int = 3) -> DataFrame:
    """Mean NDCG@k per beta when ranking by own count + beta x popularity."""
    each = rows.select(*GROUP, "category", "txn_count_180d", "global_count_share_90d", relevance,
                       F.explode(F.array(*[F.lit(float(b)) for b in betas])).alias("beta"))
    ranked = blend_rank(each, F.col("beta"), ["beta"])
    return ranked_groups(ranked, [*GROUP, "beta"], "rank_blend", relevance, "category", k).groupBy("beta").agg(F.avg("ndcg").alias("ndcg"))


def blend_rank(rows: DataFrame, beta, extra: Sequence[str] = ()) -> DataFrame:
    score = F.col("txn_count_180d") + beta * F.coalesce("global_count_share_90d", F.lit(0.0))
    order = Window.partitionBy(*GROUP, *extra).orderBy(score.desc(), F.col("global_count_share_90d").desc(), F.col("category").asc())
    return rows.withColumn("rank_blend", F.row_number().over(order))


def tuned_blend(rows: DataFrame, tuning: Column, relevance: str = "rel_count") -> DataFrame:
    """One row: the beta with the best NDCG on the tuning rows (to nine decimals; of equal ones the smallest), its NDCG there, and on all other rows."""
    best = blend_curve(rows.where(tuning), relevance).select(F.max(F.struct(F.round("ndcg", 9).alias("tuning_ndcg"), (-F.col("beta")).alias("low"))).alias("b"))
    chosen = best.select((-F.col("b.low")).alias("beta"), "b.tuning_ndcg")  # one row
    return blend_curve(rows.where(~tuning), relevance).join(F.broadcast(chosen), "beta").select("beta", "tuning_ndcg", "ndcg")


# ---- Diagnostics ----

def lift(rows: DataFrame) -> DataFrame:
    """Does use of a category in the 90 days before T raise its use after T?"""
    used = F.col("txn_count_90d") > 0
    given, base = F.avg(F.when(used, F.col("rel_binary"))), F.avg("rel_binary")
    return rows.groupBy("category").agg(given.alias("p_given_past"), base.alias("p_base"), F.try_divide(given, base).alias("lift"))


def persistence(rows: DataFrame) -> DataFrame:
    """How often the top past category is the top future one, against independent tops."""
    known = rows.where(F.col("cust_txn_count_90d") > 0)
    # ties: the more popular, then the earlier name
    top = lambda c: F.min_by("category", F.struct(-F.col(c), -F.coalesce("global_count_share_90d", F.lit(-1.0)), F.col("category")))
    tops = known.groupBy(*GROUP).agg(top("txn_count_90d").alias("past"), top("fut_txn_count").alias("ahead"))
    pairs = cut_lineage(tops.groupBy("past", "ahead").agg(F.count("*").alias("n")))  # at most categories squared rows, read three times
    margin = lambda c: pairs.groupBy(F.col(c).alias("category")).agg(F.sum("n").alias(f"n_{c}"))
    total = pairs.agg(F.sum("n").alias("groups"), F.sum(F.when(F.col("past") == F.col("ahead"), F.col("n"))).alias("same"), F.lit(0).alias("_all"))
    product = margin("past").join(margin("ahead"), "category").agg(
        F.sum(F.col("n_past").cast("double") * F.col("n_ahead")).alias("_product"), F.lit(0).alias("_all"))
    joined = total.join(F.broadcast(product), "_all")  # one row each
    return joined.select("groups", (F.coalesce("same", F.lit(0)) / F.col("groups")).alias("persistence_observed"),
                         (F.col("_product") / (F.col("groups").cast("double") * F.col("groups"))).alias("persistence_if_independent"))


def concentration(rows: DataFrame, min_count: int) -> DataFrame:
    """Mean share of each customer's top category, over customers with enough transactions."""
    counted = rows.groupBy("customer_id", "category").agg(F.count("*").alias("n"))
    tops = counted.groupBy("customer_id").agg((F.max("n") / F.sum("n")).alias("top_share"), F.sum("n").alias("_n"))
    return tops.where(F.col("_n") >= min_count).agg(F.count("*").alias("customers"), F.avg("top_share").alias("mean_top_share"))


def shuffled_categories(rows: DataFrame, ident: str, seed: str = "shuffle") -> DataFrame:
    """The same customers and categories, paired at random: both are numbered in independent hash orders and
    joined on the number."""
    mix = lambda tag: F.md5(F.concat_ws(":", F.lit(tag), F.lit(seed), F.col(ident).cast("string")))
    people = global_row_number(rows.select(ident, "customer_id").withColumn("_mix", mix("customer")), [F.col("_mix"), F.col(ident)])
    dealt = global_row_number(rows.select(ident, "category").withColumn("_mix", mix("category")), [F.col("_mix"), F.col(ident)])
    return people.select("position", "customer_id").join(dealt.select("position", "category"), "position").select("customer_id", "category")


def null_model(rows: DataFrame, ident: str, min_count: int = 20) -> DataFrame:
    """Observed concentration beside that of shuffled categories: equal values mean no customer-level signal."""
    observed = concentration(rows, min_count).withColumn("data", F.lit("observed"))
    random = concentration(shuffled_categories(rows, ident), min_count).withColumn("data", F.lit("shuffled"))
    return observed.unionByName(random)


def target_statistics(labels: DataFrame) -> DataFrame:
    """Activity and sparsity over all groups, and the mix of counts among positive rows."""
    n = F.col("fut_txn_count")
    groups = labels.groupBy(*GROUP).agg(
        F.count_if(n > 0).alias("k"), F.count("*").alias("candidates"),
        *[F.count_if(n == c).alias(f"c{c}") for c in (1, 2, 3)], F.count_if(n >= 4).alias("c4"))
    live = F.col("k") > 0
    sums = groups.agg(
        F.count("*").alias("groups"), F.avg(live.cast("int")).alias("share_active"), F.avg(F.when(live, F.col("k"))).alias("mean_relevant"),
        (1 - F.try_divide(F.sum("k"), F.sum("candidates"))).alias("sparsity_all"),
        (1 - F.try_divide(F.sum(F.when(live, F.col("k"))), F.sum(F.when(live, F.col("candidates"))))).alias("sparsity_active"),
        *[F.coalesce(F.try_divide(F.sum(f"c{c}"), F.sum("k")), F.lit(0.0)).alias(f"positive_{c}_txn") for c in (1, 2, 3, 4)])
    return sums


def target_stability(labels: DataFrame, spend: DataFrame, cutoffs: Sequence[date], horizon_days: int) -> DataFrame:
    """Groups with two or more future categories: do spend and count agree on the top one, how often has every
    category one transaction, and how much of the spend is one transaction (exact median)?"""
    from tidemark.operators.ordering import exact_quantiles

    positive = labels.where("fut_txn_count > 0")
    top = lambda c: F.max_by("category", F.struct(F.col(c), F.col("category")))
    tops = positive.groupBy(*GROUP).agg(F.count("*").alias("_k"), top("fut_spend_usd").alias("by_spend"), top("fut_txn_count").alias("by_count"),
                                        F.max("fut_txn_count").alias("most")).where("_k >= 2")
    usd = F.col("amount_usd").cast("decimal(18,6)")
    ahead = future(spend.withColumn("day", F.to_date("ts")), "day", cutoffs, horizon_days)
    largest = ahead.groupBy(*GROUP).agg(F.try_divide(F.max(usd).cast("double"), F.sum(usd).cast("double")).alias("share")).join(
        tops.select(*GROUP), GROUP, "left_semi")
    medians = exact_quantiles(largest, "share", {"median_largest_share": 0.5}).withColumn("_one", F.lit(1))
    shares = tops.agg(F.count("*").alias("groups"), F.avg((F.col("by_spend") == F.col("by_count")).cast("int")).alias("share_same_top"),
                      F.avg((F.col("most") == 1).cast("int")).alias("share_single_txn"), F.lit(1).alias("_one"))
    return shares.join(F.broadcast(medians), "_one", "left").drop("_one")  # one row each
