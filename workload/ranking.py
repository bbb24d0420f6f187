"""Category ranking per customer and snapshot, its metrics and diagnostics; orders by priority are the categories."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tidemark.operators import metrics
from tidemark.plans import category as cat
from tidemark.plans import features as feat
from workload import bankview as bank
from workload.registry import query
from workload.tables import PRIORITIES, read

HORIZON = 180
CUTS = (date(1998, 1, 1), date(1999, 7, 1))
CUT_SQL = "snap AS (SELECT unnest([{}]) AS t)".format(", ".join(f"DATE '{c}'" for c in CUTS))
CATS_SQL = "cats AS (SELECT unnest([{}]) AS category)".format(", ".join(f"'{c}'" for c in PRIORITIES))


def _window_sql(prefix, w):
    return (f"coalesce(sum(CAST(usd AS DECIMAL(18,6))) FILTER (WHERE age <= {w}), 0) AS {prefix}spend_usd_{w}d, "
            f"count(*) FILTER (WHERE age <= {w}) AS {prefix}txn_count_{w}d")


FEATURES_SQL = bank.sql("txn", "act") + f""", {CUT_SQL}, {CATS_SQL},
    past AS (SELECT act.*, t, date_diff('day', day, t) AS age FROM act, snap WHERE day < t AND date_diff('day', day, t) <= 365),
    pop AS (SELECT DISTINCT customer_id, t FROM act, snap WHERE date_diff('day', day, t) <= 365 AND date_diff('day', t, day) < {HORIZON}),
    agg AS (SELECT customer_id, t, category, {', '.join(_window_sql('', w) for w in cat.WINDOWS)}, count(*) FILTER (WHERE age > 30 AND age <= 90) AS p60,
        min(age) AS days_since_last_txn, avg(usd) FILTER (WHERE age <= 180) AS avg_txn_usd_180d FROM past GROUP BY ALL),
    cu AS (SELECT customer_id, t, {', '.join(_window_sql('cust_', w) for w in cat.WINDOWS)}, min(age) AS cust_days_since_last_txn,
        count(DISTINCT category) FILTER (WHERE age <= 180) AS cust_n_categories_180d FROM past GROUP BY ALL),
    popular AS (SELECT t, category, count(*) / sum(count(*)) OVER (PARTITION BY t) AS global_count_share_90d FROM past WHERE age <= 90 GROUP BY t, category),
    f AS (SELECT pop.customer_id, pop.t AS snapshot_date, cats.category,
        {', '.join(f"CAST(coalesce(a.spend_usd_{w}d, 0) AS DOUBLE) AS spend_usd_{w}d, coalesce(a.txn_count_{w}d, 0) AS txn_count_{w}d, "
                   f"coalesce(CAST(a.spend_usd_{w}d AS DOUBLE) / nullif(CAST(cu.cust_spend_usd_{w}d AS DOUBLE), 0), 0) AS spend_share_{w}d, "
                   f"coalesce(a.txn_count_{w}d / nullif(cu.cust_txn_count_{w}d, 0), 0) AS count_share_{w}d, coalesce(cust_txn_count_{w}d, 0) AS cust_txn_count_{w}d" for w in cat.WINDOWS)},
        a.days_since_last_txn, a.avg_txn_usd_180d, coalesce(a.txn_count_30d, 0) / 30.0 - coalesce(a.p60, 0) / 60.0 AS count_trend_30d_vs_prior60d,
        cu.cust_days_since_last_txn, coalesce(cu.cust_n_categories_180d, 0) AS cust_n_categories_180d, global_count_share_90d
      FROM pop CROSS JOIN cats LEFT JOIN agg a ON a.customer_id = pop.customer_id AND a.t = pop.t AND a.category = cats.category
      LEFT JOIN cu ON cu.customer_id = pop.customer_id AND cu.t = pop.t LEFT JOIN popular p ON p.t = pop.t AND p.category = cats.category)"""
COUNTS = ["txn_count_30d", "txn_count_90d", "txn_count_180d", "cust_txn_count_90d", "days_since_last_txn", "cust_days_since_last_txn", "cust_n_categories_180d"]
REALS = ["spend_usd_30d", "spend_usd_90d", "spend_usd_180d", "spend_share_30d", "spend_share_90d", "spend_share_180d", "count_share_90d",
         "avg_txn_usd_180d", "count_trend_30d_vs_prior60d", "global_count_share_90d"]


def per_day(spark, sf_dir):
    return cat.daily_spend(bank.spend(spark, sf_dir))


@query(f"""{FEATURES_SQL} SELECT customer_id, snapshot_date, category, {', '.join(COUNTS)}, {', '.join(f'round({c}, 4) AS {c}' for c in REALS)} FROM f""")
def category_features(spark, sf_dir):
    """The customer x snapshot x category grid with windows, shares, trends and popularity."""
    rows = cat.category_features(per_day(spark, sf_dir), CUTS, PRIORITIES, HORIZON)
    return rows.select(*cat.GROUP, "category", *COUNTS, *[F.round(c, 4).alias(c) for c in REALS])


LABELS_SQL = FEATURES_SQL + f""",
    ahead AS (SELECT customer_id, t, category, sum(CAST(usd AS DECIMAL(18,6))) AS usd, count(*) AS n FROM act, snap
        WHERE day >= t AND date_diff('day', t, day) < {HORIZON} GROUP BY ALL),
    l AS (SELECT f.customer_id, f.snapshot_date, f.category, CAST(coalesce(a.usd, 0) AS DOUBLE) AS fut_spend_usd, coalesce(a.n, 0) AS fut_txn_count,
        coalesce(CAST(a.usd AS DOUBLE) / nullif(CAST(sum(a.usd) OVER g AS DOUBLE), 0), 0) AS fut_spend_share, coalesce(a.n / nullif(sum(a.n) OVER g, 0), 0) AS fut_count_share
        FROM f LEFT JOIN ahead a ON a.customer_id = f.customer_id AND a.t = f.snapshot_date AND a.category = f.category
        WINDOW g AS (PARTITION BY f.customer_id, f.snapshot_date)),
    rel AS (SELECT *, CAST(fut_txn_count > 0 AS INT) AS rel_binary, least(fut_txn_count, 2) AS rel_count, least(fut_txn_count, 3) AS rel_fine,
        CASE WHEN fut_txn_count = 0 THEN 0 WHEN fut_spend_share < 1/3 THEN 1 WHEN fut_spend_share < 2/3 THEN 2 ELSE 3 END AS rel_spend_share FROM l)"""


def labels(spark, sf_dir):
    days = per_day(spark, sf_dir)
    features = cat.category_features(days, CUTS, PRIORITIES, HORIZON)
    return cat.graded(cat.category_labels(features, days, CUTS, HORIZON))


@query(f"""{LABELS_SQL} SELECT customer_id, snapshot_date, category, round(fut_spend_usd, 4) AS fut_spend_usd, fut_txn_count, round(fut_spend_share, 6) AS fut_spend_share,
    round(fut_count_share, 6) AS fut_count_share, rel_binary, rel_count, rel_fine, rel_spend_share FROM rel""")
def category_labels(spark, sf_dir):
    """F10, H08, L16, L17."""
    out = labels(spark, sf_dir)
    return out.withColumn("fut_spend_usd", F.round("fut_spend_usd", 4)).withColumns({c: F.round(c, 6) for c in ("fut_spend_share", "fut_count_share")})


EVAL_SQL = LABELS_SQL + """,
    live AS (SELECT customer_id, snapshot_date FROM rel GROUP BY ALL HAVING sum(rel_binary) > 0),
    ev AS (SELECT f.*, rel_binary, rel_count, rel_spend_share, fut_txn_count, fut_spend_usd,
        row_number() OVER (PARTITION BY f.customer_id, f.snapshot_date ORDER BY f.spend_usd_90d DESC, f.spend_usd_180d DESC, global_count_share_90d DESC NULLS LAST, f.category) AS rank_spend90,
        row_number() OVER (PARTITION BY f.customer_id, f.snapshot_date ORDER BY global_count_share_90d DESC NULLS LAST, f.category) AS rank_popularity
        FROM f JOIN rel USING (customer_id, snapshot_date, category) JOIN live USING (customer_id, snapshot_date))"""


def evaluation(spark, sf_dir):
    return cat.evaluation_rows(per_day(spark, sf_dir), CUTS, PRIORITIES, HORIZON)


@query(f"{EVAL_SQL} SELECT customer_id, snapshot_date, category, rank_spend90, rank_popularity FROM ev")
def category_rankings(spark, sf_dir):
    """Two deterministic orders over the active groups."""
    return evaluation(spark, sf_dir).select(*cat.GROUP, "category", "rank_spend90", "rank_popularity")


def _ndcg_sql(rank, extra=""):
    return f"""i AS (SELECT *, row_number() OVER (PARTITION BY customer_id, snapshot_date{extra} ORDER BY rel DESC, category) AS ideal FROM r),
    g AS (SELECT customer_id, snapshot_date{extra}, sum(CASE WHEN {rank} <= 3 THEN (pow(2, rel) - 1) / log2({rank} + 1) ELSE 0 END)
            / sum(CASE WHEN ideal <= 3 THEN (pow(2, rel) - 1) / log2(ideal + 1) ELSE 0 END) AS ndcg,
          count(*) FILTER (WHERE rel > 0 AND {rank} = 1) AS p1, count(*) FILTER (WHERE rel > 0 AND {rank} <= 3) / count(*) FILTER (WHERE rel > 0) AS recall,
          CAST(count(*) FILTER (WHERE rel > 0 AND {rank} <= 3) > 0 AS INT) AS hit FROM i GROUP BY ALL)"""


MEANS_SQL = "round(avg(ndcg), 6) AS ndcg, round(avg(p1), 6) AS precision_at_1, round(avg(recall), 6) AS recall, round(avg(hit), 6) AS hit_rate"


def rounded(df, *keys):
    return df.select(*keys, *[F.round(c, 6).alias(c) for c in ("ndcg", "precision_at_1", "recall", "hit_rate")], *[c for c in df.columns if c == "groups"])


@query(f"""{EVAL_SQL}, r AS (SELECT customer_id, snapshot_date, category, rank_spend90 AS k, rel_count AS rel FROM ev), {_ndcg_sql('k')}
    SELECT snapshot_date, {MEANS_SQL}, count(*) AS groups FROM g GROUP BY 1""")
def ranking_quality(spark, sf_dir):
    """NDCG@3, precision@1, recall@3 and hit rate@3 per snapshot."""
    return rounded(metrics.mean_ranking(evaluation(spark, sf_dir), cat.GROUP, "rank_spend90", "rel_count", "category", keys=["snapshot_date"]), "snapshot_date")


@query(f"""{EVAL_SQL}, d AS (SELECT customer_id, snapshot_date, category, rel_count AS rel, draw,
        CAST('0x' || substr(md5(customer_id || ':' || snapshot_date || ':' || category || ':' || draw), 1, 8) AS BIGINT) / 4294967296.0 AS u
        FROM ev, (SELECT unnest(range(20)) AS draw)),
    r AS (SELECT *, row_number() OVER (PARTITION BY customer_id, snapshot_date, draw ORDER BY u, category) AS k FROM d), {_ndcg_sql('k', ', draw')},
    m AS (SELECT draw, avg(ndcg) AS ndcg, avg(p1) AS p1, avg(recall) AS recall, avg(hit) AS hit FROM g GROUP BY 1)
    SELECT {MEANS_SQL} FROM m""")
def random_order_expectation(spark, sf_dir):
    """M07."""
    return rounded(metrics.random_expectation(evaluation(spark, sf_dir), cat.GROUP, "rel_count", "category", draws=20))


@query(f"""{EVAL_SQL}, b AS (SELECT unnest([{', '.join(map(str, cat.BETAS))}]::DOUBLE[]) AS beta),
    s AS (SELECT ev.*, beta, txn_count_180d + beta * coalesce(global_count_share_90d, 0) AS score FROM ev, b),
    r AS (SELECT customer_id, snapshot_date, beta, category, rel_count AS rel, row_number() OVER (PARTITION BY customer_id, snapshot_date, beta
        ORDER BY score DESC, global_count_share_90d DESC NULLS LAST, category) AS k FROM s), {_ndcg_sql('k', ', beta')}
    SELECT beta, round(avg(ndcg), 6) AS ndcg FROM g GROUP BY 1""")
def popularity_blend_curve(spark, sf_dir):
    """L19."""
    return cat.blend_curve(evaluation(spark, sf_dir), "rel_count").withColumn("ndcg", F.round("ndcg", 6))


@query(f"""{EVAL_SQL}, b AS (SELECT unnest([{', '.join(map(str, cat.BETAS))}]::DOUBLE[]) AS beta),
    s AS (SELECT ev.*, beta, txn_count_180d + beta * coalesce(global_count_share_90d, 0) AS score FROM ev, b),
    r AS (SELECT customer_id, snapshot_date, beta, category, rel_count AS rel, row_number() OVER (PARTITION BY customer_id, snapshot_date, beta
        ORDER BY score DESC, global_count_share_90d DESC NULLS LAST, category) AS k FROM s), {_ndcg_sql('k', ', beta')},
    c AS (SELECT beta, avg(ndcg) FILTER (WHERE snapshot_date < DATE '{CUTS[-1]}') AS tuning, avg(ndcg) FILTER (WHERE snapshot_date >= DATE '{CUTS[-1]}') AS ndcg FROM g GROUP BY 1)
    SELECT beta, round(tuning, 6) AS tuning_ndcg, round(ndcg, 6) AS ndcg FROM c ORDER BY round(tuning, 9) DESC, beta LIMIT 1""")
def tuned_popularity_blend(spark, sf_dir):
    """The blend tuned on all snapshots but the last, and what it gives there."""
    out = cat.tuned_blend(evaluation(spark, sf_dir), F.col("snapshot_date") < F.lit(CUTS[-1]))
    return out.select("beta", *(F.round(c, 6).alias(c) for c in ("tuning_ndcg", "ndcg")))


@query(f"""{EVAL_SQL}, r AS (SELECT customer_id, snapshot_date, category, rank_spend90, rank_popularity, rel_count AS rel FROM ev),
    i AS (SELECT *, row_number() OVER (PARTITION BY customer_id, snapshot_date ORDER BY rel DESC, category) AS ideal FROM r),
    g AS (SELECT customer_id, snapshot_date, sum(CASE WHEN rank_spend90 <= 3 THEN (pow(2, rel) - 1) / log2(rank_spend90 + 1) ELSE 0 END)
          / sum(CASE WHEN ideal <= 3 THEN (pow(2, rel) - 1) / log2(ideal + 1) ELSE 0 END)
          - sum(CASE WHEN rank_popularity <= 3 THEN (pow(2, rel) - 1) / log2(rank_popularity + 1) ELSE 0 END)
          / sum(CASE WHEN ideal <= 3 THEN (pow(2, rel) - 1) / log2(ideal + 1) ELSE 0 END) AS d FROM i GROUP BY ALL)
    SELECT round(avg(d), 6) AS mean, round(avg(d) - 1.96 * stddev_samp(d) / sqrt(count(*)), 6) AS low,
      round(avg(d) + 1.96 * stddev_samp(d) / sqrt(count(*)), 6) AS high, count(*) AS groups FROM g""")
def paired_ranking_difference(spark, sf_dir):
    """Own spend against popularity, with a 95 % interval."""
    rows = evaluation(spark, sf_dir)
    one = metrics.ranked_groups(rows, cat.GROUP, "rank_spend90", "rel_count", "category").select(*cat.GROUP, F.col("ndcg").alias("a"))
    two = metrics.ranked_groups(rows, cat.GROUP, "rank_popularity", "rel_count", "category").select(*cat.GROUP, F.col("ndcg").alias("b"))
    out = metrics.mean_difference(one.join(two, cat.GROUP), "a", "b")
    return out.select(*[F.round(c, 6).alias(c) for c in ("mean", "low", "high")], "groups")


@query(f"""{EVAL_SQL} SELECT category, round(avg(rel_binary) FILTER (WHERE txn_count_90d > 0), 6) AS p_given_past, round(avg(rel_binary), 6) AS p_base,
    round(avg(rel_binary) FILTER (WHERE txn_count_90d > 0) / avg(rel_binary), 6) AS lift FROM ev GROUP BY 1""")
def category_lift(spark, sf_dir):
    """M08."""
    out = cat.lift(evaluation(spark, sf_dir))
    return out.select("category", *[F.round(c, 6).alias(c) for c in ("p_given_past", "p_base", "lift")])


@query(f"""{EVAL_SQL}, h AS (SELECT * FROM ev WHERE cust_txn_count_90d > 0),
    p AS (SELECT customer_id, snapshot_date, category AS past FROM (SELECT *, row_number() OVER (PARTITION BY customer_id, snapshot_date ORDER BY txn_count_90d DESC, global_count_share_90d DESC NULLS LAST, category) AS k FROM h) WHERE k = 1),
    a AS (SELECT customer_id, snapshot_date, category AS ahead FROM (SELECT *, row_number() OVER (PARTITION BY customer_id, snapshot_date ORDER BY fut_txn_count DESC, global_count_share_90d DESC NULLS LAST, category) AS k FROM h) WHERE k = 1),
    t AS (SELECT past, ahead FROM p JOIN a USING (customer_id, snapshot_date)),
    mp AS (SELECT past AS c, count(*) AS n FROM t GROUP BY 1), ma AS (SELECT ahead AS c, count(*) AS n FROM t GROUP BY 1)
    SELECT (SELECT count(*) FROM t) AS groups, round((SELECT avg(CAST(past = ahead AS INT)) FROM t), 6) AS persistence_observed,
      round(sum(mp.n * ma.n) / pow((SELECT count(*) FROM t), 2), 6) AS persistence_if_independent FROM mp JOIN ma USING (c)""")
def top_category_persistence(spark, sf_dir):
    """M08, G20."""
    out = cat.persistence(evaluation(spark, sf_dir))
    return out.select("groups", *[F.round(c, 6).alias(c) for c in ("persistence_observed", "persistence_if_independent")])


@query(f"""{bank.sql('txn', 'act')},
    a AS (SELECT customer_id, row_number() OVER (ORDER BY md5('customer:shuffle:' || id), id) AS k FROM act),
    b AS (SELECT category, row_number() OVER (ORDER BY md5('category:shuffle:' || id), id) AS k FROM act),
    x AS (SELECT 'observed' AS data, customer_id, category FROM act UNION ALL SELECT 'shuffled', customer_id, category FROM a JOIN b USING (k)),
    n AS (SELECT data, customer_id, category, count(*) AS n FROM x GROUP BY ALL), t AS (SELECT data, customer_id, max(n) / sum(n) AS s FROM n GROUP BY ALL HAVING sum(n) >= 5)
    SELECT data, count(*) AS customers, round(avg(s), 6) AS mean_top_share FROM t GROUP BY 1""")
def shuffled_null_model(spark, sf_dir):
    """Concentration observed and with categories dealt out at random over the whole table."""
    out = cat.null_model(bank.spend(spark, sf_dir), "transaction_id", 5)
    return out.withColumn("mean_top_share", F.round("mean_top_share", 6))


@query(f"""{LABELS_SQL}, g AS (SELECT customer_id, snapshot_date, count(*) FILTER (WHERE fut_txn_count > 0) AS k, count(*) AS c FROM rel GROUP BY ALL)
    SELECT count(*) AS groups, round(avg(CAST(k > 0 AS INT)), 6) AS share_active, round(avg(k) FILTER (WHERE k > 0), 6) AS mean_relevant,
      round(1 - sum(k) / sum(c), 6) AS sparsity_all, round(1 - sum(k) FILTER (WHERE k > 0) / sum(c) FILTER (WHERE k > 0), 6) AS sparsity_active,
      {', '.join(f"round((SELECT count(*) FILTER (WHERE fut_txn_count {op} {c}) / count(*) FROM rel WHERE fut_txn_count > 0), 6) AS positive_{c}_txn" for c, op in ((1, '='), (2, '='), (3, '='), (4, '>=')))} FROM g""")
def target_statistics(spark, sf_dir):
    """M10."""
    out = cat.target_statistics(labels(spark, sf_dir))
    return out.select("groups", *[F.round(c, 6).alias(c) for c in out.columns if c != "groups"])


@query(f"""{LABELS_SQL}, m AS (SELECT customer_id, snapshot_date FROM rel GROUP BY ALL HAVING sum(rel_binary) >= 2),
    tops AS (SELECT customer_id, snapshot_date, max({{'v': fut_spend_usd, 'c': category}}).c AS by_spend, max({{'v': fut_txn_count, 'c': category}}).c AS by_count,
        max(fut_txn_count) AS most FROM rel JOIN m USING (customer_id, snapshot_date) WHERE rel_binary = 1 GROUP BY ALL),
    dom AS (SELECT m.customer_id, m.snapshot_date, max(usd) / sum(usd) AS s FROM m JOIN act a ON a.customer_id = m.customer_id AND a.day >= snapshot_date
        AND date_diff('day', snapshot_date, a.day) < {HORIZON} GROUP BY ALL)
    SELECT count(*) AS groups, round(avg(CAST(by_spend = by_count AS INT)), 6) AS share_same_top, round(avg(CAST(most = 1 AS INT)), 6) AS share_single_txn,
      round((SELECT median(s) FROM dom), 6) AS median_largest_share FROM tops""")
def target_stability(spark, sf_dir):
    """M16."""
    out = cat.target_stability(labels(spark, sf_dir), bank.spend(spark, sf_dir), CUTS, HORIZON)
    return out.select("groups", *[F.round(c, 6).alias(c) for c in ("share_same_top", "share_single_txn", "median_largest_share")])


@query("""WITH e AS (SELECT CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS z FROM orders),
    d AS (SELECT unnest(generate_series(date_trunc('year', a), date_trunc('month', z), INTERVAL 3 MONTH))::DATE AS snapshot_date, a, z FROM e),
    p AS (SELECT snapshot_date, CASE WHEN snapshot_date <= DATE '1998-12-31' THEN 'train' WHEN snapshot_date <= DATE '1999-12-31' THEN 'validation' ELSE 'test' END AS split,
      snapshot_date + 95 AS label_window_end FROM d WHERE date_diff('day', a, snapshot_date) >= 180 AND snapshot_date + 95 <= z)
    SELECT *, EXISTS (SELECT 1 FROM p q WHERE q.snapshot_date > p.snapshot_date AND q.split <> p.split AND p.label_window_end > q.snapshot_date) AS reaches_into_next FROM p""")
def snapshot_plan(spark, sf_dir):
    """Quarter starts with full history and label window, split chronologically; a window of 95 days reaches into the next quarter."""
    return feat.snapshot_plan(read(spark, sf_dir, "orders", "o_orderdate"), "o_orderdate", 95, 180, 3, date(1998, 12, 31), date(1999, 12, 31))
