"""Snapshot features, scores, tiers, metrics and models over orders seen as transactions."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from tidemark.operators import gates, metrics, ordering, resampling
from tidemark.plans import features as feat
from tidemark.plans import models, scoring, serving
from tidemark.session import cut_lineage, ensure_checkpoint_dir
from tidemark.sources.readers import digital_daily
from workload import bankview as bank
from workload.registry import query
from workload.tables import read

ROUNDED = ("spend_usd_30d", "spend_usd_90d", "spend_usd_180d", "count_trend_30d_vs_prior60d", "count_ratio_90d_vs_prior90d", "txns_per_active_day_180d")
PLAIN = [c for c in feat.FEATURES if c not in ROUNDED]


@query(f"""{bank.SNAPSHOTS_SQL} SELECT customer_id, snapshot_date, {', '.join(PLAIN)},
    {', '.join(f'round({c}, 4) AS {c}' for c in ROUNDED)}, fut_txn_count, low_engagement_next_90d FROM rows_""")
def snapshot_features(spark, sf_dir):
    """26 features and the label per customer and snapshot."""
    rows = bank.snapshots(spark, sf_dir)
    return rows.select("customer_id", "snapshot_date", *PLAIN, *[F.round(c, 4).alias(c) for c in ROUNDED], "fut_txn_count", feat.TARGET)


@query(f"""{bank.SNAPSHOTS_SQL} SELECT count(*) FILTER (WHERE CAST(last_ts_used AS DATE) + CASE WHEN customer_id % 10 = 0 THEN 400 ELSE 0 END >= snapshot_date) AS leaking_rows,
    count(*) AS "rows" FROM rows_""")
def leakage_audit(spark, sf_dir):
    """Every tenth customer's rows are made to have seen events of 400 days later."""
    used = F.col("last_ts_used")
    return feat.leakage(bank.snapshots(spark, sf_dir).withColumn("last_ts_used", F.when(F.col("customer_id") % 10 == 0, used + F.expr("INTERVAL 400 DAYS")).otherwise(used)))


@query(f"""{bank.SNAPSHOTS_SQL} SELECT snapshot_date, count(*) AS customers, round(avg(low_engagement_next_90d), 6) AS prevalence FROM rows_ GROUP BY 1""")
def snapshot_prevalence(spark, sf_dir):
    """G34."""
    return feat.prevalence(bank.snapshots(spark, sf_dir)).withColumn("prevalence", F.round("prevalence", 6))


@query(f"""{bank.sql('line')}, {bank.SNAP_SQL},
    h AS (SELECT customer_id, t, count(*) FILTER (WHERE delivered) AS past, count(*) FILTER (WHERE flag <> 'N' AND shipped < t) AS opens,
          count(*) FILTER (WHERE flag = 'R' AND shipped < t) AS clicks FROM line, snap WHERE sent < t GROUP BY ALL)
    SELECT l.customer_id, l.t AS snapshot_date, flag AS send_channel, CAST(flag = 'R' AS INT) AS clicked, CAST(flag <> 'N' AS INT) AS opened,
      coalesce(past, 0) AS past_delivered, round(coalesce(clicks / nullif(past, 0), 0), 6) AS past_click_rate,
      round(coalesce(opens / nullif(past, 0), 0), 6) AS past_open_rate
    FROM (SELECT line.*, t FROM line, snap WHERE sent >= t AND date_diff('day', t, sent) < 90 AND delivered) l
    LEFT JOIN h ON h.customer_id = l.customer_id AND h.t = l.t""")
def click_history(spark, sf_dir):
    """L18, C23."""
    rows = feat.click_rows(bank.sends(spark, sf_dir), bank.CUTOFFS)
    return rows.withColumns({c: F.round(c, 6) for c in ("past_click_rate", "past_open_rate")})


@query(f"""{bank.sql('line')}, {bank.SNAP_SQL}, r AS (SELECT flag FROM line, snap WHERE sent >= t AND date_diff('day', t, sent) < 90 AND delivered)
    SELECT flag AS send_channel, count(*) AS sends, round(avg(CAST(flag = 'R' AS INT)), 6) AS click_rate, round(avg(CAST(flag <> 'N' AS INT)), 6) AS open_rate
    FROM r GROUP BY 1""")
def channel_click_rates(spark, sf_dir):
    """G38."""
    rates = models.channel_rates(feat.click_rows(bank.sends(spark, sf_dir), bank.CUTOFFS))
    return rates.withColumns({c: F.round(c, 6) for c in ("click_rate", "open_rate")})


@query("""SELECT user_id AS customer_id, CAST(ts AS DATE) AS day, count(*) AS events, count(*) FILTER (WHERE event_type = 'signup') AS logins
    FROM events WHERE user_id IS NOT NULL GROUP BY ALL""")
def daily_events_per_user(spark, sf_dir):
    """A09."""
    return digital_daily(read(spark, sf_dir, "events"), "user_id", "ts", F.col("event_type") == "signup")


# ---- Scores: how recently and how rarely a customer bought, as a number in [0, 1] ----

AS_OF = date(1999, 12, 31)
SCORE_SQL = """days_since_last_txn / 400.0 + 0.08 / (1 + txn_count_90d)"""
SCORED_SQL = bank.SNAPSHOTS_SQL + f""",
    judged AS (SELECT c.customer_id, r.customer_id IS NOT NULL AS by_model, {SCORE_SQL} AS score,
        CASE WHEN r.customer_id IS NOT NULL THEN NULL WHEN registered IS NULL THEN 'insufficient_data'
             WHEN date_diff('day', registered, DATE '2000-01-01') < 90 THEN 'insufficient_history_new_customer'
             ELSE 'no_eligible_txn_365d' END AS reason
        FROM cust c LEFT JOIN (SELECT * FROM rows_ WHERE snapshot_date = DATE '2000-01-01') r USING (customer_id)
        WHERE registered IS NULL OR registered < DATE '2000-01-01'),
    placed AS (SELECT *, CASE WHEN by_model THEN row_number() OVER (PARTITION BY by_model ORDER BY score DESC, customer_id) END AS place,
        count(*) FILTER (WHERE by_model) OVER () AS n FROM judged),
    scored AS (SELECT customer_id, DATE '1999-12-31' AS as_of_date, 'rule-v1' AS model_version, by_model AS model_eligible,
        CASE WHEN by_model THEN 'model' ELSE 'fallback' END AS scoring_source, CASE WHEN by_model THEN score END AS risk_score,
        CASE WHEN place <= ceil(0.2 * n) THEN 'high' WHEN place <= ceil(0.5 * n) THEN 'medium' WHEN by_model THEN 'low'
             WHEN reason = 'no_eligible_txn_365d' THEN 'high' WHEN reason = 'insufficient_history_new_customer' THEN 'new_customer' ELSE 'unknown' END AS risk_tier,
        reason AS reason_code FROM placed)"""


def rule_score(rows):
    return F.col("days_since_last_txn") / 400.0 + F.lit(0.08) / (1 + F.col("txn_count_90d"))


def scores(spark, sf_dir):
    rows = cut_lineage(bank.snapshots(spark, sf_dir, (feat.cutoff_for(AS_OF),), labels=False))  # features and scores read it
    return scoring.score_customers(bank.customers(spark, sf_dir), rows, rows.select("customer_id", rule_score(rows).alias("score")), AS_OF, "rule-v1")


@query(f"""{SCORED_SQL} SELECT customer_id, as_of_date, model_version, model_eligible, scoring_source, round(risk_score, 6) AS risk_score,
    risk_tier, reason_code FROM scored""")
def scored_customers(spark, sf_dir):
    """Model scores in tiers by global rank, fallbacks with a reason."""
    return scores(spark, sf_dir).withColumn("risk_score", F.round("risk_score", 6))


BROKEN_SQL = f"""{SCORED_SQL}, b AS (SELECT customer_id, as_of_date, model_eligible, reason_code, CASE WHEN customer_id % 31 = 0 THEN 'rule-v0' ELSE model_version END AS model_version,
    CASE WHEN customer_id % 7 = 0 THEN 'model' ELSE scoring_source END AS scoring_source, CASE WHEN customer_id % 11 = 0 THEN 1.5 ELSE risk_score END AS risk_score,
    CASE WHEN customer_id % 13 = 0 THEN 'unknown' ELSE risk_tier END AS risk_tier FROM scored),
    f AS (SELECT *, CASE reason_code WHEN 'no_eligible_txn_365d' THEN 'high' WHEN 'insufficient_history_new_customer' THEN 'new_customer' ELSE 'unknown' END AS expected FROM b),
    v AS (SELECT count(*) AS "rows", count(*) FILTER (WHERE model_eligible AND NOT risk_score BETWEEN 0 AND 1) AS model_score_not_probability,
      count(*) FILTER (WHERE model_eligible AND risk_tier NOT IN ('high', 'medium', 'low')) AS model_tier_or_reason,
      count(*) FILTER (WHERE NOT model_eligible AND risk_score IS NOT NULL) AS fallback_with_score, count(*) FILTER (WHERE NOT model_eligible AND risk_tier <> expected) AS fallback_tier_disagrees,
      count(*) FILTER (WHERE (scoring_source = 'model') <> model_eligible) AS source_disagrees, count(*) FILTER (WHERE model_version <> 'rule-v1') AS other_version FROM f)"""


def broken_scores(spark, sf_dir):
    """The scores with rules broken in some customers' rows: their source, score, tier or version."""
    hit = lambda n: F.col("customer_id") % n == 0
    return scores(spark, sf_dir).withColumns({
        "model_version": F.when(hit(31), "rule-v0").otherwise(F.col("model_version")), "scoring_source": F.when(hit(7), "model").otherwise(F.col("scoring_source")),
        "risk_score": F.when(hit(11), 1.5).otherwise(F.col("risk_score")), "risk_tier": F.when(hit(13), "unknown").otherwise(F.col("risk_tier"))})


@query(f"""{BROKEN_SQL} SELECT "rows", model_score_not_probability, model_tier_or_reason, fallback_with_score, fallback_tier_disagrees, source_disagrees,
    CAST((SELECT count(*) FROM scored WHERE customer_id % 17 = 0) AS BIGINT) AS repeated_customers FROM (SELECT * REPLACE ("rows" + (SELECT count(*) FROM scored WHERE customer_id % 17 = 0) AS "rows",
      model_score_not_probability + (SELECT count(*) FROM f WHERE customer_id % 17 = 0 AND model_eligible AND NOT risk_score BETWEEN 0 AND 1) AS model_score_not_probability,
      model_tier_or_reason + (SELECT count(*) FROM f WHERE customer_id % 17 = 0 AND model_eligible AND risk_tier NOT IN ('high', 'medium', 'low')) AS model_tier_or_reason,
      fallback_with_score + (SELECT count(*) FROM f WHERE customer_id % 17 = 0 AND NOT model_eligible AND risk_score IS NOT NULL) AS fallback_with_score,
      fallback_tier_disagrees + (SELECT count(*) FROM f WHERE customer_id % 17 = 0 AND NOT model_eligible AND risk_tier <> expected) AS fallback_tier_disagrees,
      source_disagrees + (SELECT count(*) FROM f WHERE customer_id % 17 = 0 AND (scoring_source = 'model') <> model_eligible) AS source_disagrees) FROM v)""")
def score_invariants(spark, sf_dir):
    """The rows that break each rule, with rules broken and every seventeenth customer's row repeated."""
    rows = broken_scores(spark, sf_dir)
    return scoring.invariant_violations(rows.union(rows.where("customer_id % 17 = 0")))


GATED = ("model_score_not_probability", "model_tier_or_reason", "fallback_with_score", "fallback_tier_disagrees", "source_disagrees")


@query(f"""{BROKEN_SQL}, m AS (SELECT unnest([{', '.join(f"{{'gate': 'invariant', 'subject': '{n}', 'n': {n}}}" for n in GATED)}, {{'gate': 'other_version', 'subject': 'rule-v1', 'n': other_version}},
      {{'gate': 'other_day', 'subject': '1999-12-31', 'n': 0}}]) AS g FROM v)
    SELECT g.gate AS gate, g.subject AS subject, CAST(g.n AS DOUBLE) AS measured, 0.0::DOUBLE AS allowed, CASE WHEN g.n > 0 THEN 'fail' ELSE 'ok' END AS status FROM m""")
def gated_scores(spark, sf_dir):
    """Publishing the broken scores; the job that writes them measures every rule, one model version and one day, and its verdicts are kept."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/scores-{uuid.uuid4().hex}"
    found = gates.write_through(broken_scores(spark, sf_dir), scoring.score_gates("rule-v1", AS_OF), lambda df: df.write.parquet(f"{folder}/scores"), f"{folder}/gates")
    return gates.as_report(spark, found).drop("checked_rows")


@query(f"{SCORED_SQL} SELECT scoring_source, risk_tier, reason_code, count(*) AS customers FROM scored GROUP BY ALL")
def scores_by_tier_and_reason(spark, sf_dir):
    """G33."""
    return scoring.counts_by(scores(spark, sf_dir))


@query(f"""{SCORED_SQL} SELECT count(*) AS customers, count(*) FILTER (WHERE model_eligible) AS model_eligible, round(avg(risk_score), 6) AS score_mean,
    {', '.join(f"round(quantile_cont(risk_score, {q}), 6) AS score_q{int(q * 100)}" for q in scoring.SUMMARY_QUANTILES)},
    round(min(risk_score) FILTER (WHERE model_eligible AND risk_tier = 'high'), 6) AS high_min_score,
    round(min(risk_score) FILTER (WHERE model_eligible AND risk_tier = 'medium'), 6) AS medium_min_score FROM scored""")
def score_summary(spark, sf_dir):
    """Totals, exact distributed quantiles and tier thresholds."""
    s = scoring.score_summary(scores(spark, sf_dir))
    names = ["score_mean", *[f"score_q{int(q * 100)}" for q in scoring.SUMMARY_QUANTILES], "high_min_score", "medium_min_score"]
    return s.select("customers", "model_eligible", *[F.round(n, 6).alias(n) for n in names])


@query(f"""{SCORED_SQL}, r AS (SELECT * REPLACE (CASE WHEN customer_id % 19 = 0 THEN NULL WHEN NOT model_eligible AND customer_id % 3 = 0 THEN 0.5 ELSE risk_score END AS risk_score) FROM scored),
    p AS (SELECT *, CASE WHEN model_eligible AND risk_score IS NULL THEN 'model row without a score' WHEN NOT model_eligible AND risk_score IS NOT NULL THEN 'fallback row with a score' END AS problem FROM r)
    SELECT 'CUST#' || customer_id AS "PK", 'ENGAGEMENT_RISK' AS "SK", problem, CASE WHEN problem IS NULL THEN model_version END AS model_version, CASE WHEN problem IS NULL THEN '1999-12-31' END AS as_of_date,
      CASE WHEN problem IS NULL THEN model_eligible END AS model_eligible, CASE WHEN problem IS NULL THEN scoring_source END AS scoring_source, CASE WHEN problem IS NULL THEN round(risk_score, 6) END AS risk_score,
      CASE WHEN problem IS NULL THEN risk_tier END AS risk_tier, CASE WHEN problem IS NULL THEN reason_code END AS reason_code FROM p""")
def risk_items(spark, sf_dir):
    """Key-value items of the score table, and the rows that cannot be one: some scores are missing, some fallbacks have one."""
    key = F.col("customer_id")
    rows = scores(spark, sf_dir).withColumn("risk_score", F.when(key % 19 == 0, None).when(~F.col("model_eligible") & (key % 3 == 0), 0.5).otherwise(F.col("risk_score")))
    good, bad = serving.risk_items(rows)
    return good.withColumns({"risk_score": F.round("risk_score", 6), "problem": F.lit(None).cast("string")}).unionByName(bad, allowMissingColumns=True)


@query(f"""{SCORED_SQL} SELECT customer_id, CASE WHEN scoring_source = 'model' THEN CASE risk_tier WHEN 'high' THEN 'retention' WHEN 'medium' THEN 'engagement'
      ELSE 'standard_loyalty' END WHEN reason_code = 'no_eligible_txn_365d' THEN 'win_back' WHEN reason_code = 'insufficient_history_new_customer' THEN 'onboarding'
      ELSE 'generic_loyalty' END AS strategy FROM scored""")
def loyalty_strategies(spark, sf_dir):
    """N16."""
    return serving.with_strategy(scores(spark, sf_dir)).select("customer_id", "strategy")


CATEGORY_OF = dict(zip(serving.NAMED_CATEGORIES, ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")))


@query(f"""{SCORED_SQL}, spent AS (SELECT customer_id, {', '.join(f"coalesce(sum(CAST(usd AS DECIMAL(18,2))) FILTER (WHERE category = '{p}'), 0) AS {c}" for c, p in CATEGORY_OF.items())}
      FROM act WHERE day > DATE '1999-10-02' AND day <= DATE '1999-12-31' GROUP BY 1),
    best AS (SELECT customer_id, CASE WHEN greatest({', '.join(CATEGORY_OF)}) <= 0 THEN NULL
      {' '.join(f"WHEN {c} = greatest({', '.join(CATEGORY_OF)}) THEN '{c}'" for c in sorted(CATEGORY_OF, reverse=True))} END AS best FROM spent),
    s AS (SELECT customer_id, CASE WHEN scoring_source = 'model' THEN CASE risk_tier WHEN 'high' THEN 'retention' WHEN 'medium' THEN 'engagement'
      ELSE 'standard_loyalty' END WHEN reason_code = 'no_eligible_txn_365d' THEN 'win_back' WHEN reason_code = 'insufficient_history_new_customer' THEN 'onboarding'
      ELSE 'generic_loyalty' END AS strategy FROM scored)
    SELECT s.customer_id, strategy, CASE WHEN strategy NOT IN ('onboarding', 'generic_loyalty') THEN best END AS category,
      CASE strategy WHEN 'onboarding' THEN 'demo-welcome-points' WHEN 'win_back' THEN 'demo-comeback-triple-points' WHEN 'retention' THEN 'demo-loyalty-double-points'
        WHEN 'engagement' THEN 'demo-extra-points' WHEN 'standard_loyalty' THEN 'demo-partner-benefits' ELSE 'demo-program-points' END AS offer_id,
      title AS offer_title, replace(said, '{{category}}', CASE WHEN strategy NOT IN ('onboarding', 'generic_loyalty') THEN coalesce(' de ' || word, '') ELSE '' END) AS offer_description, reason AS customer_safe_reason
    FROM s LEFT JOIN best b ON b.customer_id = s.customer_id
    JOIN (VALUES {', '.join(f"('{o[0]}', '{o[2]}', '{o[3]}', '{o[4]}', '{o[5]}')" for o in serving.OFFERS)}) o(of, lang, title, said, reason) ON of = strategy AND lang = CASE WHEN s.customer_id % 2 = 0 THEN 'es' ELSE 'pt' END
    LEFT JOIN (VALUES {', '.join(f"('{c}', 'es', '{es}'), ('{c}', 'pt', '{pt}')" for c, es, pt in serving.CATEGORY_WORDS)}) w(cat, wl, word) ON cat = best AND wl = lang""")
def next_benefits(spark, sf_dir):
    """The catalogue benefit in the customer's language, with the top category of the last 90 days in its text."""
    recent = bank.spend(spark, sf_dir).where((F.to_date("ts") > "1999-10-02") & (F.to_date("ts") <= "1999-12-31"))
    usd = F.col("amount_usd").cast("decimal(18,2)")
    spent = recent.groupBy("customer_id").agg(
        *[F.coalesce(F.sum(F.when(F.col("category") == p, usd)), F.lit(0)).cast("double").alias(f"spend_usd_{c}") for c, p in CATEGORY_OF.items()])
    risk = scores(spark, sf_dir).join(spent, "customer_id", "left")
    language = F.when(F.col("customer_id") % 2 == 0, "es").otherwise("pt")
    return serving.benefits(risk.withColumn("language", language)).select("customer_id", "strategy", "category", "offer_id", "offer_title", "offer_description", "customer_safe_reason")


# ---- Metrics ----

LABELLED_SQL = f"""{bank.SNAPSHOTS_SQL}, m AS (SELECT customer_id, snapshot_date, low_engagement_next_90d AS y, days_since_last_txn AS recency,
    -txn_count_90d AS frequency, {SCORE_SQL} AS s, customer_id || ':' || snapshot_date AS id FROM rows_)"""


def labelled(spark, sf_dir):
    rows = bank.snapshots(spark, sf_dir)
    return rows.select("customer_id", "snapshot_date", F.col(feat.TARGET).alias("y"), "days_since_last_txn", "txn_count_90d", "txn_count_180d",
                       "fut_txn_count", rule_score(rows).alias("s"),
                       F.concat_ws(":", F.col("customer_id").cast("string"), F.col("snapshot_date").cast("string")).alias("id"))


@query(f"""{LABELLED_SQL}, g AS (SELECT snapshot_date, s, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS n FROM m GROUP BY ALL),
    r AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM g WINDOW w AS (PARTITION BY snapshot_date ORDER BY s DESC))
    SELECT snapshot_date, round(sum(n * (tp - p / 2.0)) / (sum(p) * sum(n)), 6) AS roc_auc, round(sum(p * tp / (tp + fp)) / sum(p), 6) AS pr_auc,
      CAST(sum(p) AS BIGINT) AS positives, CAST(sum(p) + sum(n) AS BIGINT) AS "rows" FROM r GROUP BY 1""")
def auc_and_average_precision(spark, sf_dir):
    """Per snapshot, from counted scores and running totals."""
    out = metrics.ranking_quality(labelled(spark, sf_dir), "s", "y", ["snapshot_date"])
    return out.select("snapshot_date", F.round("roc_auc", 6).alias("roc_auc"), F.round("pr_auc", 6).alias("pr_auc"), "positives", "rows")


F1_SQL = """g AS (SELECT snapshot_date, s, count(*) FILTER (WHERE y = 1) AS p, count(*) AS k FROM m GROUP BY ALL),
    r AS (SELECT snapshot_date, s, sum(p) OVER w AS tp, sum(k) OVER w AS taken, sum(p) OVER (PARTITION BY snapshot_date) AS pos FROM g
          WINDOW w AS (PARTITION BY snapshot_date ORDER BY s DESC)),
    b AS (SELECT *, round(2.0 * tp / (taken + pos), 12) AS f1 FROM r),
    t AS (SELECT snapshot_date, s AS threshold, f1 FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_date ORDER BY f1 DESC, s) AS k FROM b) WHERE k = 1)"""


@query(f"{LABELLED_SQL}, {F1_SQL} SELECT snapshot_date, round(threshold, 6) AS threshold, round(f1, 6) AS f1 FROM t")
def best_f1_thresholds(spark, sf_dir):
    """M03."""
    out = metrics.best_f1_threshold(labelled(spark, sf_dir), "s", "y", ["snapshot_date"])
    return out.select("snapshot_date", F.round("threshold", 6).alias("threshold"), F.round("f1", 6).alias("f1"))


@query(f"""{LABELLED_SQL}, {F1_SQL}, chosen AS (SELECT threshold FROM t WHERE snapshot_date = DATE '1999-01-01'),
    c AS (SELECT snapshot_date, count(*) FILTER (WHERE s >= threshold AND y = 1) AS tp, count(*) FILTER (WHERE s >= threshold AND y = 0) AS fp,
      count(*) FILTER (WHERE s < threshold AND y = 1) AS fn, count(*) FILTER (WHERE s < threshold AND y = 0) AS tn FROM m, chosen GROUP BY 1)
    SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
      round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c WHERE snapshot_date = DATE '2000-01-01'""")
def frozen_threshold_confusion(spark, sf_dir):
    """The threshold is chosen on one snapshot and applied to the next."""
    rows = labelled(spark, sf_dir)
    chosen = metrics.best_f1_threshold(rows.where("snapshot_date = '1999-01-01'"), "s", "y").select("threshold", F.lit(1).alias("one"))
    later = rows.where("snapshot_date = '2000-01-01'").withColumn("one", F.lit(1)).join(F.broadcast(chosen), "one")  # a single row
    out = metrics.confusion(later, F.col("s") >= F.col("threshold"), "y", ["snapshot_date"])
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(f"""{LABELLED_SQL}, o AS (SELECT y, row_number() OVER (ORDER BY s DESC, id) AS place, count(*) OVER () AS n, sum(y) OVER () AS pos FROM m),
    f AS (SELECT unnest([0.1, 0.2]) AS fraction)
    SELECT CAST(fraction AS DOUBLE) AS fraction, CAST(max(ceil(fraction * n)) AS BIGINT) AS taken, count(*) FILTER (WHERE place <= ceil(fraction * n) AND y = 1) AS hits,
      round(count(*) FILTER (WHERE place <= ceil(fraction * n) AND y = 1) / max(pos), 6) AS recall,
      round(count(*) FILTER (WHERE place <= ceil(fraction * n) AND y = 1) / max(ceil(fraction * n)), 6) AS "precision",
      round((count(*) FILTER (WHERE place <= ceil(fraction * n) AND y = 1) / max(ceil(fraction * n))) / (max(pos) / max(n)), 6) AS lift
    FROM o, f GROUP BY fraction""")
def recall_at_top(spark, sf_dir):
    """One global numbering for several capacities."""
    out = metrics.top_quality(labelled(spark, sf_dir), "s", "y", "id", [0.1, 0.2])
    return out.withColumns({c: F.round(c, 6) for c in ("recall", "precision", "lift")})


AS_NUMBERS = ", ".join(f"CAST(round({c}, 4) AS DOUBLE) AS {c}" if c in ROUNDED else f"CAST({c} AS DOUBLE) AS {c}" for c in feat.FEATURES)


@query(f"""{bank.SNAPSHOTS_SQL}, l AS (UNPIVOT (SELECT low_engagement_next_90d AS y, {AS_NUMBERS} FROM rows_) ON {', '.join(feat.FEATURES)} INTO NAME feature VALUE v),
    g AS (SELECT feature, v, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS n FROM l GROUP BY ALL),
    r AS (SELECT *, sum(p) OVER (PARTITION BY feature ORDER BY v DESC) AS tp FROM g),
    a AS (SELECT feature, sum(n * (tp - p / 2.0)) / (sum(p) * sum(n)) AS auc FROM r GROUP BY 1)
    SELECT feature, round(auc, 6) AS roc_auc, round(greatest(auc, 1 - auc), 6) AS oriented FROM a""")
def single_feature_aucs(spark, sf_dir):
    """All 26 features."""
    rows = bank.snapshots(spark, sf_dir).select(F.col(feat.TARGET).alias("y"), *[F.round(c, 4).alias(c) if c in ROUNDED else F.col(c) for c in feat.FEATURES])
    out = metrics.feature_aucs(rows, feat.FEATURES, "y")
    return out.select("feature", F.round("roc_auc", 6).alias("roc_auc"), F.round("oriented", 6).alias("oriented"))


@query(f"""{LABELLED_SQL}, k AS (SELECT id, (rank() OVER (ORDER BY recency) + (count(*) OVER (PARTITION BY recency) - 1) / 2.0) / count(*) OVER () AS a,
      (rank() OVER (ORDER BY frequency) + (count(*) OVER (PARTITION BY frequency) - 1) / 2.0) / count(*) OVER () AS b FROM m)
    SELECT id, round((a + b) / 2, 6) AS rule_ranks FROM k""")
def recency_frequency_ranks(spark, sf_dir):
    """The mean of two percentile ranks with averaged ties."""
    rows = cut_lineage(labelled(spark, sf_dir))  # each rank reads it twice
    return models.rule_scores(rows).select("id", F.round("rule_ranks", 6).alias("rule_ranks"))


@query(f"""{bank.SNAPSHOTS_SQL}, k AS (SELECT rank() OVER (ORDER BY txn_count_180d) + (count(*) OVER (PARTITION BY txn_count_180d) - 1) / 2.0 AS a,
      rank() OVER (ORDER BY fut_txn_count) + (count(*) OVER (PARTITION BY fut_txn_count) - 1) / 2.0 AS b FROM rows_)
    SELECT round(corr(a, b), 6) AS spearman FROM k""")
def spearman_past_future(spark, sf_dir):
    """H13."""
    return ordering.spearman(labelled(spark, sf_dir), "txn_count_180d", "fut_txn_count").select(F.round("spearman", 6).alias("spearman"))


@query(f"""{bank.SNAPSHOTS_SQL}, b AS (SELECT CASE WHEN days_since_last_txn <= 30 THEN '(-1, 30]' WHEN days_since_last_txn <= 90 THEN '(30, 90]'
      WHEN days_since_last_txn <= 180 THEN '(90, 180]' ELSE '(180, 365]' END AS bucket, low_engagement_next_90d AS y FROM rows_)
    SELECT bucket, count(*) AS customers, round(avg(y), 6) AS rate FROM b GROUP BY 1""")
def risk_by_recency_bucket(spark, sf_dir):
    """C25, G32."""
    out = models.bucket_rates(labelled(spark, sf_dir), "days_since_last_txn", [-1, 30, 90, 180, 365], "y")
    return out.withColumn("rate", F.round("rate", 6))


@query(f"""{bank.SNAPSHOTS_SQL} SELECT snapshot_date, round(avg(CAST(fut_txn_count = 0 AS INT)), 6) AS inactive,
      round(avg(CAST(fut_txn_count BETWEEN 1 AND 2 AS INT)), 6) AS low, round(avg(CAST(fut_txn_count > 2 AS INT)), 6) AS high FROM rows_ GROUP BY 1""")
def activity_level_crosstab(spark, sf_dir):
    """A cross-tabulation normalised by row."""
    level = F.when(F.col("fut_txn_count") == 0, "inactive").when(F.col("fut_txn_count") <= 2, "low").otherwise("high")
    table = labelled(spark, sf_dir).withColumn("level", level).groupBy("snapshot_date").pivot("level", ["inactive", "low", "high"]).count().na.fill(0)
    total = F.col("inactive") + F.col("low") + F.col("high")
    return table.select("snapshot_date", *[F.round(F.col(c) / total, 6).alias(c) for c in ("inactive", "low", "high")])


@query(f"""{bank.sql('txn', 'act')}, n AS (SELECT customer_id, count(*) AS n FROM act GROUP BY 1)
    SELECT round(avg(n), 6) AS mean, round(var_samp(n) / avg(n), 6) AS dispersion, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.9), 6) AS p90 FROM n""")
def activity_dispersion(spark, sf_dir):
    """G24, G26."""
    counts = bank.activity(spark, sf_dir).groupBy("customer_id").agg(F.count("*").alias("n"))
    marks = ordering.exact_quantiles(counts, "n", {"p50": 0.5, "p90": 0.9}).withColumn("one", F.lit(1))
    spread = counts.agg(F.avg("n").alias("mean"), (F.var_samp("n") / F.avg("n")).alias("dispersion"), F.lit(1).alias("one"))
    return spread.join(F.broadcast(marks), "one").select(*[F.round(c, 6).alias(c) for c in ("mean", "dispersion", "p50", "p90")])  # one row each


BOOT = 500
BOOT_STEPS = [f"WHEN u < {step!r} THEN {k}" for k, step in enumerate(resampling.poisson_steps())]


@query(f"""{LABELLED_SQL}, d AS (SELECT *, b, CAST('0x' || substr(md5(id || ':' || (b // 4)), CAST(1 + 8 * (b % 4) AS INT), 8) AS BIGINT) / 4294967296.0 AS u
      FROM m, (SELECT unnest(range({BOOT})) AS b) WHERE snapshot_date = DATE '2000-01-01'),
    w AS (SELECT *, CASE {' '.join(BOOT_STEPS)} ELSE 12 END AS w FROM d),
    l AS (SELECT b, 1 AS side, s AS v, y, w FROM w WHERE w > 0 UNION ALL SELECT b, 2, recency::DOUBLE, y, w FROM w WHERE w > 0),
    g AS (SELECT b, side, v, sum(w * y) AS p, sum(w * (1 - y)) AS n FROM l GROUP BY ALL),
    r AS (SELECT *, sum(p) OVER o AS tp, sum(n) OVER o AS fp FROM g WINDOW o AS (PARTITION BY b, side ORDER BY v DESC)),
    q AS (SELECT b, side, sum(n * (tp - p / 2.0)) / nullif(sum(p) * sum(n), 0) AS roc, sum(p * tp / (tp + fp)) / nullif(sum(p), 0) AS pr FROM r GROUP BY ALL),
    x AS (SELECT b, max(pr) FILTER (WHERE side = 1) - max(pr) FILTER (WHERE side = 2) AS pr_auc_gain, max(roc) FILTER (WHERE side = 1) - max(roc) FILTER (WHERE side = 2) AS roc_auc_gain FROM q GROUP BY 1)
    SELECT {', '.join(f"round(avg({c}), 6) AS {c}_mean, round(quantile_cont({c}, 0.025), 6) AS {c}_low, round(quantile_cont({c}, 0.975), 6) AS {c}_high" for c in ('pr_auc_gain', 'roc_auc_gain'))} FROM x""")
def paired_bootstrap(spark, sf_dir):
    """500 resamples by Poisson weights drawn from ids, so the interval is repeatable."""
    rows = labelled(spark, sf_dir).where("snapshot_date = '2000-01-01'")
    gains = resampling.bootstrap_differences(rows, "id", "y", "s", "days_since_last_txn", BOOT)
    out = metrics.interval(gains, ["pr_auc_gain", "roc_auc_gain"])
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(f"""{bank.sql('txn', 'act')} SELECT id AS transaction_id, customer_id FROM act WHERE CAST('0x' || substr(md5(CAST(customer_id AS VARCHAR)), 1, 8) AS BIGINT) % 10 = 0""")
def stable_customer_sample(spark, sf_dir):
    """A sampling operator; the same tenth of the customers every time."""
    return ordering.hash_bucket_sample(bank.spend(spark, sf_dir), "customer_id", 10).select("transaction_id", "customer_id")


@query("""SELECT c_custkey FROM customer ORDER BY md5(c_custkey || ':seed-7'), c_custkey LIMIT 50""")
def seeded_row_sample(spark, sf_dir):
    """A sampling operator; exactly n rows."""
    return ordering.hash_ordered_sample(read(spark, sf_dir, "customer", "c_custkey"), "c_custkey", 50, "seed-7").select("c_custkey")


# ---- Models (no SQL twin) ----

def model_rows(spark, sf_dir):
    rows = cut_lineage(bank.snapshots(spark, sf_dir))  # training reads its input many times
    return rows.where(F.col("snapshot_date").isin(*bank.TRAIN)), rows.where(F.col("snapshot_date").isin(*bank.VALID))


def judged(quality):
    """Rows, positives and metrics of every score."""
    return quality.select("model", "rows", "positives", *(F.round(c, 6).alias(c) for c in ("roc_auc", "pr_auc")))


QUALITY_SQL = """g AS (SELECT model, s, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS n FROM l GROUP BY ALL),
    r AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM g WINDOW w AS (PARTITION BY model ORDER BY s DESC)),
    q AS (SELECT model, CAST(sum(p + n) AS BIGINT) AS "rows", CAST(sum(p) AS BIGINT) AS positives, round(sum(n * (tp - p / 2.0)) / nullif(sum(p) * sum(n), 0), 6) AS roc_auc,
      round(sum(p * tp / (tp + fp)) / nullif(sum(p), 0), 6) AS pr_auc FROM r GROUP BY model)"""
VALID_SQL = f"""{bank.SNAPSHOTS_SQL}, v AS (SELECT low_engagement_next_90d AS y, days_since_last_txn AS rec, txn_count_90d AS freq FROM rows_ WHERE snapshot_date = DATE '2000-01-01')"""
RULES = {"majority": "rule_majority", "recency": "rule_recency", "frequency": "rule_frequency", "ranks": "rule_ranks"}


def ruled(valid):
    return models.rule_scores(valid).withColumn("rule_ranks", F.round("rule_ranks", 9))


@query(f"""{VALID_SQL}, k AS (SELECT *, ((rank() OVER (ORDER BY rec) + (count(*) OVER (PARTITION BY rec) - 1) / 2.0)
        + (rank() OVER (ORDER BY freq DESC) + (count(*) OVER (PARTITION BY freq) - 1) / 2.0)) / (2.0 * count(*) OVER ()) AS rk FROM v),
    l AS (SELECT 'majority' AS model, 0.0::DOUBLE AS s, y FROM k UNION ALL SELECT 'recency', rec::DOUBLE, y FROM k UNION ALL SELECT 'frequency', -freq::DOUBLE, y FROM k
      UNION ALL SELECT 'ranks', round(rk, 9), y FROM k), {QUALITY_SQL} SELECT * FROM q""")
def rule_quality(spark, sf_dir):
    """The rules a model must beat."""
    _, valid = model_rows(spark, sf_dir)
    return judged(models.compare_scores(ruled(valid), RULES, feat.TARGET))


@query()
def linear_probe_quality(spark, sf_dir):
    """The linear probe on all and on transaction features, beside the rules."""
    train, valid = model_rows(spark, sf_dir)
    scored = models.predict(models.fitted(models.linear_probe(), train), ruled(valid), "probe_all")
    scored = models.predict(models.fitted(models.linear_probe(models.TRANSACTIONAL), train), scored, "probe_txn")
    return judged(models.compare_scores(scored, {"probe, all features": "probe_all", "probe, transactions": "probe_txn", **RULES}, feat.TARGET))


@query()
def boosted_tree_quality(spark, sf_dir):
    """The tuned boosted trees against single-split trees of as many rounds."""
    train, valid = model_rows(spark, sf_dir)
    scored = models.predict(models.fitted(models.boosted_trees(), train), valid, "trees")
    scored = models.predict(models.fitted(models.single_split_trees(), train), scored, "stumps")
    return judged(models.compare_scores(scored, {"boosted trees": "trees", "single-split trees": "stumps"}, feat.TARGET))


CLICKS_SQL = f"""{bank.sql('line')}, {bank.SNAP_SQL},
    h AS (SELECT customer_id, t, count(*) FILTER (WHERE delivered) AS past, count(*) FILTER (WHERE flag = 'R' AND shipped < t) AS clicks FROM line, snap WHERE sent < t GROUP BY ALL),
    c AS (SELECT x.t, x.flag, CAST(x.flag = 'R' AS INT) AS y, round(coalesce(clicks / nullif(past, 0), 0), 9) AS past_rate
      FROM (SELECT line.*, t FROM line, snap WHERE sent >= t AND date_diff('day', t, sent) < 90 AND delivered) x LEFT JOIN h ON h.customer_id = x.customer_id AND h.t = x.t),
    tr AS (SELECT flag, round(avg(y), 9) AS rate FROM c WHERE t < DATE '2000-01-01' GROUP BY 1),
    v AS (SELECT c.*, rate FROM c JOIN tr USING (flag) WHERE t = DATE '2000-01-01'),
    l AS (SELECT 'channel rate' AS model, rate AS s, y FROM v UNION ALL SELECT 'past click rate', past_rate, y FROM v)"""


def click_rows(spark, sf_dir):
    """Training rows, and validation rows with the scores that need no model."""
    rows = cut_lineage(feat.click_rows(bank.sends(spark, sf_dir), bank.CUTOFFS))
    train = rows.where(F.col("snapshot_date").isin(*bank.TRAIN))
    valid = rows.where(F.col("snapshot_date").isin(*bank.VALID))
    return train, models.channel_rate_score(train, valid).withColumns({c: F.round(c, 9) for c in ("channel_rate", "past_click_rate")})


CLICK_RULES = {"channel rate": "channel_rate", "past click rate": "past_click_rate"}


@query(f"{CLICKS_SQL}, {QUALITY_SQL} SELECT * FROM q")
def click_rule_quality(spark, sf_dir):
    """The channel's own rate and the customer's past rate as scores."""
    return judged(models.compare_scores(click_rows(spark, sf_dir)[1], CLICK_RULES, "clicked"))


@query()
def click_probe_quality(spark, sf_dir):
    """History with and without the channel, beside the rules."""
    train, scored = click_rows(spark, sf_dir)
    scored = models.predict(models.fitted(models.click_probe(False), train), scored, "history")
    scored = models.predict(models.fitted(models.click_probe(True), train), scored, "history_channel")
    return judged(models.compare_scores(scored, {**CLICK_RULES, "history": "history", "history and channel": "history_channel"}, "clicked"))


@query()
def permutation_importances(spark, sf_dir):
    """All features, three deals each, on the tuned boosted trees."""
    train, valid = model_rows(spark, sf_dir)
    drops = models.permutation_importance(models.fitted(models.boosted_trees(), train), valid, feat.FEATURES, feat.TARGET, ["customer_id", "snapshot_date"], repeats=3)
    return drops.withColumn("pr_auc_drop", F.round("pr_auc_drop", 6))


@query()
def ablation_without_products(spark, sf_dir):
    """The linear probe and the boosted trees with and without a feature."""
    train, valid = model_rows(spark, sf_dir)
    built = {"linear probe": models.linear_probe, "boosted trees": models.boosted_trees}
    parts = [judged(models.ablation(train, valid, ["products_opened"], build=build)).withColumn("build", F.lit(name)) for name, build in built.items()]
    return parts[0].unionByName(parts[1])


@query(f"""{bank.SNAPSHOTS_SQL}, all_ AS (SELECT customer_id, count(*) AS total FROM line WHERE num = 2 GROUP BY 1),
    e AS (SELECT r.snapshot_date, r.products_opened AS known, coalesce(total, 0) AS total, low_engagement_next_90d AS y FROM rows_ r LEFT JOIN all_ USING (customer_id))
    SELECT snapshot_date, CAST(sum(total) AS BIGINT) AS products, CAST(sum(total - known) AS BIGINT) AS opened_after, round(sum(total - known) / sum(total), 6) AS opened_after_share,
      round(corr(known, y), 6) AS known_correlation, round(corr(total, y), 6) AS total_correlation FROM e GROUP BY 1""")
def products_opened_after(spark, sf_dir):
    """The share of products that the cutoff hides, and how the label goes with what is known and with all."""
    rows = cut_lineage(bank.snapshots(spark, sf_dir))
    opened = bank.lines(spark, sf_dir).where("num = 2").select("customer_id")
    out = feat.opened_after(opened, rows)
    return out.select("snapshot_date", "products", "opened_after", *(F.round(c, 6).alias(c) for c in ("opened_after_share", "known_correlation", "total_correlation")))


@query(f"""{bank.SNAPSHOTS_SQL} SELECT customer_id, snapshot_date, {AS_NUMBERS} FROM rows_""")
def model_matrix(spark, sf_dir):
    """The inputs as doubles."""
    matrix = feat.model_matrix(bank.snapshots(spark, sf_dir))
    return matrix.select("customer_id", "snapshot_date", *PLAIN, *[F.round(c, 4).alias(c) for c in ROUNDED])


@query(f"""{bank.SNAPSHOTS_SQL} SELECT snapshot_date, count(*) AS customers, true AS reproduced FROM rows_ GROUP BY 1""")
def replicated_model(spark, sf_dir):
    """A saved model reproduces its predictions, and the metrics of a second fit stay within the tolerance."""
    rows = cut_lineage(bank.snapshots(spark, sf_dir))
    train, valid = rows.where(F.col("snapshot_date").isin(*bank.TRAIN)), rows.where(F.col("snapshot_date").isin(*bank.VALID))
    inputs = ("days_since_last_txn", "txn_count_90d")
    model = models.fitted(models.linear_probe(inputs), train)
    gap = models.reload_difference(model, f"{ensure_checkpoint_dir(spark).rstrip('/')}/model-{uuid.uuid4().hex}", valid, ["customer_id", "snapshot_date"])
    reported, again = (models.compare_scores(models.predict(m, valid), {"probe": "score"}, feat.TARGET).first() for m in (model, models.fitted(models.linear_probe(inputs), train)))
    pick = lambda r: {k: r[k] for k in ("pr_auc", "roc_auc") if r[k] is not None}
    metrics.within_tolerance(pick(again), pick(reported))
    counts = rows.groupBy("snapshot_date").agg(F.count("*").alias("customers"))
    return counts.withColumn("reproduced", F.lit(gap < 1e-12))
