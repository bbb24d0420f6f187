"""Files in and out: delivered CSV, cleaning, silver on the driver's tables, reports, sinks and streams of files."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from tidemark.config import bank as config
from tidemark.functions import cleaning
from tidemark.operators import arrivals, contracts, dedup, flags, ordering, references, reports
from tidemark.operators.lookups import map_value
from tidemark.plans import features as feat
from tidemark.plans import models, runs, serving, silver, table_rules, zone
from tidemark.plans.silver import deduplicated
from tidemark.session import ensure_checkpoint_dir
from tidemark.sources import readers, sinks
from tidemark.streaming import jobs
from workload import bankview as bank
from workload import quality
from workload.registry import query
from workload.tables import CATALOG, CUSTOMER, LINEITEM, ORDERS, read


def folder(spark):
    """A folder of its own for what a query writes, in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/lake-{uuid.uuid4().hex}"


# ---- Deliveries and cleaning ----

def delivered_customers(spark, sf_dir, root):
    """The customer table delivered as CSV with blanks, padded texts and numbers that do not parse, and a second delivery
    that corrects one segment."""
    c = read(spark, sf_dir, "customer")
    segment = F.when(F.col("c_custkey") % 7 == 0, " NaN ").when(F.col("c_custkey") % 7 == 1, F.concat(F.lit("  "), "c_mktsegment", F.lit(" "))).otherwise(F.col("c_mktsegment"))
    balance = F.when(F.col("c_custkey") % 5 == 0, "oops").otherwise(F.col("c_acctbal").cast("string"))
    nation = F.concat(F.col("c_nationkey").cast("string"), F.lit(".0"))
    first = c.select(F.col("c_custkey").cast("string"), "c_name", nation.alias("c_nationkey"), balance.alias("c_acctbal"), segment.alias("c_mktsegment"),
                     (F.col("c_mktsegment") == "BUILDING").alias("corrected"))
    readers.ingest(first, root, CUSTOMER, "2024-01-01")
    readers.ingest(first.where("corrected").withColumn("c_acctbal", F.lit("1.5")), root, CUSTOMER, "2024-01-02")
    return readers.read_bronze(spark, root, CUSTOMER)


@query("""SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 1.5 WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
    CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS c_mktsegment, CASE WHEN c_mktsegment = 'BUILDING' THEN 2 ELSE 1 END AS dq_copies,
    CASE WHEN c_mktsegment = 'BUILDING' THEN DATE '2024-01-02' ELSE DATE '2024-01-01' END AS ingest_date FROM customer""")
def delivered_and_deduplicated(spark, sf_dir):
    """Strict-header CSV, cleaning and typing, the newest delivery per key."""
    kept = deduplicated(delivered_customers(spark, sf_dir, folder(spark)), CUSTOMER, CATALOG)
    return kept.select(*CUSTOMER.source_columns, "dq_copies", "ingest_date")


@query("""WITH s AS (SELECT c_custkey, c_mktsegment, CASE c_custkey % 6 WHEN 0 THEN ' true ' WHEN 1 THEN 'Sí' WHEN 2 THEN 'N/A' WHEN 3 THEN '0' WHEN 4 THEN 'T' ELSE 'quizás' END AS b,
      CASE c_custkey % 4 WHEN 0 THEN 'usd' WHEN 1 THEN ' Cop ' WHEN 2 THEN '' ELSE 'MXN' END AS cur, CASE c_custkey % 3 WHEN 0 THEN 'Mexico' WHEN 1 THEN 'México' ELSE 'Colombia' END AS country FROM customer)
    SELECT c_custkey, CASE c_custkey % 6 WHEN 2 THEN NULL ELSE c_custkey % 6 IN (0, 1, 4) END AS flag, nullif(upper(trim(cur)), '') AS currency, replace(country, 'Mexico', 'México') AS country,
      CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE DATE '2024-01-01' + CAST(c_custkey % 300 AS INT) END AS day, CAST(c_custkey % 50 AS DECIMAL(20,8))::DOUBLE + 0.25 AS money FROM s""")
def cleaned_texts(spark, sf_dir):
    """Null words, booleans, currency case, spellings, tolerant dates and money."""
    from tidemark.config.model import table

    spec = table("texts", "c_custkey", "c_custkey:long flag:bool currency country day:date money:money")
    k = F.col("c_custkey")
    pick = lambda words: F.element_at(F.array(*[F.lit(w) for w in words]), (k % len(words) + 1).cast("int"))
    day = F.when(k % 3 == 0, "31/31/2024").otherwise(F.date_add(F.lit("2024-01-01").cast("date"), (k % 300).cast("int")).cast("string"))
    rows = read(spark, sf_dir, "customer", "c_custkey").select(
        k, pick([" true ", "Sí", "N/A", "0", "T", "quizás"]).alias("flag"), pick(["usd", " Cop ", "", "MXN"]).alias("currency"),
        pick(["Mexico", "México", "Colombia"]).alias("country"), day.alias("day"), F.concat((k % 50).cast("string"), F.lit(".25")).alias("money"))
    text = rows.select(k.cast("string").alias("c_custkey"), "flag", "currency", "country", "day", "money")
    out = cleaning.clean(text, spec)
    return out.select(F.col("c_custkey").try_cast("bigint").alias("c_custkey"), "flag", "currency", "country", "day", F.col("money").cast("double").alias("money"))


@query("""SELECT l_orderkey, l_linenumber, count(DISTINCT (l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)) AS contents
    FROM lineitem GROUP BY ALL""")
def content_versions(spark, sf_dir):
    """Distinct contents per key from a null-aware content hash."""
    li = read(spark, sf_dir, "lineitem").withColumn("h", dedup.content_hash(LINEITEM.source_columns))
    return li.select("l_orderkey", "l_linenumber", "h").distinct().groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("contents"))


@query("""SELECT o_orderkey, o_custkey, 1 AS dq_copies FROM orders WHERE o_orderstatus = 'P' UNION ALL
    SELECT max(o_orderkey), o_custkey, count(*) FROM (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY o_custkey""")
def keyless_rows_kept(spark, sf_dir):
    """Rows without a key stay one each, the others are deduplicated."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("key"))
    return dedup.keep_latest(o, ["key"], [F.col("o_orderkey").desc()], ["o_orderkey"]).select("o_orderkey", "o_custkey", "dq_copies")


# ---- Single-table rules ----

@query("""SELECT o_orderkey, o_orderstatus = 'O' AND o_orderkey % 3 = 0 AS undelivered_engagement, o_orderkey % 9 = 0 AS event_order, o_orderstatus = 'F' AND o_orderkey % 4 = 0 AS was_opened_imputed FROM orders""")
def send_rules(spark, sf_dir):
    """Engagement without delivery, events before the send, an imputed open flag."""
    o, day = read(spark, sf_dir, "orders"), F.to_date("o_orderdate")
    k = F.col("o_orderkey")
    rows = o.select(
        k, F.when(F.col("o_orderstatus") == "F", "Sent").otherwise("Blocked").alias("send_status"), (F.col("o_orderstatus") != "O").alias("was_delivered"),
        F.when((F.col("o_orderstatus") == "F") & (k % 4 == 0), None).otherwise(F.lit(False)).alias("was_opened"), (k % 3 == 0).alias("was_clicked"), day.alias("send_date"),
        F.date_add(day, F.when(k % 9 == 0, -1).otherwise(1)).alias("open_date"), F.lit(None).cast("date").alias("click_date"))
    out = table_rules.apply_rules(rows, "campaign_sends")
    return out.select(k, F.col("dq_invalid_undelivered_engagement").alias("undelivered_engagement"), F.coalesce("dq_invalid_event_order", F.lit(False)).alias("event_order"), "was_opened_imputed")


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN NOT (p_size BETWEEN 1 AND 5) WHEN 1 THEN NOT (p_size BETWEEN 0 AND 10) ELSE false END AS score_out_of_range,
    CASE WHEN p_partkey % 3 = 1 THEN CASE WHEN p_partkey % 2 = 0 AND p_size <= 10 THEN 'Promoter' <> CASE WHEN p_size <= 6 THEN 'Detractor' WHEN p_size <= 8 THEN 'Passive' ELSE 'Promoter' END END
      ELSE CASE WHEN p_partkey % 2 = 0 THEN true ELSE false END END AS nps_category,
    CASE WHEN p_partkey % 2 = 0 THEN 'Promoter' WHEN p_partkey % 3 = 1 AND p_size <= 10 THEN CASE WHEN p_size <= 6 THEN 'Detractor' WHEN p_size <= 8 THEN 'Passive' ELSE 'Promoter' END END AS category FROM part""")
def survey_rules(spark, sf_dir):
    """Bounds by survey type, a category that must match its score band, and the missing ones filled."""
    p = read(spark, sf_dir, "part")
    kind = F.element_at(F.array(F.lit("CSAT"), F.lit("NPS"), F.lit("CES")), (F.col("p_partkey") % 3 + 1).cast("int"))
    rows = p.select("p_partkey", kind.alias("survey_type"), F.col("p_size").alias("main_score"), F.when(F.col("p_partkey") % 2 == 0, "Promoter").alias("nps_category"))
    out = table_rules.apply_rules(rows, "satisfaction_surveys")
    return out.select("p_partkey", F.col("dq_invalid_score_out_of_range").alias("score_out_of_range"), F.col("dq_invalid_nps_category").alias("nps_category"), F.col("nps_category").alias("category"))


@query("""SELECT c_custkey, day > DATE '2026-06-17' AS late, CASE WHEN NOT (day > DATE '2026-06-17') THEN day END AS clean_day, reg > DATE '2026-06-17' OR reg > day AS registration,
    CASE c_nationkey % 3 WHEN 0 THEN 'MXN' WHEN 1 THEN 'COP' END AS income_currency
    FROM (SELECT *, DATE '2026-01-01' + CAST(c_custkey % 400 AS INT) AS day, DATE '2025-12-01' + CAST(c_custkey % 70 AS INT) AS reg FROM customer)""")
def customer_rules(spark, sf_dir):
    """Updates after the data ends, registrations after the update, the home currency."""
    k = F.col("c_custkey")
    plus = lambda start, n: F.date_add(F.lit(start).cast("date"), (k % n).cast("int"))
    country = F.when(F.col("c_nationkey") % 3 == 0, "México").when(F.col("c_nationkey") % 3 == 1, "Colombia").otherwise("Elsewhere")
    out = table_rules.apply_rules(read(spark, sf_dir, "customer").select("c_custkey", plus("2026-01-01", 400).alias("last_updated"), plus("2025-12-01", 70).alias("registration_date"), country.alias("country")), "customers")
    return out.select("c_custkey", F.col("dq_invalid_last_updated_after_cutoff").alias("late"), F.col("last_updated_clean").alias("clean_day"), F.col("dq_invalid_registration_date").alias("registration"), "income_currency")


@query("""SELECT event_id, value < 5 AND event_type <> 'view' AS missing_duration, user_id IS NULL OR event_id % 6 = 0 AS missing_customer FROM events""")
def contact_rules(spark, sf_dir):
    """No duration on a contact that was not written, an event without a customer."""
    e = read(spark, sf_dir, "events")
    rows = e.select("event_id", F.when(F.col("event_type") == "view", "Email").otherwise("Call").alias("interaction_type"), F.col("event_type").alias("channel"),
                    F.when(F.col("value") >= 5, F.col("value")).alias("duration_seconds"), F.lit("x").alias("reason_category"),
                    F.when(F.col("event_id") % 6 != 0, F.col("user_id")).alias("customer_id"))
    out = table_rules.apply_rules(table_rules.apply_rules(rows, "call_center_interactions"), "digital_events")
    return out.select("event_id", F.col("dq_invalid_missing_duration").alias("missing_duration"), F.col("dq_invalid_missing_customer").alias("missing_customer"))


@query("""SELECT l_orderkey, l_linenumber, l_shipdate, o_orderstatus <> 'P' AND l_returnflag = 'R' AS subject_imputed,
    CASE WHEN l_returnflag <> 'R' THEN 'plain text' WHEN o_orderstatus <> 'P' THEN 'offer on ' || o_orderpriority || ' nano' END AS subject FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey""")
def texts_filled_from_parent(spark, sf_dir):
    """A missing word in a text filled from the parent row; the whole text is null when there is none."""
    li = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag")
    li = li.withColumn("subject", F.when(F.col("l_returnflag") == "R", "offer on nan nano").otherwise("plain text"))
    o = read(spark, sf_dir, "orders").withColumn("value", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")))
    out = references.fill_from_parent(li, o, {"l_orderkey": "o_orderkey"}, "value", "subject", "nan")
    return out.select("l_orderkey", "l_linenumber", "l_shipdate", "subject_imputed", "subject")


@query("""SELECT o_orderkey, o_orderdate > o_orderdate + INTERVAL 5 DAY - INTERVAL (o_orderkey % 8) DAY AS wrong_order FROM orders""")
def dates_in_order(spark, sf_dir):
    """D05."""
    from tidemark.config.model import table

    spec = table("spans", "o_orderkey", "o_orderkey:long opened:timestamp_ntz closed:timestamp_ntz", in_order=(("opened", "closed"),))
    o = read(spark, sf_dir, "orders")
    spans = o.select("o_orderkey", F.col("o_orderdate").alias("opened"), (F.col("o_orderdate") + F.make_dt_interval(F.lit(5) - F.col("o_orderkey") % 8)).alias("closed"))
    return contracts.add_contract_flags(spans, spec, CATALOG).select("o_orderkey", F.col("dq_invalid_date_order").alias("wrong_order"))


@query("""SELECT c_custkey, round(sign(c_acctbal) * ln(1 + abs(c_acctbal)), 6) AS signed_log, least(coalesce(CASE WHEN c_custkey % 4 <> 0 THEN c_custkey END, 999), 999) AS recency,
    coalesce(round(c_acctbal / nullif(c_custkey % 5, 0), 4), 0) AS share, CASE WHEN c_custkey % 2 = 0 THEN CASE c_custkey % 5 WHEN 0 THEN 'declined_by_issuer' WHEN 1 THEN 'insufficient_funds' END END AS reason FROM customer""")
def numeric_helpers(spark, sf_dir):
    """Signed logarithm, capped recency, safe shares, decline reasons."""
    k = F.col("c_custkey")
    code = F.when(k % 5 == 0, "05").when(k % 5 == 1, "51").otherwise("99")
    status = F.when(k % 2 == 0, "Declined").otherwise("Approved")
    return read(spark, sf_dir, "customer").select(
        k, F.round(F.expr(models.signed_log("c_acctbal")), 6).alias("signed_log"), feat.capped(F.when(k % 4 != 0, k)).alias("recency"),
        F.coalesce(F.round(F.try_divide("c_acctbal", k % 5), 4), F.lit(0.0)).alias("share"), serving.decline_reason(status, code).alias("reason"))


# ---- Access zone over orders ----

def zone_tables(spark, sf_dir):
    c, none = read(spark, sf_dir, "customer"), F.lit(None).cast("string")
    customers = c.select(
        F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("first_name"), F.col("c_mktsegment").alias("last_name"), F.concat(F.lower("c_name"), F.lit("@mail.test")).alias("email"),
        F.lpad(F.col("c_custkey").cast("string"), 10, "3").alias("mobile_phone"), none.alias("city"), none.alias("state"), none.alias("country"), F.lit("Active").alias("customer_status"),
        F.lit(None).cast("timestamp").alias("registration_date"), F.lit(True).alias("accepts_marketing"), F.col("c_mktsegment").alias("segment"), none.alias("registration_branch_id"))
    o = read(spark, sf_dir, "orders")
    products = o.select(
        F.col("o_custkey").alias("customer_id"), F.col("o_orderkey").alias("product_id"), F.col("o_orderpriority").alias("product_type"), F.lpad(F.col("o_orderkey").cast("string"), 16, "4").alias("product_number"),
        F.lit("USD").alias("currency"), F.col("o_totalprice").alias("current_balance"), F.lit(0.0).alias("credit_limit"), F.lit(0.0).alias("interest_rate"), F.to_date("o_orderdate").alias("opening_date"),
        F.to_date("o_orderdate").alias("expiration_date"), F.col("o_orderstatus").alias("product_status"), none.alias("opening_channel"), F.lit(True).alias("has_linked_app"),
        F.lit(None).cast("timestamp").alias("last_transaction_date"), F.when(F.col("o_orderstatus") == "P", 3).alias("days_past_due"))
    spends = [F.lit(0.0).alias(f"spend_usd_{w}") for w in ("entertainment", "food", "health", "other", "services", "transport")]
    features = o.groupBy(F.col("o_custkey").alias("customer_id")).agg(F.count("*").alias("txn_count_90d")).select(
        "customer_id", F.lit("2001-08-01").cast("date").alias("as_of_date"), "txn_count_90d", F.lit(0.0).alias("txn_amount_usd_90d"), F.lit(0).alias("foreign_txn_count_90d"), *spends)
    li = bank.lines(spark, sf_dir)
    supplier = read(spark, sf_dir, "supplier").where("s_acctbal > 3000")
    interactions = li.select("customer_id", (F.col("l_partkey") % 100).alias("agent_id"), F.col("shipped").alias("interaction_date"),
                             F.concat_ws(":", F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.col("num").cast("string"), F.lpad(F.col("l_partkey").cast("string"), 12, "0")).alias("interaction_id"),
                             none.alias("interaction_type"), F.col("flag").alias("channel"), none.alias("contact_reason"), F.lit(True).alias("was_resolved"), F.lit(False).alias("requires_followup"), F.col("delivered").alias("was_escalated"))
    agents = supplier.select(F.col("s_suppkey").alias("agent_id"), F.col("s_name").alias("first_name"), F.lit("Zed").alias("last_name"), F.lit("a@bank.test").alias("email"), none.alias("specialty"), none.alias("languages"), F.lit("Active").alias("agent_status"))
    return customers, products, features, interactions, agents


@query("""WITH line AS (SELECT o_custkey AS cid, CAST(l_shipdate AS DATE) AS shipped, l_partkey % 100 AS agent, lpad(l_orderkey::VARCHAR, 12, '0') || ':' || l_linenumber || ':' || lpad(l_partkey::VARCHAR, 12, '0') AS iid
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    a AS (SELECT cid, max({'d': shipped, 'i': iid, 'n': s_name}).n AS name FROM line JOIN (SELECT * FROM supplier WHERE s_acctbal > 3000) ON s_suppkey = agent GROUP BY 1),
    p AS (SELECT o_custkey AS cid, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'P') AS overdue FROM orders GROUP BY 1)
    SELECT c_custkey AS customer_id, lower(c_name[1]) || '***@mail.test' AS email_masked, '****' || right(lpad(c_custkey::VARCHAR, 10, '3'), 4) AS mobile_phone_masked, coalesce(p.n, 0) AS products, coalesce(overdue, 0) AS overdue,
      a.name || ' Z.' AS agent_name, p.n AS txn_count_90d FROM customer LEFT JOIN a ON a.cid = c_custkey LEFT JOIN p ON p.cid = c_custkey""")
def customer_profiles(spark, sf_dir):
    """Masked profile, product list, spend and latest known agent; nothing forbidden in it."""
    out = zone.customer_360(*zone_tables(spark, sf_dir))
    zone.check_access(out, "customer_360")
    overdue = F.size(F.filter("products", lambda p: p["bk_is_overdue"]))
    return out.select("customer_id", "email_masked", "mobile_phone_masked", F.coalesce(F.size("products"), F.lit(0)).alias("products"), F.greatest(F.coalesce(overdue, F.lit(0)), F.lit(0)).alias("overdue"), "agent_name", "txn_count_90d").withColumn(
        "products", F.greatest("products", F.lit(0)))


@query("""WITH line AS (SELECT o_custkey AS customer_id, CAST(l_shipdate AS DATE) AS interaction_date, l_returnflag AS channel, lpad(l_orderkey::VARCHAR, 12, '0') || ':' || l_linenumber || ':' || lpad(l_partkey::VARCHAR, 12, '0') AS id
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey), k AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY interaction_date DESC, id DESC) AS place FROM line)
    SELECT customer_id, interaction_date, id AS bk_interaction_id FROM k WHERE place <= 10""")
def recent_contacts(spark, sf_dir):
    """N05."""
    return zone.recent_contacts(zone_tables(spark, sf_dir)[3]).select("customer_id", "interaction_date", "bk_interaction_id")


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders)
    SELECT o_custkey AS customer_id, o_orderkey AS bk_transaction_id, round(o_totalprice, 2) AS amount_usd, CASE WHEN o_orderkey % 2 = 0 THEN '****' || right(lpad(o_orderkey::VARCHAR, 16, '4'), 4) END AS product_number_masked FROM k WHERE place <= 20""")
def recent_transactions(spark, sf_dir):
    """The newest twenty; another customer's card number stays hidden."""
    return transactions_shown(spark, sf_dir).select("customer_id", "bk_transaction_id", F.round("amount_usd", 2).alias("amount_usd"), "product_number_masked")


def transactions_shown(spark, sf_dir):
    from workload.gold import fx

    o, none = read(spark, sf_dir, "orders"), F.lit(None).cast("string")
    t = o.select(F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").alias("transaction_date"), F.col("o_orderkey").alias("transaction_id"), F.col("o_orderkey").alias("product_id"), F.col("o_totalprice").alias("amount"),
                 F.lit("USD").alias("currency"), F.lit(None).cast("double").alias("amount_usd"), *[none.alias(c) for c in ("transaction_type", "transaction_category", "channel", "merchant_name", "merchant_category",
                                                                                                                  "transaction_country", "transaction_city", "transaction_status", "response_code")])
    products = o.select(F.col("o_orderkey").alias("product_id"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).otherwise(-1).alias("customer_id"), F.lpad(F.col("o_orderkey").cast("string"), 16, "4").alias("product_number"))
    return zone.recent_transactions(t, fx(spark, sf_dir), products)


# ---- Reports and sinks ----

@query(f"""{quality.CHECKED_SQL}, r AS ({quality.RULE_SQL} UNION ALL SELECT 'missing_key', 0, count(*) FROM checked UNION ALL {quality.CHECKS_SQL}),
    d AS (SELECT CAST(sum(dq_copies) AS BIGINT) AS n, CAST(sum(dq_copies - dq_versions) AS BIGINT) AS e, CAST(sum(dq_versions - 1) AS BIGINT) AS c, count(*) FILTER (WHERE dq_versions > 1) AS k FROM checked),
    x AS (SELECT 'rules' AS report, CASE WHEN rule LIKE '%:%' THEN 'contract' ELSE 'flag' END AS check_type, rule AS check_name, failing_rows, "rows" AS total_rows, round(100.0 * failing_rows / "rows", 3) AS failing_pct,
        CASE WHEN failing_rows = 0 THEN 'ok' ELSE 'flagged' END AS status, NULL AS detail FROM r WHERE rule NOT IN ('required_missing', 'not_allowed', 'out_of_range', 'outside_dataset', 'date_order', 'not_unique')
      UNION ALL SELECT 'duplicates', 'duplicates', 'exact_duplicates', e, n, round(100.0 * e / n, 3), CASE WHEN e > 0 THEN 'removed' ELSE 'ok' END, NULL FROM d
      UNION ALL SELECT 'duplicates', 'duplicates', 'conflicting_duplicates', c, n, round(100.0 * c / n, 3), CASE WHEN c > 0 THEN 'removed' ELSE 'ok' END, k || ' keys had more than one version' FROM d
      UNION ALL SELECT 'exclusions', 'exclusion', 'rows_excluded', count(*) FILTER (WHERE orphan_orders OR outside_dataset), count(*), round(100.0 * count(*) FILTER (WHERE orphan_orders OR outside_dataset) / count(*), 3), 'excluded',
        '{{"orphan_orders":' || count(*) FILTER (WHERE orphan_orders) || ',"outside_dataset":' || count(*) FILTER (WHERE outside_dataset) || '}}' FROM checked)
    SELECT * FROM x""")
def quality_summary(spark, sf_dir):
    """Reports appended as JSON, twice, read back and joined into one view of the latest run."""
    root = folder(spark)
    built = f"{root}/silver/lineitem"
    quality.checked_lines(spark, sf_dir).write.parquet(built)
    lines = spark.read.parquet(built)
    found = {"rules": reports.rule_report(contracts.full_counts(lines, LINEITEM, CATALOG), "lineitem"), "duplicates": dedup.duplicate_report(lines, "lineitem"),
             "exclusions": flags.exclusion_report(lines, "lineitem", quality.GATE)}
    for _ in range(2):  # a later run replaces an earlier one in the view
        for name, df in found.items():
            sinks.append_report(df, f"{root}/silver/_{name}")
    view = reports.summary_view({n: readers.read_report(spark, root, "silver", n) for n in found})
    return view.select("report", "check_type", "check_name", "failing_rows", "total_rows", "failing_pct", "status", "detail")


@query(f"""{quality.CHECKED_SQL}, r AS ({quality.RULE_SQL} UNION ALL {quality.CHECKS_SQL})
    SELECT rule AS check_name, failing_rows, round(100.0 * failing_rows / "rows", 3) AS failing_pct FROM r
    WHERE failing_rows > 0 AND rule NOT IN ('required_missing', 'not_allowed', 'out_of_range', 'outside_dataset', 'date_order', 'not_unique')""")
def quality_problems(spark, sf_dir):
    """What is not ok, the largest share first."""
    lines = quality.checked_lines(spark, sf_dir)
    rules = reports.rule_report(contracts.full_counts(lines, LINEITEM, CATALOG), "lineitem").withColumn("run_at", F.lit("2024-01-01T00:00:00Z"))
    return reports.problems_first(reports.summary_view({"rules": rules})).select("check_name", "failing_rows", "failing_pct")


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS year_month, o_totalprice FROM orders""")
def rewritten_by_month(spark, sf_dir):
    """A full rewrite partitioned by month, read back and verified."""
    path = f"{folder(spark)}/orders"
    o = read(spark, sf_dir, "orders")
    sinks.rewrite(o, path, "o_orderdate")
    back = spark.read.parquet(path)
    sinks.verify_written(back, o.count(), ["o_orderkey", "year_month"])
    return back.select("o_orderkey", F.col("year_month").cast("string").alias("year_month"), "o_totalprice")


@query("""SELECT o_custkey AS customer_id, DATE '2000-01-01' AS as_of_date, count(*) AS orders FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01' GROUP BY 1
    UNION ALL SELECT o_custkey, DATE '2001-01-01', count(*) FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01' GROUP BY 1""")
def published_partitions(spark, sf_dir):
    """One date's partition replaced per run; publishing a date twice leaves the other dates alone."""
    path = f"{folder(spark)}/scores"
    o = read(spark, sf_dir, "orders", "o_custkey", "o_orderdate")
    for day in ("2000-01-01", "2001-01-01", "2000-01-01"):
        counted = o.where(F.col("o_orderdate") < F.lit(day).cast("timestamp_ntz")).groupBy(F.col("o_custkey").alias("customer_id")).agg(F.count("*").alias("orders"))
        sinks.replace_partition(counted.withColumn("as_of_date", F.lit(day).cast("date")), path, ["as_of_date"])
    return spark.read.parquet(path).select("customer_id", "as_of_date", "orders")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS c_acctbal, concat_ws(',',
      CASE WHEN c_custkey % 5 = 0 OR c_custkey % 7 = 0 THEN 'required_missing' END, CASE WHEN c_custkey % 5 <> 0 AND c_acctbal < 0 THEN 'out_of_range' END,
      CASE WHEN c_custkey % 7 <> 0 AND NOT (c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')) THEN 'not_allowed' END) AS dq_reasons FROM customer""")
def streamed_ingest(spark, sf_dir):
    """Delivered CSV files as a stream, typed and flagged as they arrive."""
    root = folder(spark)
    c = read(spark, sf_dir, "customer")
    dirty = c.select(F.col("c_custkey").cast("string"), "c_name", F.col("c_nationkey").cast("string"), F.when(F.col("c_custkey") % 5 == 0, "oops").otherwise(F.col("c_acctbal").cast("string")).alias("c_acctbal"),
                     F.when(F.col("c_custkey") % 7 == 0, "null").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    readers.ingest(dirty, root, CUSTOMER, "2024-01-01")
    stream = jobs.ingest(readers.stream_bronze(spark, root, CUSTOMER), CUSTOMER, CATALOG)
    jobs.run_available(stream, f"{root}/silver/customer", f"{root}/progress")
    return spark.read.parquet(f"{root}/silver/customer").select("c_custkey", "c_acctbal", F.array_join("dq_reasons", ",").alias("dq_reasons"))


# ---- Evaluation-run structures ----

@query("""SELECT doc_id, concat_ws(',', CASE WHEN toxic = 1 THEN 'content:toxic' END, CASE WHEN quality = 0 THEN 'topic:quality' END, CASE WHEN doc_id % 4 = 0 THEN 'word:custom' END) AS policies FROM labels""")
def blocking_policies(spark, sf_dir):
    """Labels of the entries of nested assessments that blocked."""
    act = lambda c: F.when(c, "BLOCKED").otherwise("NONE")
    none = "cast(null as struct<piiEntities: array<struct<type: string, action: string>>, regexes: array<struct<name: string, action: string>>>)"
    one = F.struct(
        F.struct(F.array(F.struct(F.lit("quality").alias("name"), act(F.col("quality") == 0).alias("action"))).alias("topics")).alias("topicPolicy"),
        F.struct(F.array(F.struct(F.lit("toxic").alias("type"), act(F.col("toxic") == 1).alias("action"))).alias("filters")).alias("contentPolicy"),
        F.expr(none).alias("sensitiveInformationPolicy"),
        F.struct(F.array(F.struct(act(F.col("doc_id") % 4 == 0).alias("action"))).alias("customWords")).alias("wordPolicy"))
    return read(spark, sf_dir, "labels").select("doc_id", F.array_join(runs.blocked_labels(F.array(one, one)), ",").alias("policies"))


@query("""WITH a AS (SELECT p_partkey, p_brand, p_type, p_size FROM part WHERE p_brand <> 'Brand#2'), b AS (SELECT p_partkey, p_brand, p_type, p_size + CAST(p_partkey % 3 = 0 AS INT) AS p_size FROM part WHERE p_brand <> 'Brand#17'),
    x AS (SELECT 'part-' || p_partkey || '.brand' AS path, p_brand AS v FROM a UNION ALL SELECT 'part-' || p_partkey || '.box.size', p_size::VARCHAR FROM a UNION ALL SELECT 'part-' || p_partkey || '.box.kinds', '["' || p_type || '","' || p_size || '"]' FROM a),
    y AS (SELECT 'part-' || p_partkey || '.brand' AS path, p_brand AS v FROM b UNION ALL SELECT 'part-' || p_partkey || '.box.size', p_size::VARCHAR FROM b UNION ALL SELECT 'part-' || p_partkey || '.box.kinds', '["' || p_type || '","' || p_size || '"]' FROM b)
    SELECT path, CASE WHEN path LIKE '%.kinds' THEN 'list changed' ELSE 'changed' END AS change, x.v AS old, y.v AS new, CASE WHEN path LIKE '%.kinds' THEN json_extract_string(y.v, '$[1]') END AS items_added,
      CASE WHEN path LIKE '%.kinds' THEN json_extract_string(x.v, '$[1]') END AS items_removed FROM x JOIN y USING (path) WHERE x.v <> y.v
    UNION ALL SELECT 'part-' || p_partkey, 'only in B', NULL, NULL, NULL, NULL FROM b WHERE p_partkey NOT IN (SELECT p_partkey FROM a) UNION ALL SELECT 'part-' || p_partkey, 'only in A', NULL, NULL, NULL, NULL FROM a WHERE p_partkey NOT IN (SELECT p_partkey FROM b)""")
def configuration_changes(spark, sf_dir):
    """Nested settings of two runs flattened to paths and compared; one settings object per part."""
    p = read(spark, sf_dir, "part")

    def side(df, size):
        box = F.struct(size.alias("size"), F.array(F.col("p_type"), size.cast("string")).alias("kinds"))
        inner = F.to_json(F.struct(F.col("p_brand").alias("brand"), box.alias("box")))
        return df.select(F.concat(F.lit('{"part-'), F.col("p_partkey").cast("string"), F.lit('":'), inner, F.lit("}")).alias("config"))

    a = side(p.where("p_brand <> 'Brand#2'"), F.col("p_size"))
    b = side(p.where("p_brand <> 'Brand#17'"), F.col("p_size") + (F.col("p_partkey") % 3 == 0).cast("int"))
    return runs.config_changes(a, b).select("path", "change", "old", "new", "items_added", "items_removed")


@query("""SELECT o_custkey AS customer_id, o_orderkey AS complaint_id, CAST(o_orderdate AS DATE) AS creation_date, o_orderstatus AS status, o_orderpriority AS bk_priority FROM orders""")
def complaint_table(spark, sf_dir):
    """Complaints cut to listed columns; a column the source gains is reported and not copied."""
    rows = complaint_rows(spark, sf_dir)
    out = zone.customer_complaints(rows)
    if readers.classify_columns(rows, [c.removeprefix("bk_") for c in out.columns]) != ["internal_note"]:
        raise ValueError("an unlisted column was copied")
    return out.select("customer_id", "complaint_id", "creation_date", "status", "bk_priority")


def complaint_rows(spark, sf_dir):
    o, none = read(spark, sf_dir, "orders"), F.lit(None).cast("string")
    return o.select(F.col("o_custkey").alias("customer_id"), F.col("o_orderkey").alias("complaint_id"), F.to_date("o_orderdate").alias("creation_date"), F.col("o_orderstatus").alias("status"),
                    F.col("o_orderpriority").alias("priority"), *[none.alias(c) for c in (
                        "case_type", "category", "subcategory", "reception_channel", "description", "claimed_amount", "currency", "first_response_date", "resolution_date", "closing_date",
                        "resolution_days", "resolution", "compensation_granted", "affected_product_id", "assigned_agent_id", "sla_breached", "internal_note")])


# ---- The seven served tables as items ----

def served(table, frame, *columns):
    """Items of a table; a row that cannot become one stops the query."""
    return serving.all_items(serving.build_items(frame, serving.SPECS[table]), table).select("PK", "SK", *columns)


UTC_DAY = "strftime(CAST({} AS DATE), '%Y-%m-%dT00:00:00Z')"


@query(f"""SELECT 'CUST#' || o_custkey AS "PK", 'COMPLAINT#' || {UTC_DAY.format('o_orderdate')} || '#' || o_orderkey AS "SK", o_orderstatus AS status,
    CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS creation_date FROM orders""")
def served_complaints(spark, sf_dir):
    """The complaints spec."""
    return served("complaints", zone.customer_complaints(complaint_rows(spark, sf_dir)), "status", "creation_date")


@query(f"""WITH line AS (SELECT o_custkey AS cid, CAST(l_shipdate AS DATE) AS day, l_returnflag AS channel, lpad(l_orderkey::VARCHAR, 12, '0') || ':' || l_linenumber || ':' || lpad(l_partkey::VARCHAR, 12, '0') AS id
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey), k AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY day DESC, id DESC) AS place FROM line)
    SELECT 'CUST#' || cid AS "PK", 'CONTACT#' || {UTC_DAY.format('day')} || '#' || id AS "SK", channel FROM k WHERE place <= 10""")
def served_contacts(spark, sf_dir):
    """The contacts spec."""
    return served("contacts_recent", zone.recent_contacts(zone_tables(spark, sf_dir)[3]), "channel")


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders)
    SELECT 'CUST#' || o_custkey AS "PK", 'TXN#' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') || '#' || o_orderkey AS "SK", 'USD' AS currency,
      CASE WHEN o_orderkey % 2 = 0 THEN '****' || right(lpad(o_orderkey::VARCHAR, 16, '4'), 4) END AS product_number_masked FROM k WHERE place <= 20""")
def served_transactions(spark, sf_dir):
    """The transactions spec."""
    return served("transactions_recent", transactions_shown(spark, sf_dir), "currency", "product_number_masked")


@query("""WITH q AS (SELECT *, '****' || right(lpad(o_orderkey::VARCHAR, 16, '4'), 4) AS masked FROM orders),
    p AS (SELECT o_custkey AS cid, string_agg(o_orderpriority || ':' || masked || ':' || strftime(o_orderdate, '%m/%Y') || ':' || o_orderstatus || ':' || CAST(o_orderstatus = 'P' AS VARCHAR), ','
      ORDER BY o_orderpriority, masked, o_totalprice, o_orderdate) AS products FROM q GROUP BY 1)
    SELECT 'CUST#' || c_custkey AS "PK", 'PROFILE' AS "SK", c_name AS first_name, CASE WHEN p.cid IS NOT NULL THEN '2001-08-01' END AS as_of_date, p.products FROM customer LEFT JOIN p ON p.cid = c_custkey""")
def served_profiles(spark, sf_dir):
    """The profile spec, with its nested product list cut to what it may show."""
    items = served("customer_360", zone.customer_360(*zone_tables(spark, sf_dir)), "first_name", "as_of_date", "products")
    shown = F.transform("products", lambda p: F.concat_ws(":", *(p[c].cast("string") for c in ("product_type", "product_number_masked", "expires", "product_status", "bk_is_overdue"))))
    return items.withColumn("products", F.array_join(shown, ","))


@query("""SELECT 'REF#BRANCH' AS "PK", lower(replace(n_name, ' ', '_')) || '#' || s_suppkey AS "SK", s_name AS branch_name FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def served_branches(spark, sf_dir):
    """The branches spec, keyed by city."""
    none = F.lit(None).cast("string")
    held = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    other = [none.alias(c) for c in (*zone.BRANCH.plain.split(), *zone.BRANCH.backend.split()) if c not in ("branch_name", "city", "branch_id")]
    rows = held.select(F.col("s_name").alias("branch_name"), F.col("n_name").alias("city"), F.col("s_suppkey").alias("branch_id"), *other)
    return served("branches", zone.branch_directory(rows), "branch_name")


BROKEN = """CASE WHEN o_orderkey % 50 = 0 THEN 'missing customer_id' WHEN o_orderkey % 49 = 0 THEN 'missing transaction_date'
    WHEN o_orderkey % 48 = 0 THEN 'bk_transaction_id contains the key separator' WHEN o_orderkey % 1000 = 1 THEN 'item is about n bytes' END"""


@query(f"""SELECT {BROKEN} AS problem, o_orderkey AS row_id FROM orders WHERE {BROKEN} IS NOT NULL""")
def item_problems(spark, sf_dir):
    """Rows without a customer or a time, with a separator in their key, or too large, each named by its source key."""
    k, none = F.col("o_orderkey"), F.lit(None).cast("string")
    given = {"customer_id": F.when(k % 50 != 0, F.col("o_custkey")), "transaction_date": F.when(k % 49 != 0, F.col("o_orderdate")),
             "transaction_id": F.concat(k.cast("string"), F.when(k % 48 == 0, "#").otherwise("")), "merchant_name": F.when(k % 1000 == 1, F.repeat(F.lit("x"), F.lit(serving.MAX_ITEM_BYTES)))}
    names = (*zone.TRANSACTION.plain.split(), *zone.TRANSACTION.backend.split())
    rows = read(spark, sf_dir, "orders").select(*[given.get(c, none).alias(c) for c in names])
    _, problems = serving.build_items(rows.select(*zone.TRANSACTION.columns()), serving.SPECS["transactions_recent"])
    row_id = F.regexp_extract(F.get_json_object("source", "$.bk_transaction_id"), "^[0-9]+", 0).cast("bigint")
    return problems.select(F.regexp_replace("problem", "[0-9]+", "n").alias("problem"), row_id.alias("row_id"))


# ---- Table rules on rows whose columns follow from a key ----

OBJECTIVES, NAMED = dict(config.CAMPAIGN_OBJECTIVES), dict(config.CAMPAIGN_PRODUCTS)
CODES = (*OBJECTIVES, "ZZZ"), (*NAMED, "QQ")


def _pick(values, n):
    return "CASE " + " ".join(f"WHEN p_partkey % {len(values)} = {k} THEN {v}" for k, v in enumerate(values)) + " END" if n == 0 else \
        "CASE " + " ".join(f"WHEN (p_partkey // {n}) % {len(values)} = {k} THEN {v}" for k, v in enumerate(values)) + " END"


def _looked_up(column, mapping):
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items() if v) + " END"


CAMPAIGN_SQL = f"""c AS (SELECT p_partkey, {_pick([f"'{c}'" for c in CODES[0]], 0)} AS oc, {_pick([f"'{c}'" for c in CODES[1]], 6)} AS pc,
      DATE '2024-01-10' + CAST(p_partkey % 500 AS INT) AS started, p_partkey % 7 = 0 AS odd_month, p_partkey % 11 = 0 AS short FROM part),
    n AS (SELECT *, {_looked_up('oc', OBJECTIVES)} AS objective, {_looked_up('pc', NAMED)} AS product, started + 40 AS ended,
      started + CASE WHEN p_partkey % 13 = 0 THEN 90 ELSE 20 END AS named_day FROM c),
    k AS (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN 'Retention' ELSE objective END AS stated_objective,
      CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 17 = 0 THEN 'Seguro' ELSE product END AS stated_product, CASE WHEN p_partkey % 2 = 0 THEN 'given' END AS stated_text,
      CASE WHEN NOT odd_month THEN date_trunc('month', named_day)::DATE END AS month FROM n)"""


@query(f"""WITH {CAMPAIGN_SQL} SELECT p_partkey, oc AS objective_code, pc AS product_code, month AS campaign_month, CASE WHEN NOT short THEN CAST(p_partkey AS INT) END AS campaign_seq,
    short OR odd_month OR objective IS NULL OR pc = 'QQ' AS wrong_name,
    coalesce(NOT (month BETWEEN date_trunc('month', started) AND date_trunc('month', ended)), false) OR coalesce(stated_product <> product, false) OR coalesce(stated_objective <> objective, false) AS name_mismatch,
    coalesce(stated_objective, objective) AS campaign_objective, stated_objective IS NULL AND objective IS NOT NULL AS campaign_objective_imputed,
    coalesce(stated_product, product) AS promoted_product, stated_product IS NULL AND product IS NOT NULL AS promoted_product_imputed,
    coalesce(stated_text, 'Campaña de ' || lower(coalesce(stated_objective, objective)) || ' para ' || coalesce(stated_product, product)) AS description,
    stated_text IS NULL AND coalesce(stated_objective, objective) IS NOT NULL AND coalesce(stated_product, product) IS NOT NULL AS description_imputed FROM k""")
def campaign_rules(spark, sf_dir):
    """What a campaign's name says, names that say nothing or something else, and objective, product and description filled from it."""
    p = read(spark, sf_dir, "part", "p_partkey")
    at = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.floor(F.col("p_partkey") / n) % len(values) + 1).cast("int"))
    hit = lambda n: F.col("p_partkey") % n == 0
    rows = p.withColumns({"oc": at(CODES[0], 1), "pc": at(CODES[1], 6), "start_date": F.date_add(F.lit("2024-01-10").cast("date"), (F.col("p_partkey") % 500).cast("int"))})
    month = F.when(hit(7), "Foo2025").otherwise(F.date_format(F.date_add("start_date", F.when(hit(13), 90).otherwise(20)), "MMMyyyy"))
    rows = rows.withColumns({
        "end_date": F.date_add("start_date", 40), "campaign_name": F.concat_ws("_", F.lit("CMP"), "oc", "pc", month, F.when(~hit(11), F.col("p_partkey").cast("string"))),
        "campaign_objective": F.when(hit(3), None).when(hit(5), "Retention").otherwise(map_value(OBJECTIVES, F.col("oc"))),
        "promoted_product": F.when(hit(4), None).when(hit(17), "Seguro").otherwise(map_value({k: v for k, v in NAMED.items() if v}, F.col("pc"))), "description": F.when(hit(2), "given")})
    out = table_rules.apply_rules(rows, "marketing_campaigns")
    return out.select("p_partkey", "objective_code", "product_code", "campaign_month", "campaign_seq", F.col("dq_invalid_campaign_name").alias("wrong_name"),
                      F.coalesce("dq_invalid_name_mismatch", F.lit(False)).alias("name_mismatch"),
                      *(c for n in ("campaign_objective", "promoted_product", "description") for c in (n, f"{n}_imputed")))


@query("""SELECT l_orderkey, l_linenumber, l_shipdate, l_linenumber % 4 = 0 AS other_caller, o_orderstatus = 'F' AND l_linenumber % 3 = 0 AS other_owner,
    CAST(l_shipdate AS DATE) < CAST(o_orderdate AS DATE) + 30 AS before_opening FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def parent_contradictions(spark, sf_dir):
    """A survey of another customer than the call it is about, a transaction of another customer than its product's, or before that was opened."""
    li, o = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate"), read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    joined = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    asked = joined.withColumns({"_caller": F.col("o_custkey"), "customer_id": F.col("o_custkey") + F.when(F.col("l_linenumber") % 4 == 0, 1).otherwise(0)})
    asked = silver.cross_table(asked, "satisfaction_surveys", None)
    traded = asked.withColumns({"customer_id": F.col("o_custkey"), "_owner": F.when((F.col("o_orderstatus") == "F") & (F.col("l_linenumber") % 3 == 0), -1).otherwise(F.col("o_custkey")),
                                "_opened": F.date_add(F.to_date("o_orderdate"), 30), "transaction_date": F.col("l_shipdate")})
    out = silver.cross_table(traded, "transactions", None)
    return out.select("l_orderkey", "l_linenumber", "l_shipdate", F.col("dq_invalid_interaction_customer_mismatch").alias("other_caller"),
                      F.col("dq_invalid_product_owner_mismatch").alias("other_owner"), F.col("dq_invalid_before_product_opening").alias("before_opening"))


@query("""SELECT event_id, event_id % 5 = 0 AS corrupt, CASE WHEN event_id % 5 <> 0 THEN CAST(event_id % 4 AS INT) END AS account_numbers,
    CASE WHEN event_id % 5 <> 0 AND event_id % 3 <> 0 THEN CAST(event_id % 6 AS INT) END AS dates, CASE WHEN event_id % 5 <> 0 THEN CAST(round(value) AS INT) END AS amounts,
    CASE WHEN event_id % 5 <> 0 THEN event_type END AS products FROM events""")
def parsed_entities(spark, sf_dir):
    """A transcript's entities from their JSON, and texts that are none."""
    e = read(spark, sf_dir, "events", "event_id", "event_type", "value")
    given = F.to_json(F.struct((F.col("event_id") % 4).alias("account_numbers"), F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 6).alias("dates"),
                               F.round("value").cast("int").alias("amounts"), F.col("event_type").alias("products")))
    rows = e.withColumn("mentioned_entities", F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("{broken: "), given)).otherwise(given))
    out = table_rules.apply_rules(rows, "call_transcripts")
    return out.select("event_id", F.col("dq_invalid_entities_json").alias("corrupt"), *(F.col(f"entities_{n}").alias(n) for n in ("account_numbers", "dates", "amounts", "products")))


@query("""SELECT o_orderkey, o_orderkey % 3 = 0 AND (o_orderkey % 2 = 0 OR o_orderkey % 7 = 0) AS amount_usd_imputed, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice WHEN o_orderkey % 2 = 0 THEN 0.0
      WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS amount_usd, o_orderkey % 9 = 0 AS misplaced FROM orders""")
def usd_amounts(spark, sf_dir):
    """Dollar rows whose dollar amount is written as 0 or not at all take their own, and places outside their country."""
    o, key = read(spark, sf_dir, "orders", "o_orderkey", "o_totalprice"), F.col("o_orderkey")
    rows = o.withColumns({"currency": F.when(key % 3 == 0, "USD").otherwise("MXN"), "amount": F.col("o_totalprice"),
                          "amount_usd": F.when(key % 2 == 0, 0.0).when(key % 7 != 0, F.col("o_totalprice")), "transaction_country": F.lit("México"),
                          "latitude": F.when(key % 9 == 0, 60.0).otherwise(19.4), "longitude": F.lit(-99.1)})
    out = table_rules.apply_rules(rows, "transactions")
    return out.select("o_orderkey", "amount_usd_imputed", "amount_usd", F.col("dq_invalid_location").alias("misplaced"))


@query("""SELECT event_id, event_type, value, CAST(ts AS DATE) AS filed, DATE '2024-02-01' AS ingest_date FROM events""")
def daily_delivery(spark, sf_dir):
    """A delivery in year=, month= and day= folders, read back with the day of each row's file."""
    from tidemark.config.model import table

    spec = table("events", "event_id", "event_id:long! event_type! value:double ts:timestamp_ntz!")
    root = folder(spark)
    readers.ingest(read(spark, sf_dir, "events"), root, spec, "2024-02-01", daily_by="ts")
    out = cleaning.clean(readers.read_bronze(spark, root, spec), spec)
    return out.select("event_id", "event_type", "value", arrivals.file_day(F.col("_source_file")).alias("filed"), "ingest_date")
