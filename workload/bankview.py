"""The driver's orders and line items seen as a customer's transactions, sends, contacts and products.

Transactions are orders: status P is a declined attempt, F a purchase, O a payment, and the priority is the
category. Line items are what happens around them. Every column is derived from the given tables.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tidemark.plans import features as feat
from tidemark.session import stored
from workload.tables import PRIORITIES, read

CUTOFFS = (date(1997, 1, 1), date(1998, 1, 1), date(1999, 1, 1), date(2000, 1, 1))
TRAIN, VALID = CUTOFFS[:3], CUTOFFS[3:]

# The same views in SQL, for the twins.
SQL = {
    "txn": """txn AS (SELECT o_orderkey AS id, o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS day, o_orderdate AS ts,
        CASE o_orderstatus WHEN 'P' THEN 'Declined' ELSE 'Approved' END AS status,
        CASE o_orderstatus WHEN 'O' THEN 'Payment' ELSE 'Purchase' END AS kind, o_orderpriority AS category,
        o_totalprice AS usd FROM orders)""",
    "act": "act AS (SELECT * FROM txn WHERE status = 'Approved')",
    "cust": """cust AS (SELECT c_custkey AS customer_id,
        CASE WHEN c_custkey % 11 <> 0 THEN DATE '1994-06-01' + CAST(c_custkey % 1500 AS INT) END AS registered FROM customer)""",
    "line": """line AS (SELECT o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS sent, CAST(l_shipdate AS DATE) AS shipped,
        l_linestatus = 'F' AS delivered, l_returnflag AS flag, l_linenumber AS num, l_orderkey, l_partkey
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey)""",
}


def sql(*names: str) -> str:
    return "WITH " + ",\n ".join(SQL[n] for n in names)


def transactions(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("transaction_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").alias("transaction_date"),
        F.when(F.col("o_orderstatus") == "P", "Declined").otherwise("Approved").alias("transaction_status"),
        F.when(F.col("o_orderstatus") == "O", "Payment").otherwise("Purchase").alias("transaction_type"),
        F.col("o_orderpriority").alias("transaction_category"), F.lit(None).cast("string").alias("merchant_category"),
        F.col("o_totalprice").alias("amount"), F.lit("USD").alias("currency"), F.col("o_totalprice").alias("amount_usd"),
        F.array().cast("array<string>").alias("dq_reasons"))


def activity(spark, sf_dir):
    return feat.eligible_activity(transactions(spark, sf_dir), ("orphan_customers",))


def spend(spark, sf_dir):
    return transactions(spark, sf_dir).where("transaction_status = 'Approved'").select(
        "transaction_id", "customer_id", F.col("transaction_date").alias("ts"), F.col("transaction_category").alias("category"), "amount_usd")


def customers(spark, sf_dir):
    c = read(spark, sf_dir, "customer", "c_custkey")
    day = F.date_add(F.lit("1994-06-01").cast("date"), (F.col("c_custkey") % 1500).cast("int"))
    return c.select(F.col("c_custkey").alias("customer_id"), F.when(F.col("c_custkey") % 11 != 0, day).alias("registration_date"))


def lines(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate")
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("customer_id"), F.to_date("o_orderdate").alias("sent"), F.to_date("l_shipdate").alias("shipped"),
        (F.col("l_linestatus") == "F").alias("delivered"), F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("num"),
        "l_orderkey", "l_partkey")


def sends(spark, sf_dir):
    return sends_of(lines(spark, sf_dir))


def sends_of(rows):
    """A line is a send on its order's day; it is opened when shipped, and clicked when returned then."""
    return rows.select(
        "customer_id", F.col("sent").alias("send_date"), F.col("flag").alias("send_channel"), F.col("delivered").alias("was_delivered"),
        (F.col("flag") != "N").alias("was_opened"), (F.col("flag") == "R").alias("was_clicked"),
        F.when(F.col("flag") != "N", F.col("shipped")).alias("open_date"), F.when(F.col("flag") == "R", F.col("shipped")).alias("click_date"))


def snapshots(spark, sf_dir, cutoffs=CUTOFFS, labels=True):
    # five tables are seen in this join: it is made once, by column
    rows = stored(lines(spark, sf_dir).drop("l_orderkey", "l_partkey"), "lines")
    digital = rows.select("customer_id", F.col("shipped").alias("day"), (F.col("num") == 1).cast("int").alias("logins"))
    return feat.customer_snapshots(
        activity(spark, sf_dir), feat.declined_attempts(transactions(spark, sf_dir), ("orphan_customers",)), customers(spark, sf_dir),
        rows.where("num = 2").select("customer_id", F.col("shipped").alias("opening_date")), sends_of(rows),
        rows.where("num = 3").select("customer_id", F.col("shipped").alias("interaction_date")),
        rows.where("num = 4").select("customer_id", F.col("shipped").alias("creation_date")), digital, cutoffs, labels)


SNAP_SQL = "snap AS (SELECT unnest([{}]) AS t)".format(", ".join(f"DATE '{c}'" for c in CUTOFFS))

SNAPSHOTS_SQL = sql("txn", "act", "cust", "line") + f""",
    {SNAP_SQL},
    hist AS (SELECT a.*, t, date_diff('day', day, t) AS age FROM act a, snap WHERE day < t AND date_diff('day', day, t) <= 365),
    tx AS (SELECT customer_id, t,
        count(*) FILTER (WHERE age <= 30) AS txn_count_30d, count(*) FILTER (WHERE age <= 90) AS txn_count_90d,
        count(*) FILTER (WHERE age <= 180) AS txn_count_180d,
        coalesce(sum(CAST(usd AS DECIMAL(18,6))) FILTER (WHERE age <= 30), 0) AS spend_usd_30d,
        coalesce(sum(CAST(usd AS DECIMAL(18,6))) FILTER (WHERE age <= 90), 0) AS spend_usd_90d,
        coalesce(sum(CAST(usd AS DECIMAL(18,6))) FILTER (WHERE age <= 180), 0) AS spend_usd_180d,
        count(DISTINCT day) FILTER (WHERE age <= 90) AS active_days_90d, count(DISTINCT day) FILTER (WHERE age <= 180) AS active_days_180d,
        min(age) AS days_since_last_txn, count(DISTINCT kind) FILTER (WHERE age <= 180) AS n_txn_types_180d,
        count(DISTINCT category) FILTER (WHERE age <= 180) AS n_categories_180d,
        count(*) FILTER (WHERE age > 30 AND age <= 90) AS p60, count(*) FILTER (WHERE age > 90 AND age <= 180) AS p90, max(ts) AS last_ts_used
        FROM hist GROUP BY ALL),
    dec AS (SELECT customer_id, t, count(*) AS n FROM txn, snap WHERE status = 'Declined' AND day < t AND date_diff('day', day, t) <= 90 GROUP BY ALL),
    prod AS (SELECT customer_id, t, count(*) AS n FROM line, snap WHERE num = 2 AND shipped < t GROUP BY ALL),
    con AS (SELECT customer_id, t, count(*) AS n FROM line, snap WHERE num = 3 AND shipped < t AND date_diff('day', shipped, t) <= 180 GROUP BY ALL),
    com AS (SELECT customer_id, t, count(*) AS n FROM line, snap WHERE num = 4 AND shipped < t AND date_diff('day', shipped, t) <= 180 GROUP BY ALL),
    snd AS (SELECT customer_id, t, count(*) FILTER (WHERE date_diff('day', sent, t) <= 180) AS sends,
        count(*) FILTER (WHERE flag <> 'N' AND shipped < t AND date_diff('day', shipped, t) <= 180) AS opens,
        count(*) FILTER (WHERE flag = 'R' AND shipped < t AND date_diff('day', shipped, t) <= 180) AS clicks,
        min(date_diff('day', shipped, t)) FILTER (WHERE flag = 'R' AND shipped < t) AS click_age
        FROM line, snap WHERE sent < t AND date_diff('day', sent, t) <= 365 GROUP BY ALL),
    dig AS (SELECT customer_id, t, count(*) FILTER (WHERE num = 1 AND age <= 90) AS logins, count(DISTINCT shipped) FILTER (WHERE age <= 90) AS days,
        min(age) FILTER (WHERE num = 1) AS login_age FROM (SELECT customer_id, t, num, shipped, date_diff('day', shipped, t) AS age FROM line, snap
            WHERE shipped < t AND date_diff('day', shipped, t) <= 365) GROUP BY ALL),
    fut AS (SELECT customer_id, t, count(*) AS n FROM act, snap WHERE day >= t AND date_diff('day', t, day) < 90 GROUP BY ALL),
    rows_ AS (SELECT tx.customer_id, tx.t AS snapshot_date, txn_count_30d, CAST(spend_usd_30d AS DOUBLE) AS spend_usd_30d, txn_count_90d,
        CAST(spend_usd_90d AS DOUBLE) AS spend_usd_90d, txn_count_180d, CAST(spend_usd_180d AS DOUBLE) AS spend_usd_180d, active_days_90d, active_days_180d,
        days_since_last_txn, n_txn_types_180d, n_categories_180d, txn_count_30d / 30.0 - p60 / 60.0 AS count_trend_30d_vs_prior60d,
        txn_count_90d / (p90 + 1.0) AS count_ratio_90d_vs_prior90d, txn_count_180d / greatest(active_days_180d, 1) AS txns_per_active_day_180d,
        coalesce(dec.n, 0) AS declined_count_90d, date_diff('day', registered, tx.t) AS tenure_days, coalesce(prod.n, 0) AS products_opened,
        coalesce(sends, 0) AS sends_180d, coalesce(opens, 0) AS opens_180d, coalesce(clicks, 0) AS clicks_180d,
        least(coalesce(click_age, 999), 999) AS days_since_last_click, coalesce(con.n, 0) AS contacts_180d, coalesce(com.n, 0) AS complaints_180d,
        coalesce(logins, 0) AS logins_90d, coalesce(days, 0) AS digital_active_days_90d, least(coalesce(login_age, 999), 999) AS days_since_last_login,
        last_ts_used, coalesce(fut.n, 0) AS fut_txn_count, CAST(coalesce(fut.n, 0) < 2 AS INT) AS low_engagement_next_90d
        FROM tx JOIN cust USING (customer_id)
        LEFT JOIN dec ON dec.customer_id = tx.customer_id AND dec.t = tx.t LEFT JOIN prod ON prod.customer_id = tx.customer_id AND prod.t = tx.t
        LEFT JOIN con ON con.customer_id = tx.customer_id AND con.t = tx.t LEFT JOIN com ON com.customer_id = tx.customer_id AND com.t = tx.t
        LEFT JOIN snd ON snd.customer_id = tx.customer_id AND snd.t = tx.t LEFT JOIN dig ON dig.customer_id = tx.customer_id AND dig.t = tx.t
        LEFT JOIN fut ON fut.customer_id = tx.customer_id AND fut.t = tx.t WHERE registered < tx.t)"""
