"""Cleaning, deduplication, contracts, references and quality reports over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.operators import contracts, dedup, flags, gates, references, reports
from tidemark.operators.ordering import latest_per_key
from tidemark.config.model import Reference
from tidemark.session import ensure_checkpoint_dir
from workload.registry import query
from workload.tables import CATALOG, CUSTOMER, LABELS, LINEITEM, ORDERS, PART, SUPPLIER, read, reader

LINE_KEY = ["l_orderkey", "l_linenumber"]
LINE_REST = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
LINE_COLUMNS = LINEITEM.source_columns
LINE_ORDER_SQL = "l_shipdate DESC, " + ", ".join(f"{c} DESC" for c in LINE_REST)
LINE_ALL_SQL = ", ".join(LINE_COLUMNS)

KEPT_SQL = f"""
    kept AS (
        SELECT {LINE_ALL_SQL}, dq_copies, dq_versions FROM (
            SELECT l.*, count(*) OVER k AS dq_copies,
                   row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {LINE_ORDER_SQL}) AS rn
            FROM lineitem l WINDOW k AS (PARTITION BY l_orderkey, l_linenumber)) w
        JOIN (SELECT l_orderkey, l_linenumber, count(*) AS dq_versions
              FROM (SELECT DISTINCT {LINE_ALL_SQL} FROM lineitem) d GROUP BY ALL) v USING (l_orderkey, l_linenumber)
        WHERE rn = 1)"""


def kept_lines(spark, sf_dir):
    newest = [F.col("l_shipdate").desc(), *[F.col(c).desc() for c in LINE_REST]]  # total, so the SQL twin agrees
    return dedup.keep_latest(read(spark, sf_dir, "lineitem"), LINE_KEY, newest, LINE_COLUMNS)


@query(f"WITH {KEPT_SQL} SELECT {LINE_ALL_SQL}, dq_copies, dq_versions FROM kept")
def keep_latest_lines(spark, sf_dir):
    """One row per (order, line), with copies and versions."""
    return kept_lines(spark, sf_dir).select(*LINE_COLUMNS, "dq_copies", "dq_versions")


@query(f"""WITH {KEPT_SQL}
    SELECT 'lineitem' AS "table", CAST(sum(dq_copies) AS BIGINT) AS rows_in, count(*) AS rows_out,
           CAST(sum(dq_copies) AS BIGINT) - count(*) AS rows_removed,
           count(*) FILTER (WHERE dq_copies > 1) AS duplicate_keys,
           CAST(sum(dq_copies - dq_versions) AS BIGINT) AS exact_duplicates,
           count(*) FILTER (WHERE dq_versions > 1) AS conflicting_keys,
           CAST(sum(dq_versions - 1) AS BIGINT) AS conflicting_duplicates FROM kept""")
def duplicate_report(spark, sf_dir):
    """E04."""
    return dedup.duplicate_report(kept_lines(spark, sf_dir), "lineitem")


def line_sources(spark, sf_dir):
    """Parents as the line checks see them: orders still open are not delivered yet, so their lines are orphans."""
    tables = reader(spark, sf_dir)

    def parent(name):
        return tables(name).where("o_orderstatus <> 'P'") if name == "orders" else tables(name)

    return parent


def checked_lines(spark, sf_dir):
    kept = kept_lines(spark, sf_dir)
    flagged = contracts.add_contract_flags(kept, LINEITEM, CATALOG)
    parent = line_sources(spark, sf_dir)
    flagged = references.add_orphan_flags(flagged, LINEITEM, parent, {"part": {"_size": "p_size"}})
    flagged = flagged.withColumn("dq_invalid_part_contradicts", F.col("l_quantity") < F.col("_size")).drop("_size")
    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    flagged = references.contradicts_parent(
        flagged, orders, {"l_orderkey": "o_orderkey"}, {"_ordered": "o_orderdate"},
        {"dq_invalid_before_order": F.to_date("l_shipdate") < F.to_date("_ordered")},
    )
    return flags.fold_validity(flagged)


# reasons in the order the flags are added
CHECKED_SQL = f"""WITH {KEPT_SQL},
    checked AS (
        SELECT k.*, coalesce(NOT (l_returnflag IN ('A', 'N')) OR NOT (l_linestatus IN ('O', 'F')), false) AS not_allowed,
               coalesce(NOT (l_quantity BETWEEN 1 AND 45) OR NOT (l_discount BETWEEN 0 AND 0.08)
                        OR l_extendedprice < 1000, false) AS out_of_range,
               coalesce(NOT (CAST(l_shipdate AS DATE) BETWEEN DATE '1995-06-01' AND DATE '2001-06-01'), false) AS outside_dataset,
               (l_quantity IS NULL OR l_extendedprice IS NULL OR l_shipdate IS NULL) AS required_missing,
               (p.o_orderkey IS NULL) AS orphan_orders, (a.p_partkey IS NULL) AS orphan_part, coalesce(l_quantity < a.p_size, false) AS part_contradicts,
               (l_suppkey IS NOT NULL AND s.s_suppkey IS NULL) AS orphan_supplier,
               coalesce(CAST(l_shipdate AS DATE) < CAST(o.o_orderdate AS DATE), false) AS before_order
        FROM kept k
        LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') p ON p.o_orderkey = k.l_orderkey
        LEFT JOIN part a ON a.p_partkey = k.l_partkey
        LEFT JOIN supplier s ON s.s_suppkey = k.l_suppkey
        LEFT JOIN orders o ON o.o_orderkey = k.l_orderkey)"""
REASONS_SQL = """concat_ws(',', CASE WHEN required_missing THEN 'required_missing' END,
    CASE WHEN out_of_range THEN 'out_of_range' END, CASE WHEN not_allowed THEN 'not_allowed' END,
    CASE WHEN outside_dataset THEN 'outside_dataset' END,
    CASE WHEN orphan_orders THEN 'orphan_orders' END, CASE WHEN orphan_part THEN 'orphan_part' END,
    CASE WHEN orphan_supplier THEN 'orphan_supplier' END, CASE WHEN part_contradicts THEN 'part_contradicts' END, CASE WHEN before_order THEN 'before_order' END)"""


@query(f"""{CHECKED_SQL} SELECT l_orderkey, l_linenumber, dq_copies, dq_versions, {REASONS_SQL} AS dq_reasons,
    {REASONS_SQL} = '' AS dq_is_valid FROM checked""")
def flag_lines(spark, sf_dir):
    """Contract, reference and cross-table flags folded into reasons."""
    return checked_lines(spark, sf_dir).select(
        *LINE_KEY, "dq_copies", "dq_versions", F.array_join("dq_reasons", ",").alias("dq_reasons"), "dq_is_valid")


RULE_COLUMNS = ["required_missing", "not_allowed", "out_of_range", "outside_dataset", "orphan_orders", "orphan_part",
                "orphan_supplier", "part_contradicts", "before_order"]
RULE_SQL = "\n UNION ALL ".join(
    f"SELECT '{c}' AS rule, count(*) FILTER (WHERE {c}) AS failing_rows, count(*) AS \"rows\" FROM checked" for c in RULE_COLUMNS)
CHECK_SQL = {
    "required_missing:l_quantity": "l_quantity IS NULL", "required_missing:l_extendedprice": "l_extendedprice IS NULL",
    "required_missing:l_shipdate": "l_shipdate IS NULL",
    "out_of_range:l_quantity": "NOT (l_quantity BETWEEN 1 AND 45)",
    "out_of_range:l_extendedprice": "l_extendedprice < 1000", "out_of_range:l_discount": "NOT (l_discount BETWEEN 0 AND 0.08)",
    "not_allowed:l_returnflag": "NOT (l_returnflag IN ('A', 'N'))", "not_allowed:l_linestatus": "NOT (l_linestatus IN ('O', 'F'))",
    "outside_dataset:l_shipdate": "outside_dataset",
}
CHECKS_SQL = "\n UNION ALL ".join(
    f"SELECT '{n}' AS rule, count(*) FILTER (WHERE {c}) AS failing_rows, count(*) AS \"rows\" FROM checked" for n, c in CHECK_SQL.items())


@query(f"""{CHECKED_SQL}, r AS ({RULE_SQL} UNION ALL SELECT 'missing_key', 0, count(*) FROM checked UNION ALL {CHECKS_SQL})
    SELECT 'lineitem' AS "table", rule, failing_rows, "rows", round(100.0 * failing_rows / "rows", 3) AS failing_pct FROM r""")
def rule_report(spark, sf_dir):
    """Failing rows per flag and per contract check."""
    return reports.rule_report(contracts.full_counts(checked_lines(spark, sf_dir), LINEITEM, CATALOG), "lineitem")


@query(f"""{CHECKED_SQL}, r AS (
      SELECT 'l_orderkey' AS child_column, 'orders' AS parent_table, 'o_orderkey' AS parent_column, false AS nullable,
             count(*) AS child_rows, count(*) FILTER (WHERE l_orderkey IS NULL) AS null_rows, count(*) AS checked_rows,
             count(*) FILTER (WHERE orphan_orders) AS orphan_rows FROM checked
      UNION ALL SELECT 'l_partkey', 'part', 'p_partkey', false, count(*), count(*) FILTER (WHERE l_partkey IS NULL), count(*),
             count(*) FILTER (WHERE orphan_part) FROM checked
      UNION ALL SELECT 'l_suppkey', 'supplier', 's_suppkey', true, count(*), count(*) FILTER (WHERE l_suppkey IS NULL),
             count(*) FILTER (WHERE l_suppkey IS NOT NULL), count(*) FILTER (WHERE orphan_supplier) FROM checked),
    p AS (SELECT *, round(100.0 * orphan_rows / checked_rows, 3) AS orphan_pct FROM r)
    SELECT 'lineitem' AS child_table, *, CASE WHEN checked_rows = 0 THEN 'not_checkable' WHEN orphan_pct > 5 THEN 'fail'
           WHEN orphan_pct > 1 THEN 'warn' ELSE 'ok' END AS status, '' AS note FROM p""")
def foreign_key_report(spark, sf_dir):
    """G04, D31's input."""
    return references.reference_report(checked_lines(spark, sf_dir), LINEITEM, line_sources(spark, sf_dir))


@query("""SELECT 'supplier' AS child_table, 's_nationkey' AS child_column, 'nation' AS parent_table,
      'n_nationkey' AS parent_column, false AS nullable, count(*) AS child_rows,
      count(*) FILTER (WHERE s_nationkey IS NULL) AS null_rows, count(*) AS checked_rows,
      count(*) FILTER (WHERE n_nationkey IS NULL) AS orphan_rows,
      round(100.0 * count(*) FILTER (WHERE n_nationkey IS NULL) / count(*), 3) AS orphan_pct,
      'known_broken' AS status, 'kept as an example of an unusable key' AS note
    FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON s_nationkey = n_nationkey""")
def known_broken_reference_report(spark, sf_dir):
    """A key that is reported but not flagged, counted with an anti join."""
    tables = reader(spark, sf_dir)
    return references.reference_report(read(spark, sf_dir, "supplier"), SUPPLIER,
                                       lambda n: tables(n).where("n_regionkey < 3") if n == "nation" else tables(n))


@query("""SELECT c_custkey,
      concat_ws(',', CASE WHEN NOT (c_acctbal >= 0) THEN 'out_of_range' END,
                CASE WHEN NOT (c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')) THEN 'not_allowed' END,
                CASE WHEN count(*) OVER (PARTITION BY c_acctbal) > 1 AND c_acctbal IS NOT NULL THEN 'not_unique' END) AS dq_reasons
    FROM customer""")
def unique_and_allowed_customers(spark, sf_dir):
    """Uniqueness by counting and joining back."""
    flagged = flags.fold_validity(contracts.add_contract_flags(read(spark, sf_dir, "customer"), CUSTOMER, CATALOG))
    return flagged.select("c_custkey", F.array_join("dq_reasons", ",").alias("dq_reasons"))


@query("""WITH c AS (SELECT 'p_type' AS "column", 'not_allowed' AS "check",
          count(*) FILTER (WHERE NOT (p_type IN ('ECONOMY', 'SMALL', 'PROMO'))) AS n FROM part
      UNION ALL SELECT 'p_size', 'out_of_range', count(*) FILTER (WHERE NOT (p_size BETWEEN 1 AND 40)) FROM part
      UNION ALL SELECT 'p_name', 'not_unique', (SELECT count(*) FROM (SELECT count(*) OVER (PARTITION BY p_name) AS k FROM part) WHERE k > 1))
    SELECT 'part' AS "table", 'DATA' AS category,
           CASE WHEN "check" = 'not_unique' THEN 'DUPLICATES' ELSE 'DATAFRAME_CHECK' END AS error_type, "column", "check",
           CASE "check" WHEN 'not_allowed' THEN 'one of ECONOMY, SMALL, PROMO' WHEN 'out_of_range' THEN '1 to 40'
                ELSE 'unique(p_name)' END AS error
    FROM c WHERE n > 0 UNION ALL VALUES ('part', 'SCHEMA', 'COLUMN_NOT_IN_DATAFRAME', 'p_brand', 'column_in_dataframe', 'column ''p_brand'' not in dataframe'),
      ('part', 'SCHEMA', 'WRONG_DATATYPE', 'p_size', 'dtype(''int'')', 'expected column ''p_size'' to have type int, got bigint')""")
def contract_findings(spark, sf_dir):
    """The failed checks of a table that lacks a column and has another of a wrong type."""
    parts = read(spark, sf_dir, "part").drop("p_brand").withColumn("p_size", F.col("p_size").cast("bigint"))
    return contracts.findings(parts, PART, CATALOG)


@query("""SELECT count(*) AS "rows", count(*) FILTER (WHERE s_name IS NULL) AS "required_missing:s_name",
    count(*) FILTER (WHERE s_acctbal IS NULL) AS "required_missing:s_acctbal", count(*) FILTER (WHERE NOT (s_acctbal BETWEEN 0 AND 9000)) AS "out_of_range:s_acctbal",
    (SELECT count(*) FROM (SELECT count(*) OVER (PARTITION BY s_name) AS k FROM supplier) WHERE k > 1) AS "not_unique:s_name" FROM supplier""")
def contract_counts(spark, sf_dir):
    """Failing rows per check in one pass."""
    return contracts.failing_counts(read(spark, sf_dir, "supplier"), SUPPLIER, CATALOG)


@query("""SELECT o_orderkey, o_totalprice, coalesce(round(last_line_price, 2), 0) AS last_line_price,
      CASE WHEN o_orderstatus = 'P' THEN 'PENDING' ELSE o_orderstatus END AS o_orderstatus,
      o_orderstatus = 'P' AS state_imputed, last_ship IS NOT NULL AND CAST(o_orderdate AS DATE) <> last_ship AS last_ship_mismatch
    FROM orders LEFT JOIN (SELECT l_orderkey, max(CAST(l_shipdate AS DATE)) AS last_ship, max(l_extendedprice) AS last_line_price
                           FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey""")
def last_child_and_imputation(spark, sf_dir):
    """Recorded last date against the children's, and nulls filled with a marker."""
    orders, lines = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem", "l_orderkey", "l_shipdate", "l_extendedprice")
    children = lines.withColumnRenamed("l_orderkey", "o_orderkey")
    checked = references.last_child_mismatch(orders, children, "o_orderkey", "l_shipdate", "o_orderdate", "last_ship_mismatch")
    price = children.groupBy("o_orderkey").agg(F.max("l_extendedprice").alias("last_line_price"))
    holed = checked.join(price, "o_orderkey", "left").withColumn("state", F.nullif("o_orderstatus", F.lit("P")))
    filled = flags.impute(holed, {"state": F.lit("PENDING")})
    return filled.select("o_orderkey", "o_totalprice",
                         F.coalesce(F.round("last_line_price", 2), F.lit(0.0)).alias("last_line_price"),
                         F.col("state").alias("o_orderstatus"), "state_imputed", "last_ship_mismatch")


GATE = ["orphan_orders", "outside_dataset"]


@query(f"""{CHECKED_SQL} SELECT l_orderkey, l_linenumber FROM checked WHERE NOT (orphan_orders OR outside_dataset)""")
def usable_lines(spark, sf_dir):
    """Rows whose reasons overlap the exclusion list are left out."""
    return flags.usable_rows(checked_lines(spark, sf_dir), GATE).select(*LINE_KEY)


@query(f"""{CHECKED_SQL} SELECT 'lineitem' AS "table", count(*) AS rows_in,
      count(*) FILTER (WHERE orphan_orders OR outside_dataset) AS rows_excluded,
      count(*) FILTER (WHERE orphan_orders) AS orphan_orders, count(*) FILTER (WHERE outside_dataset) AS outside_dataset
    FROM checked""")
def exclusion_counts(spark, sf_dir):
    """G08."""
    report = flags.exclusion_report(checked_lines(spark, sf_dir), "lineitem", GATE)
    return report.select("table", "rows_in", "rows_excluded",
                         *[F.col("excluded_by_reason")[r].alias(r) for r in GATE])


@query(f"""{CHECKED_SQL}, r AS (SELECT unnest(string_split({REASONS_SQL}, ',')) AS reason FROM checked)
    SELECT reason, count(*) AS "rows" FROM r WHERE reason <> '' GROUP BY 1""")
def reason_histogram(spark, sf_dir):
    """G29."""
    return flags.reason_histogram(checked_lines(spark, sf_dir))


@query("""SELECT l.doc_id, (d.doc_id IS NULL) AS orphan FROM labels l
    LEFT JOIN (SELECT doc_id FROM documents WHERE lang <> 'de') d ON d.doc_id = l.doc_id""")
def orphan_labels(spark, sf_dir):
    """Labels whose document was not delivered (German documents are held back here)."""
    documents = read(spark, sf_dir, "documents", "doc_id", "lang").where("lang <> 'de'")
    return references.orphan_flag(read(spark, sf_dir, "labels"), LABELS.references[0], documents, "orphan").select("doc_id", "orphan")


NULL_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "open_status"]


@query("WITH o AS (SELECT *, nullif(o_orderstatus, 'O') AS open_status FROM orders) " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(100.0 * count(*) FILTER (WHERE {c} IS NULL) / count(*), 2) AS pct_null FROM o" for c in NULL_COLUMNS))
def null_profile(spark, sf_dir):
    """G27."""
    orders = read(spark, sf_dir, "orders").withColumn("open_status", F.nullif("o_orderstatus", F.lit("O")))
    return reports.null_profile(orders, NULL_COLUMNS)


@query("""SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS repeated_rows,
      (SELECT count(*) FROM (SELECT l_partkey, l_suppkey, l_shipdate FROM lineitem GROUP BY ALL HAVING count(*) > 1)) AS repeated_groups
    FROM lineitem""")
def duplicate_profile(spark, sf_dir):
    """Rows beyond the distinct keys, and groups that occur more than once."""
    lines = read(spark, sf_dir, "lineitem")
    keys = lines.groupBy(*LINE_KEY).agg(F.count("*").alias("n")).agg(
        (F.sum("n") - F.count("*")).alias("repeated_rows"), F.lit(1).alias("one"))
    groups = lines.groupBy("l_partkey", "l_suppkey", "l_shipdate").agg(F.count("*").alias("n")).where("n > 1").agg(
        F.count("*").alias("repeated_groups"), F.lit(1).alias("one"))
    return keys.join(F.broadcast(groups), "one").select("repeated_rows", "repeated_groups")  # one row each


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders)
    SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day, o_totalprice FROM o WHERE place <= 10""")
def latest_orders_per_customer(spark, sf_dir):
    """The ten newest orders of every customer, ids breaking ties."""
    newest = [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]
    return latest_per_key(read(spark, sf_dir, "orders"), ["o_custkey"], newest, 10).select(
        "o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"), "o_totalprice")


GATE_LIMITS = {"out_of_range": 10.0, "not_allowed": 90.0, "before_order": 0.0}


@query(f"""{CHECKED_SQL}, m AS (SELECT unnest([
      {{'gate': 'orphans', 'subject': 'lineitem.l_orderkey', 'n': count(*) FILTER (WHERE orphan_orders), 'rows': count(*), 'allowed': 5.0}},
      {{'gate': 'orphans', 'subject': 'lineitem.l_partkey', 'n': count(*) FILTER (WHERE orphan_part), 'rows': count(*), 'allowed': 5.0}},
      {{'gate': 'orphans', 'subject': 'lineitem.l_suppkey', 'n': count(*) FILTER (WHERE orphan_supplier), 'rows': count(l_suppkey), 'allowed': 5.0}},
      {', '.join(f"{{'gate': 'rule', 'subject': '{c}', 'n': count(*) FILTER (WHERE {c}), 'rows': count(*), 'allowed': {limit}}}" for c, limit in GATE_LIMITS.items())}]) AS g FROM checked),
    p AS (SELECT g.gate AS gate, g.subject AS subject, round(100.0 * g.n / g.rows, 3)::DOUBLE AS measured, g.allowed::DOUBLE AS allowed, g.rows AS checked_rows FROM m)
    SELECT *, CASE WHEN measured > allowed THEN 'fail' ELSE 'ok' END AS status FROM p""")
def gated_lines(spark, sf_dir):
    """The lines are written through gates on orphans and rules, measured by the job that writes; some fail, and their report is there."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/lines-{uuid.uuid4().hex}"
    wanted = references.orphan_gates(LINEITEM) + [gates.share_gate("rule", c, F.col(f"dq_invalid_{c}"), limit) for c, limit in GATE_LIMITS.items()]
    found = gates.write_through(checked_lines(spark, sf_dir), wanted, lambda df: df.write.parquet(f"{folder}/lines"), f"{folder}/gates")
    return gates.as_report(spark, found)
