import datetime
import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.plans import features as feat
from tidemark.plans import models, scoring

D, T = datetime.datetime, datetime.date(2026, 1, 1)


@pytest.fixture(scope="module")
def tables(spark):
    """active, lapsed for over a year, new, without registration, not yet registered, only adjustments and declines."""
    txn, n = [], 0

    def add(customer, ts, kind="Purchase", status="Approved", usd=10.0, category="Food", reasons=()):
        nonlocal n
        n += 1
        txn.append((f"t{n}", customer, ts, kind, category, None, status, usd, "USD", usd, list(reasons)))

    for i in range(10):
        add("active", D(2025, 12, 1 + i, 10), usd=0.1)
    add("active", D(2025, 12, 31, 23, 59, 59), "Payment", usd=0.2, category="Health")
    add("active", T and D(2026, 1, 1), usd=1000.0)  # at the cutoff: future
    add("active", D(2025, 9, 1), "Transfer", usd=99.0, category=None)
    add("active", D(2025, 11, 1), status="Declined")
    add("active", D(2025, 11, 2), reasons=["orphan_products"])
    add("lapsed", D(2024, 12, 31, 12))
    add("new", D(2025, 12, 30))
    add("noreg", D(2025, 12, 30))
    add("adjust", D(2025, 12, 1), "Adjustment")
    add("edge", D(2025, 1, 1))  # exactly 365 days before T
    transactions = spark.createDataFrame(txn, "transaction_id string, customer_id string, transaction_date timestamp, transaction_type string, transaction_category string, merchant_category string, "
                                              "transaction_status string, amount double, currency string, amount_usd double, dq_reasons array<string>")
    people = [("active", D(2020, 1, 1)), ("lapsed", D(2020, 1, 1)), ("new", D(2025, 12, 20)), ("noreg", None), ("later", D(2026, 3, 1)), ("adjust", D(2025, 12, 1)), ("edge", D(2020, 1, 1))]
    customers = spark.createDataFrame(people, "customer_id string, registration_date timestamp")
    products = spark.createDataFrame([("active", datetime.date(2019, 1, 1)), ("active", T)], "customer_id string, opening_date date")
    sends = spark.createDataFrame([("active", D(2025, 12, 1), True, True, D(2025, 12, 2), True, D(2026, 1, 5)), ("active", D(2025, 3, 1), True, True, D(2025, 3, 2), True, D(2025, 3, 2))],
                                  "customer_id string, send_date timestamp, was_delivered boolean, was_opened boolean, open_date timestamp, was_clicked boolean, click_date timestamp")
    contacts = spark.createDataFrame([("active", D(2025, 12, 5)), ("active", D(2026, 1, 5))], "customer_id string, interaction_date timestamp")
    complaints = spark.createDataFrame([("active", D(2025, 6, 1))], "customer_id string, creation_date timestamp")
    digital = spark.createDataFrame([("active", datetime.date(2025, 12, 20), 5, 0), ("active", datetime.date(2025, 11, 20), 2, 1)], "customer_id string, day date, events long, logins long")
    activity = feat.eligible_activity(transactions, ("orphan_products",))
    declined = feat.declined_attempts(transactions, ("orphan_products",))
    rows = feat.customer_snapshots(activity, declined, customers, products, sends, contacts, complaints, digital, [T], True)
    return rows.persist(), customers, activity


def test_features(tables):
    rows = {r.customer_id: r for r in tables[0].collect()}
    assert set(rows) == {"active", "new", "edge"}
    a = rows["active"]
    assert (a.txn_count_30d, a.txn_count_90d, a.txn_count_180d) == (10, 11, 12)  # 2 December is 30 days before T
    assert a.spend_usd_90d == 1.2  # ten times 0.1 and 0.2, exactly
    assert a.spend_usd_180d == 1.2  # transfers are not spend
    assert (a.days_since_last_txn, a.n_txn_types_180d, a.n_categories_180d, a.active_days_180d) == (1, 3, 2, 12)
    assert (a.declined_count_90d, a.products_opened, a.tenure_days) == (1, 1, 2192)
    assert (a.sends_180d, a.opens_180d, a.clicks_180d, a.days_since_last_click) == (1, 1, 0, 305)
    assert (a.contacts_180d, a.complaints_180d, a.logins_90d, a.digital_active_days_90d, a.days_since_last_login) == (1, 0, 1, 2, 42)
    assert (a.fut_txn_count, a[feat.TARGET]) == (1, 1)
    assert rows["new"].days_since_last_click == feat.RECENCY_CAP and rows["edge"].days_since_last_txn == 365
    feat.check_features(tables[0])
    with pytest.raises(ValueError, match="cutoff"):
        feat.check_features(tables[0].withColumn("last_ts_used", F.lit("2026-01-01").cast("timestamp")))
    with pytest.raises(ValueError, match="missing"):
        feat.check_features(tables[0].drop("tenure_days"))
    assert feat.model_matrix(tables[0]).columns[2:] == list(feat.FEATURES)


def test_scores_and_fallbacks(tables):
    rows, customers, activity = tables
    as_of = datetime.date(2025, 12, 31)
    bad = rows.withColumn("spend_usd_30d", F.when(F.col("customer_id") == "edge", float("nan")).otherwise(F.col("spend_usd_30d")))
    given = rows.select("customer_id", F.lit(0.7).alias("score"))
    out = scoring.score_customers(customers, bad, given, as_of, "v1")
    got = {r.customer_id: (r.scoring_source, r.risk_tier, r.reason_code, r.risk_score) for r in out.collect()}
    assert got == {
        "active": ("model", "high", None, 0.7), "new": ("model", "low", None, 0.7), "edge": ("fallback", "unknown", scoring.NO_DATA, None),
        "lapsed": ("fallback", "high", scoring.NO_ACTIVITY, None), "noreg": ("fallback", "unknown", scoring.NO_DATA, None),
        "adjust": ("fallback", "new_customer", scoring.TOO_NEW, None)}
    scoring.validate_scores(out, "v1", as_of)
    again = scoring.score_customers(customers, bad, given, as_of, "v1")
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, again.collect()), key=str)
    for broken in (out.withColumn("risk_score", F.lit(2.0)), out.withColumn("risk_tier", F.lit("low")), out.withColumn("scoring_source", F.lit("model")), out.unionByName(out),
                   out.drop("reason_code"), out.withColumn("model_version", F.col("customer_id"))):
        with pytest.raises(ValueError):
            scoring.validate_scores(broken, "v1", as_of)
    scoring.check_as_of(as_of, activity)
    with pytest.raises(ValueError, match="after the last day"):
        scoring.check_as_of(datetime.date(2026, 2, 1), activity)


def test_population_gate(tables):
    models.population_matches(tables[0], {T: 3})
    with pytest.raises(ValueError, match="population"):
        models.population_matches(tables[0], {T: 4})


def test_model_reloads(spark, tmp_path):
    rows = spark.range(400).select("id", *[(F.rand(i) * 10).alias(c) for i, c in enumerate(("a", "b"))]).withColumn("y", (F.col("a") > 5).cast("int"))
    model = models.fitted(models.linear_probe(["a", "b"], "y"), rows)
    assert models.reload_difference(model, str(tmp_path / "model"), rows, ["id"]) == 0.0
    quality = models.compare_scores(models.predict(model, rows), {"probe": "score"}, "y").first()
    assert quality.roc_auc > 0.98
    drops = {r.feature: r.pr_auc_drop for r in models.permutation_importance(model, rows, ["a", "b"], "y", ["id"]).collect()}
    assert drops["a"] > 0.2 > abs(drops["b"])


def test_permutation_importance_equals_brute_force(spark):
    """Every deal by hand: rows in hash order, values moved by the bijection, scored and ranked again."""
    from tests.test_ordering import brute_ap

    rows = spark.range(300).select("id", *[F.round(F.rand(i) * 10, 1).alias(c) for i, c in enumerate(("a", "b", "c"))]).withColumn("y", (F.col("a") + F.col("b") > 9).cast("int"))
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    features = ["a", "b", "c"]
    model = models.fitted(models.linear_probe(features, "y"), rows)
    got = {r.feature: r.pr_auc_drop for r in models.permutation_importance(model, rows, features, "y", ["id"], repeats=3).collect()}
    listed = sorted((r.asDict() for r in rows.collect()), key=lambda r: hashlib.md5(f"7:{r['id']}".encode()).hexdigest())
    deals = models.shuffles(len(listed), features, 3, "7")
    variants = [(-1, r) for r in listed]
    for k, (feature, _, factor, shift) in enumerate(deals):
        source = [(factor * p + shift) % len(listed) for p in range(len(listed))]
        assert sorted(source) == list(range(len(listed)))
        variants += [(k, {**r, feature: listed[s][feature]}) for r, s in zip(listed, source)]
    scored = models.predict(model, spark.createDataFrame([(k, r["id"], r["a"], r["b"], r["c"], r["y"]) for k, r in variants], "k int, id long, a double, b double, c double, y int")).toPandas()
    quality = {k: brute_ap(part.score.to_numpy(), part.y.to_numpy()) for k, part in scored.groupby("k")}
    for f in features:
        drops = [quality[-1] - quality[k] for k, d in enumerate(deals) if d[0] == f]
        assert got[f] == pytest.approx(sum(drops) / 3)


def test_compared_scores_have_their_metrics(spark):
    from tests.test_ordering import brute_ap, brute_auc

    rows = spark.range(500).select("id", *[(F.rand(i) * 10).alias(c) for i, c in enumerate(("a", "b"))]).withColumn("y", (F.col("a") + F.rand(5) * 4 > 7).cast("int"))
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    scored = models.predict(models.fitted(models.boosted_trees(["a", "b"], "y", maxIter=5, minInstancesPerNode=5), rows), rows, "trees")
    scored = models.predict(models.fitted(models.linear_probe(["a"], "y"), rows), scored, "probe")
    local = scored.toPandas()
    for r in models.compare_scores(scored, {"trees": "trees", "probe": "probe"}, "y").collect():
        assert (r.roc_auc, r.pr_auc) == pytest.approx((brute_auc(local[r.model].to_numpy(), local.y.to_numpy()), brute_ap(local[r.model].to_numpy(), local.y.to_numpy())))


def test_schedule_and_split():
    from tidemark.functions.calendar import chronological_split, label_overlap_days, snapshot_schedule

    days = snapshot_schedule(datetime.date(2023, 6, 17), datetime.date(2026, 6, 18), 90, 180, 3)
    assert days[0] == datetime.date(2024, 1, 1) and days[-1] == datetime.date(2026, 1, 1) and len(days) == 9
    parts = chronological_split(days, datetime.date(2025, 4, 1), datetime.date(2025, 10, 1), 90)
    assert [len(parts[p]) for p in ("train", "validation", "test")] == [6, 2, 1]
    assert label_overlap_days(days, 91) == 1
    with pytest.raises(ValueError, match="reaches into"):
        chronological_split(days, datetime.date(2025, 4, 1), datetime.date(2025, 10, 1), 120)


def test_models_predict_after_a_gated_write(spark, tmp_path):
    """Observing a write leaves the session with what cannot be sent to tasks; a model must not need it."""
    from tidemark.operators import gates

    rows = spark.range(200).select("id", (F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 2).cast("int").alias("y"))
    found = gates.write_through(rows, [gates.share_gate("rule", "y", F.col("y") == 1, 10.0), gates.none_gate("rule", "id", F.col("id") < 0)],
                                lambda df: df.write.parquet(str(tmp_path / "rows")), str(tmp_path / "report"))
    assert [(f[1], f[2], f[5]) for f in found] == [("y", 50.0, "fail"), ("id", 0.0, "ok")] and spark.read.parquet(str(tmp_path / "rows")).count() == 200
    with pytest.raises(gates.QualityGateError, match="rule y"):
        gates.enforce(found)
    assert models.predict(models.fitted(models.linear_probe(["a"], "y"), rows), rows).where("score BETWEEN 0 AND 1").count() == 200
