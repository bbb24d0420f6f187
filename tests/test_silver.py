import pytest
from pyspark.sql import functions as F

from tests.lake import write_rates
from tidemark.config.bank import BANK
from tidemark.operators.gates import QualityGateError
from tidemark.plans.silver import deduplicated, run_silver
from tidemark.sources.readers import ingest, read_bronze, read_report


def test_every_table_has_one_row_per_key_and_folded_reasons(silver):
    for name, spec in BANK.tables.items():
        df = silver(name)
        keyed = df.where(~F.col("dq_invalid_missing_key"))
        assert keyed.groupBy(*spec.key).count().where("count > 1").count() == 0, name
        flags = [c for c in df.columns if c.startswith("dq_invalid_")]
        assert df.where(" OR ".join(f"{c} IS NULL" for c in flags)).count() == 0, name
        assert df.where("dq_is_valid <> (size(dq_reasons) = 0)").count() == 0, name


def test_branch_rules(reasons):
    found = reasons("branches", "branch_id")
    assert found["BR-1"] == []
    assert found["BR-2"] == ["location"] and found["BR-3"] == ["location"]
    assert found["BR-4"] == found["BR-5"] == ["not_unique"]


def test_agents_keep_rows_with_a_broken_key(reasons):
    assert reasons("service_agents", "agent_id") == {"A-1": [], "A-2": ["required_missing"]}


def test_campaign_names(silver, reasons):
    found = reasons("marketing_campaigns", "campaign_id")
    assert found == {"K-1": [], "K-2": ["name_mismatch"], "K-3": ["campaign_name"], "K-4": []}
    rows = {r.campaign_id: r for r in silver("marketing_campaigns").collect()}
    assert rows["K-1"].promoted_product == "Inversión" and rows["K-1"].promoted_product_imputed
    assert rows["K-1"].description == "Campaña de retention para Inversión" and rows["K-1"].description_imputed
    assert rows["K-4"].promoted_product is None and not rows["K-4"].promoted_product_imputed
    assert str(rows["K-1"].campaign_month) == "2025-05-01" and rows["K-1"].campaign_seq == 146


def test_customers_keep_the_latest_possible_update(silver, reasons):
    rows = {r.customer_id: r for r in silver("customers").collect()}
    assert (rows["C-1"].dq_copies, rows["C-1"].dq_versions) == (2, 1)
    assert (rows["C-2"].dq_copies, rows["C-2"].dq_versions, rows["C-2"].city) == (3, 3, "Medellín")
    assert rows["C-3"].country == "México" and rows["C-3"].income_currency == "MXN" and rows["C-3"].last_updated_clean is None
    found = reasons("customers", "customer_id")
    assert found["C-1"] == [] and found["C-3"] == ["last_updated_after_cutoff"]
    assert found["C-4"] == ["out_of_range", "registration_date"]


def test_products(silver, reasons):
    found = reasons("products", "product_id")
    assert found["P-2"] == ["orphan_branches", "orphan_customers"]
    assert found["P-3"] == ["date_order", "last_txn_mismatch"]
    assert found["L-x"] == ["incomplete_credit_terms", "missing_expiration_date"]
    assert found["L-0"] == []
    kept = silver("products").where("product_id = 'P-1'").first()
    assert str(kept.ingest_date) == "2026-07-02" and float(kept.current_balance) == 99.0
    assert kept.dq_invalid_last_txn_mismatch  # its latest transaction is on the 12th


def test_transactions(silver, reasons):
    found = reasons("transactions", "transaction_id")
    assert found["T-1"] == []
    assert found["T-2"] == ["product_owner_mismatch"]
    assert found["T-3"] == ["before_product_opening", "location"]
    assert found["T-4"] == ["orphan_products"]
    assert found["T-5"] == ["orphan_customers"]
    assert found["T-7"] == [] and found["T-9"] == ["not_allowed", "out_of_range"]
    assert found[None] == ["missing_key"]
    rows = {r.transaction_id: r for r in silver("transactions").collect()}
    assert rows["T-6"].currency == "USD" and rows["T-6"].amount_usd == 20.0 and rows["T-6"].amount_usd_imputed
    assert rows["T-2"].arrival_lag_days == 10 and rows["T-2"].is_late_arrival and rows["T-2"].dq_is_valid is False
    assert str(rows["T-7"].business_date) == "2026-05-10" and rows["T-7"].arrival_lag_days == 0
    assert silver("transactions").where("transaction_id IS NULL").count() == 2


def test_interactions_transcripts_surveys(silver, reasons):
    assert reasons("call_center_interactions", "interaction_id") == {
        "I-1": [], "I-2": ["missing_duration"], "I-3": [], "I-4": ["orphan_service_agents"]}
    assert "reason_category" not in silver("call_center_interactions").columns
    found = reasons("call_transcripts", "transcript_id")
    assert found == {"R-1": [], "R-2": ["entities_json", "orphan_call_center_interactions", "required_missing"],
                     "R-3": ["interaction_customer_mismatch"]}
    first = silver("call_transcripts").where("transcript_id = 'R-1'").first()
    assert (first.entities_account_numbers, first.entities_products, first.full_text) == (1, "Seguro", "hola\nadios")
    found = reasons("satisfaction_surveys", "survey_id")
    assert found == {"V-1": [], "V-2": ["nps_category"], "V-3": ["interaction_customer_mismatch", "score_out_of_range"],
                     "V-4": ["orphan_call_center_interactions"]}
    assert silver("satisfaction_surveys").where("survey_id = 'V-1'").first().nps_category == "Promoter"


def test_events_complaints_sends(silver, reasons):
    found = reasons("digital_events", "event_id")
    assert found == {"E-1": [], "E-2": [], "E-3": ["missing_customer", "out_of_range"], "E-4": ["orphan_products"]}
    second = silver("digital_events").where("event_id = 'E-2'").first()
    assert str(second.business_date) == "2026-05-10" and second.arrival_lag_days == 0  # follows its session's start
    assert reasons("complaints", "complaint_id") == {
        "Q-1": ["processed_before_event"], "Q-2": ["orphan_products", "outside_dataset"], "Q-3": []}
    found = reasons("campaign_sends", "send_id")
    assert found == {"N-1": [], "N-2": [], "N-3": [], "N-4": ["not_allowed", "undelivered_engagement"], "N-5": ["event_order"]}
    rows = {r.send_id: r for r in silver("campaign_sends").collect()}
    assert rows["N-1"].was_opened is False and rows["N-1"].was_opened_imputed
    assert rows["N-2"].subject == "Oferta en Inversión" and rows["N-2"].subject_imputed
    assert rows["N-3"].subject is None and not rows["N-3"].subject_imputed


def test_exchange_rates(silver):
    df = silver("daily_exchange_rates")
    assert df.count() == 13_164
    gap = df.where("exchange_rate_imputed").collect()
    assert {str(r.date) for r in gap} == {"2024-03-01", "2024-03-02"} and all(r.exchange_rate == 4000.0 and r.dq_copies == 0 for r in gap)
    wrong = df.where("date = '2025-01-10'")
    assert wrong.where("dq_invalid_inverse_rate").count() == 2
    assert wrong.where("source_currency = 'MXN' AND target_currency = 'USD'").first().dq_reasons == ["inverse_rate", "cross_rate"]
    assert wrong.where("dq_invalid_cross_rate").count() > 2
    order = df.where("dq_invalid_rate_order").collect()
    assert [(str(r.date), r.source_currency, r.target_currency) for r in order] == [("2025-01-20", "MXN", "USD")]

def test_reports(spark, lake):
    dups = {r.table: r for r in read_report(spark, lake, "silver", "duplicates").collect()}
    assert (dups["customers"].rows_in, dups["customers"].rows_out, dups["customers"].exact_duplicates,
            dups["customers"].conflicting_duplicates) == (7, 4, 1, 2)
    rules = {(r.table, r.rule): r.failing_rows for r in read_report(spark, lake, "silver", "rules").collect()}
    assert rules["transactions", "location"] == 1 and rules["campaign_sends", "imputed:subject"] == 1
    assert rules["complaints", "all_null:origin_interaction_id"] == 3
    assert rules["branches", "not_unique:branch_code"] == 2
    keys = {(r.child_table, r.child_column): r for r in read_report(spark, lake, "silver", "foreign_keys").collect()}
    assert keys["service_agents", "assigned_branch_id"].status == "known_broken"
    assert keys["service_agents", "assigned_branch_id"].orphan_rows == 1
    assert keys["complaints", "origin_interaction_id"].status == "not_checkable"
    assert keys["transactions", "product_id"].orphan_rows == 1
    late = {r.table: r for r in read_report(spark, lake, "silver", "arrivals").collect()}
    assert late["transactions"].late_rows == 1 and late["transactions"].eight_to_thirty_days == 1
    volume = {r.table: r for r in read_report(spark, lake, "silver", "volumes").collect()}
    assert volume["transactions"].file_days == 4 and volume["transactions"].missing_days == 1093
    assert volume["branches"].file_days is None and volume["branches"].status == "warn"


def test_gate_fails_after_reports(spark, tmp_path):
    skip = {(f"2024-03-0{d}", "USD", "COP") for d in range(1, 5)}
    write_rates(str(tmp_path), skip, {})
    with pytest.raises(QualityGateError, match=r"filled_days USD->COP \(4 > 3\)"):
        run_silver(spark, str(tmp_path), ["daily_exchange_rates"])
    verdicts = {(r.gate, r.subject): (r.measured, r.status) for r in read_report(spark, str(tmp_path), "silver", "gates").collect()}
    assert len(verdicts) == 24 and verdicts["filled_days", "USD->COP"] == (4.0, "fail")
    assert {v for k, v in verdicts.items() if k != ("filled_days", "USD->COP")} == {(0.0, "ok")}
    assert read_report(spark, str(tmp_path), "silver", "rules").count() > 0


@pytest.mark.parametrize("change", ["reordered", "missing", "extra", "renamed"])
def test_wrong_header_fails(spark, tmp_path, change):
    spec = BANK["branches"]
    header = list(spec.source_columns)
    if change == "reordered":
        header[0], header[1] = header[1], header[0]
    elif change == "missing":
        header = header[:-1]
    elif change == "extra":
        header = [*header, "surplus"]
    else:
        header[3] = "kind"
    folder = tmp_path / "bronze" / "branches" / "ingest_date=2026-07-01"
    folder.mkdir(parents=True)
    (folder / "branches.csv").write_text(",".join(header) + "\n" + ",".join("x" for _ in header) + "\n")
    with pytest.raises(Exception) as error:
        read_bronze(spark, str(tmp_path), spec).collect()
    assert "branches.csv" in str(error.value)


def test_keep_latest_does_not_depend_on_row_order(spark, lake):
    spec = BANK["customers"]
    raw = read_bronze(spark, lake, spec)
    flipped = raw.orderBy(F.col("last_updated").desc_nulls_last())
    pick = lambda df: sorted(map(tuple, deduplicated(df, spec).select("customer_id", "city", "dq_versions").collect()))
    assert pick(raw) == pick(flipped)


def test_ingest_round_trip(spark, lake, tmp_path):
    spec = BANK["transactions"]
    raw = read_bronze(spark, lake, spec)
    ingest(raw, str(tmp_path), spec, "2026-07-05", daily_by="process_date")
    back = read_bronze(spark, str(tmp_path), spec)
    assert back.count() == raw.count() and str(back.first().ingest_date) == "2026-07-05"
    with pytest.raises(ValueError, match="lacks"):
        ingest(raw.drop("amount"), str(tmp_path), spec, "2026-07-05")
