"""A delivered lake small enough to read: every rule has one planted row. All values are made up."""

from __future__ import annotations

import csv
import datetime
import os

from tidemark.config.bank import BANK, CURRENCIES, DATASET_END, DATASET_START

SNAPSHOT = "2026-07-01"

GOOD = {
    "branches": dict(branch_code="B-x", branch_name="Centro", branch_type="Full", address="Calle 1", city="Bogotá", state="DC",
                     country="Colombia", geographic_zone="Urban", phone="600", opening_time="08:00", closing_time="16:00",
                     has_atms="true", atm_count="2.0", has_teller_windows="si", teller_window_count="3", latitude="4.6",
                     longitude="-74.1", branch_opening_date="2010-01-01", branch_status="Active"),
    "service_agents": dict(employee_code="E-x", first_name="Ana", last_name="Rojas", email="ana@bank.test", native_accent="co",
                           country_of_origin="Colombia", agent_type="Phone", experience_level="Senior", languages="es",
                           specialty="Loans", hire_date="2020-02-02", avg_csat="4.5", agent_status="Active", work_shift="Day"),
    "marketing_campaigns": dict(campaign_type="Email", campaign_objective="Retention", promoted_product="Inversión",
                                description="x", start_date="2025-05-01", end_date="2025-06-30", campaign_status="Active",
                                target_country="Colombia", target_segment="Plus", budget="1000.5"),
    "customers": dict(document_number="D-x", document_type="CC", first_name="Luz", last_name="Paz", date_of_birth="1990-03-04",
                      email="luz.paz@mail.test", mobile_phone="3001234567", city="Bogotá", state="DC", country="Colombia",
                      segment="Plus", credit_score="700", estimated_monthly_income="1000", registration_date="2024-01-01 10:00:00",
                      registration_branch_id="BR-1", customer_status="Active", last_updated="2026-01-01 00:00:00", accepts_marketing="yes"),
    "products": dict(customer_id="C-1", product_type="Cuenta Ahorro", product_number="4111000022223333", currency="COP",
                     current_balance="1500.25", opening_date="2024-02-01", opening_branch_id="BR-1", product_status="Active",
                     opening_channel="Web", has_linked_app="t", last_updated="2026-01-01 00:00:00"),
    "transactions": dict(transaction_date="2026-05-10 12:00:00", process_date="2026-05-10", product_id="P-1", customer_id="C-1",
                         transaction_type="Purchase", transaction_category="Food", amount="100.5", currency="COP", channel="POS",
                         branch_id="BR-1", transaction_country="Colombia", transaction_status="Approved", is_fraud="false",
                         latitude="4.6", longitude="-74.1"),
    "call_center_interactions": dict(interaction_date="2026-05-10 12:00:00", process_date="2026-05-10", customer_id="C-1",
                                     agent_id="A-1", interaction_type="Call", channel="Phone", contact_reason="Producto",
                                     reason_category="Producto", duration_seconds="60", requires_followup="false",
                                     was_escalated="false", has_transcript="true", has_recording="true"),
    "call_transcripts": dict(interaction_id="I-1", process_date="2026-05-10", customer_id="C-1", agent_id="A-1",
                             full_text="hola\nadios", detected_language="es", transcription_model="m", duration_seconds="60",
                             mentioned_entities='{"account_numbers": 1, "dates": 0, "amounts": 2, "products": "Seguro"}'),
    "satisfaction_surveys": dict(survey_date="2026-05-11 09:00:00", process_date="2026-05-10", interaction_id="I-1", customer_id="C-1",
                                 agent_id="A-1", survey_type="CSAT", send_channel="Email", main_score="4"),
    "digital_events": dict(event_date="2026-05-10 12:00:00", process_date="2026-05-10", customer_id="C-1", session_id="S-1",
                           event_type="login", event_category="auth", channel="Desktop Web", duration_seconds="5", is_mobile="false"),
    "complaints": dict(creation_date="2026-05-10 12:00:00", process_date="2026-05-10", customer_id="C-1", case_type="Claim",
                       category="Fees", reception_channel="Web", description="x", priority="High", status="Open",
                       sla_breached="false", is_repeat_complainer="false"),
    "campaign_sends": dict(send_date="2026-05-10 12:00:00", process_date="2026-05-10", campaign_id="K-1", customer_id="C-1",
                           send_channel="Email", subject="Oferta en Seguro", send_status="Sent", was_delivered="true",
                           was_opened="true", open_date="2026-05-10 13:00:00", was_clicked="false", had_conversion="false"),
}
DAILY = {"transactions", "call_center_interactions", "digital_events"}


def _rows():
    yield "branches", "BR-1", {}
    yield "branches", "BR-2", dict(latitude="0.1", longitude="0.2")  # null island
    yield "branches", "BR-3", dict(latitude="40.4", longitude="-3.7")  # another country's coordinates
    yield "branches", "BR-4", dict(branch_code="shared")
    yield "branches", "BR-5", dict(branch_code="shared")
    yield "service_agents", "A-1", {}
    yield "service_agents", "A-2", dict(email=" NaN ", assigned_branch_id="nowhere")
    yield "marketing_campaigns", "K-1", dict(campaign_name="CMP_RET_INV_May2025_0146", promoted_product="", description="")
    yield "marketing_campaigns", "K-2", dict(campaign_name="CMP_ACQ_INV_May2025_0147")  # objective contradicts
    yield "marketing_campaigns", "K-3", dict(campaign_name="CMP_ZZZ_INV_Foo2025")  # unknown and short
    yield "marketing_campaigns", "K-4", dict(campaign_name="CMP_RET_GEN_Jun2025_9", promoted_product="", description="")
    yield "customers", "C-1", {}
    yield "customers", "C-1", {}  # exact copy
    for city, updated in (("Cali", "2025-01-01"), ("Medellín", "2025-06-01"), ("Futuro", "2027-01-01")):
        yield "customers", "C-2", dict(city=city, last_updated=f"{updated} 00:00:00", document_number="D-2")
    yield "customers", "C-3", dict(last_updated="2026-12-31 00:00:00", country="Mexico")  # after the data ends
    yield "customers", "C-4", dict(credit_score="900", registration_date="2026-02-01 00:00:00", last_updated="2026-01-01 00:00:00")
    yield "products", "P-1", dict(last_transaction_date="2026-05-10 12:00:00")
    yield "products", "P-2", dict(customer_id="nobody", opening_branch_id="nowhere")
    yield "products", "P-3", dict(expiration_date="2020-01-01", customer_id="C-2", last_transaction_date="2020-01-01 00:00:00")
    for i in range(10):
        yield "products", f"L-{i}", dict(product_type="Préstamo Personal", interest_rate="10", days_past_due="0", credit_limit="5",
                                         expiration_date="2027-08-01")
    yield "products", "L-x", dict(product_type="Préstamo Personal", interest_rate="", days_past_due="0", credit_limit="5")
    yield "transactions", "T-1", {}
    yield "transactions", "T-2", dict(customer_id="C-2", process_date="2026-05-20")  # another's product, ten days late
    yield "transactions", "T-3", dict(product_id="P-3", customer_id="C-2", transaction_date="2024-01-15 12:00:00", process_date="2024-01-15",
                                      latitude="51.0", longitude="0.5")
    yield "transactions", "T-4", dict(product_id="missing")
    yield "transactions", "T-5", dict(customer_id="")
    yield "transactions", "T-6", dict(currency=" usd ", amount_usd="0", amount="20")
    yield "transactions", "T-7", dict(transaction_date="2026-05-11 05:59:59", process_date="2026-05-10")  # still the 10th
    yield "transactions", "", {}
    yield "transactions", "", {}
    yield "transactions", "T-8", dict(transaction_status="Declined", response_code="51", transaction_date="2026-05-12 12:00:00",
                                      process_date="2026-05-12")
    yield "transactions", "T-9", dict(transaction_status="Unheard", amount="-1")
    yield "call_center_interactions", "I-1", {}
    yield "call_center_interactions", "I-2", dict(duration_seconds="")
    yield "call_center_interactions", "I-3", dict(duration_seconds="", channel="Email")
    yield "call_center_interactions", "I-4", dict(agent_id="ghost", customer_id="C-2")
    yield "call_transcripts", "R-1", {}
    yield "call_transcripts", "R-2", dict(mentioned_entities="{broken", interaction_id="none", duration_seconds="")
    yield "call_transcripts", "R-3", dict(customer_id="C-2")
    yield "satisfaction_surveys", "V-1", dict(survey_type="NPS", main_score="9")
    yield "satisfaction_surveys", "V-2", dict(survey_type="NPS", main_score="3", nps_category="Promoter")
    yield "satisfaction_surveys", "V-3", dict(main_score="7", customer_id="C-2")
    yield "satisfaction_surveys", "V-4", dict(interaction_id="none")
    yield "digital_events", "E-1", dict(event_date="2026-05-11 05:50:00", process_date="2026-05-10", session_id="S-2")
    yield "digital_events", "E-2", dict(event_date="2026-05-11 06:10:00", process_date="2026-05-10", session_id="S-2")
    yield "digital_events", "E-3", dict(customer_id="", duration_seconds="-5")
    yield "digital_events", "E-4", dict(product_id="missing")
    yield "complaints", "Q-1", dict(process_date="2026-05-09")
    yield "complaints", "Q-2", dict(creation_date="2027-01-01 12:00:00", process_date="2027-01-01", affected_product_id="missing")
    yield "complaints", "Q-3", dict(creation_date="2026-05-10 08:00:00", process_date="2026-05-09")  # exactly at day start
    yield "campaign_sends", "N-1", dict(was_opened="", open_date="")
    yield "campaign_sends", "N-2", dict(subject="Oferta en nan", campaign_id="K-1")
    yield "campaign_sends", "N-3", dict(subject="Oferta en nan", campaign_id="K-4")
    yield "campaign_sends", "N-4", dict(was_delivered="false", send_status="Lost")
    yield "campaign_sends", "N-5", dict(open_date="2026-05-09 00:00:00")


def rates(skip=frozenset(), change=None):
    """Every pair on every day, consistent; `skip` holds (date, source, target) left out."""
    value = {"ARS": 0.001, "COP": 0.00025, "MXN": 0.05, "USD": 1.0}
    day, end = datetime.date.fromisoformat(DATASET_START), datetime.date.fromisoformat(DATASET_END)
    while day <= end:
        for a in CURRENCIES:
            for b in CURRENCIES:
                if a == b or (str(day), a, b) in skip:
                    continue
                rate = value[a] / value[b]
                row = dict(date=str(day), source_currency=a, target_currency=b, exchange_rate=rate, buy_rate=rate * 0.98,
                           sell_rate=rate * 1.02, source="central")
                row.update((change or {}).get((str(day), a, b), {}))
                yield row
        day += datetime.timedelta(days=1)


GAP = {("2024-03-01", "USD", "COP"), ("2024-03-02", "USD", "COP")}
CHANGED = {("2025-01-10", "MXN", "USD"): dict(exchange_rate=0.07, buy_rate=0.068, sell_rate=0.072),
           ("2025-01-20", "MXN", "USD"): dict(buy_rate=0.06)}


def _write(path, columns, rows):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="", encoding="utf-8") as out:
        writer = csv.writer(out)
        writer.writerow(columns)
        for row in rows:
            writer.writerow([row.get(c, "") for c in columns])


def write_rates(root, skip=GAP, change=CHANGED):
    spec = BANK["daily_exchange_rates"]
    _write(f"{root}/bronze/{spec.name}/ingest_date={SNAPSHOT}/{spec.name}.csv", spec.source_columns, rates(skip, change))


def write_lake(root):
    held: dict[str, list[dict]] = {}
    for name, key, changes in _rows():
        row = {**GOOD[name], **changes, BANK[name].key[0]: key}
        for c in ("branch_code", "employee_code", "document_number"):
            if row.get(c, "").endswith("-x"):
                row[c] = row[c] + key
        if name == "products" and "product_number" not in changes:
            row["product_number"] = "41110000" + str(abs(hash(key)) % 10**8).zfill(8)
        held.setdefault(name, []).append(row)
    # a later delivery of one product wins over its later update in the first one
    held_later = dict(held["products"][0], current_balance="99", last_updated="2025-12-01 00:00:00")
    for name, rows in held.items():
        spec = BANK[name]
        base = f"{root}/bronze/{name}/ingest_date={SNAPSHOT}"
        if name in DAILY:
            for day in sorted({r["process_date"] for r in rows}):
                y, m, d = day.split("-")
                _write(f"{base}/year={y}/month={m}/day={d}/{name}.csv", spec.source_columns, [r for r in rows if r["process_date"] == day])
        else:
            _write(f"{base}/{name}.csv", spec.source_columns, rows)
    _write(f"{root}/bronze/products/ingest_date=2026-07-02/products.csv", BANK["products"].source_columns, [held_later])
    write_rates(root)
