import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.config.bank import BANK
from tidemark.operators.contracts import findings, render_markdown
from tidemark.operators.reports import problems_first, summary_view
from tidemark.plans import runs
from tidemark.sources.item_sink import ItemSink
from tidemark.sources import readers, sinks
from tidemark.sources.readers import classify_columns


def write_run(path, config, cases):
    lines = [json.dumps({"run": {"created_at": "2026-01-01", "live": True}, "config": config}), ""]
    for suite, case, expected, actual, detail in cases:
        lines.append(json.dumps({"suite": suite, "case_id": case, "passed": expected == actual, "expected": expected, "actual": actual, "tags": ["safety"], "detail": detail}))
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def measured(latency, cost=0.1):
    return {"metrics": {"requests": 2, "input_tokens": 100, "output_tokens": 10, "latency_ms": latency, "retries": 1, "fallback_used": latency > 90, "cost_usd": cost}}


@pytest.fixture(scope="module")
def two_runs(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("spark-runs")
    a = write_run(root / "a.jsonl", {"router": {"prompt": "x", "model": "m1"}, "tools": {"list": ["a", "b"]}, "old": {}}, [
        ("chat", "1", "yes", "yes", measured(10.0)), ("chat", "2", "yes", "no", measured(20.0)), ("chat", "3", "yes", "model_error", {}), ("chat", "4", "yes", "yes", {"policies": ["p"]}),
        ("chat", "5", "yes", "no", {}), ("chat", "6", "yes", "yes", {}), ("gone", "1", "a", "a", {}), ("gone", "2", "a", "a", {})])
    b = write_run(root / "b.jsonl", {"router": {"prompt": "x", "model": "m2", "extra": 1}, "tools": {"list": ["b", "c"]}}, [
        ("chat", "1", "yes", "no", measured(30.0, None)), ("chat", "2", "yes", "yes", measured(100.0)), ("chat", "3", "yes", "yes", {}), ("chat", "4", "yes", "yes", {"policies": ["q"]}),
        ("chat", "5", "yes", "maybe", {}), ("chat", "7", "yes", "yes", {})])
    return readers.read_run(spark, a), readers.read_run(spark, b)


def test_scan_splits_header_and_cases(two_runs):
    (header, cases), _ = two_runs
    assert header.count() == 1 and cases.count() == 8 and header.first().run.live


def test_changes(two_runs):
    got = {(r.suite, r.case_id): (r.change, r.cases) for r in runs.compare_runs(two_runs[0][1], two_runs[1][1]).collect()}
    assert got == {
        ("chat", "1"): ("regression", 1), ("chat", "2"): ("fix", 1), ("chat", "3"): ("errors appeared or cleared", 1), ("chat", "4"): ("same verdict, different policy", 1),
        ("chat", "5"): ("still failing, different answer", 1), ("chat", "6"): ("only in A", 1), ("chat", "7"): ("only in B", 1), ("gone", None): ("only in A", 2)}
    assert runs.has_regressions(runs.compare_runs(two_runs[0][1], two_runs[1][1]))


def test_rates_exclude_errors(two_runs):
    got = {(r.suite, r.tag): (r.passed, r.scored, r.errors) for r in runs.pass_rates(two_runs[0][1]).collect()}
    assert got["chat", None] == got["chat", "safety"] == (3, 5, 1) and got["gone", None] == (2, 2, 0)


def test_cost_and_latency(two_runs):
    out = runs.cost_and_latency(two_runs[0][1], two_runs[1][1])
    got = {r.run: r for r in out.collect()}
    assert (got["A"].cases, got["A"].cost_usd, got["A"].latency_p50, got["A"].latency_p95) == (2, 0.2, 15.0, 20.0)
    assert got["B"].cost_usd is None and got["B"].fallbacks == 1 and got["B"].retries == 2
    change = {r.metric: r.change for r in runs.side_by_side(out).collect()}
    assert change["latency_p95"] == 4.0 and change["cost_usd"] is None


def test_config_changes(two_runs):
    got = {r.path: (r.change, r.items_added, r.items_removed) for r in runs.config_changes(two_runs[0][0], two_runs[1][0]).collect()}
    assert got == {"router.model": ("changed", None, None), "router.extra": ("added", None, None), "tools.list": ("list changed", "c", "a"), "old": ("only in A", None, None)}


def test_settings_of_any_depth(spark):
    """Twelve levels, lists, empty objects, names with dots and quotes, and numbers as they are."""
    deep = leaf = {}
    for k in range(11):
        leaf[f"k{k}"] = {"n": k, "next": {}} if k % 2 else {"next": {}}
        leaf = leaf[f"k{k}"]["next"]
    leaf.update(end=True, kinds=["a", {"b": 1}], none=None, text='{"not": "an object"}', **{"a.b": 1.5})
    other = json.loads(json.dumps(deep).replace('"end": true', '"end": false'))
    a, b = (spark.createDataFrame([(json.dumps(c),)], "config string") for c in (deep, other))
    got = {r.path: r.value for r in runs.leaves(a, "config").collect()}
    prefix = ".next.".join(f"k{k}" for k in range(11)) + ".next."
    assert got == {**{".next.".join(f"k{j}" for j in range(k + 1)) + ".n": str(k) for k in range(1, 11, 2)}, prefix + "end": "true", prefix + "kinds": '["a",{"b":1}]',
                   prefix + "none": None, prefix + "text": '{"not": "an object"}', prefix + "a.b": "1.5"}
    changed = runs.config_changes(a, b).collect()
    assert [(r.path, r.change, r.old, r.new) for r in changed] == [(prefix + "end", "changed", "true", "false")]


def test_breakdown(two_runs):
    got = {(r.suite, r.label): (r.passed, r.cases) for r in runs.breakdown(two_runs[0][1]).collect()}
    assert got == {("chat", "tag=safety"): (3, 6), ("gone", "tag=safety"): (2, 2)}
    assert runs.misses(two_runs[0][1]).count() == 3


def test_token_costs(spark):
    calls = spark.createDataFrame([("a", "eu.small-model", 1_000_000, 0), ("a", "eu.large-model", 0, 1_000_000), ("b", "unknown", 5, 0), ("c", "unknown", 0, 0)],
                                  "case_id string, model_id string, input_tokens long, output_tokens long")
    assert {r.case_id: r.cost_usd for r in runs.token_costs(calls, (("small-model", 1.0, 5.0), ("large-model", 3.0, 15.0))).collect()} == {"a": 16.0, "b": None, "c": 0.0}


def test_blocked_labels(spark):
    doc = [{"topicPolicy": {"topics": [{"name": "loans", "action": "BLOCKED"}, {"name": "x", "action": "NONE"}]}, "sensitiveInformationPolicy": {"piiEntities": [{"type": "EMAIL", "action": "BLOCKED"}]}},
           {"wordPolicy": {"customWords": [{"action": "BLOCKED"}]}, "topicPolicy": {"topics": [{"name": "loans", "action": "BLOCKED"}]}}]
    df = spark.createDataFrame([(json.dumps(doc),)], "j string").select(runs.blocked_labels(F.from_json("j", runs.ASSESSMENTS)).alias("l"))
    assert df.first().l == ["pii:EMAIL", "topic:loans", "word:custom"]


def test_summary_view(spark, lake):
    names = ("rules", "foreign_keys", "duplicates", "contracts", "arrivals", "volumes")
    view = summary_view({n: readers.read_report(spark, lake, "silver", n) for n in names})
    rows = {(r.report, r.table_name, r.check_name): r for r in view.collect()}
    assert rows["foreign_keys", "transactions", "product_id -> products"].status == "fail"
    assert rows["duplicates", "customers", "conflicting_duplicates"].detail == "1 keys had more than one version"
    assert rows["rules", "campaign_sends", "imputed:subject"].status == "imputed"
    assert ("rules", "branches", "not_unique") not in rows and ("rules", "branches", "not_unique:branch_code") in rows
    assert "days without a file (2023-06-17, " in rows["volumes", "transactions", "volume"].detail
    assert rows["arrivals", "transactions", "late_rows"].status == "warn"
    assert any(k[0] == "contracts" and k[2] == "branch_code: not_unique" for k in rows)
    worst = problems_first(view).first()
    assert worst.status != "ok" and worst.failing_pct == 100.0


def test_findings_name_missing_columns_and_types(spark, silver):
    df = silver("branches").drop("phone").withColumn("atm_count", F.col("atm_count").cast("string"))
    got = {(r.error_type, r.column) for r in findings(df, BANK["branches"], BANK).collect()}
    assert {("COLUMN_NOT_IN_DATAFRAME", "phone"), ("WRONG_DATATYPE", "atm_count"), ("DUPLICATES", "branch_code")} <= got


def test_contract_documentation(spark):
    text = render_markdown(BANK)
    assert "## transactions" in text and "| `amount` | decimal(20,8) | yes | >= 0 |" in text and "reason_category" not in text
    assert "business day from 06:00:00" in text


def test_column_classification(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert classify_columns(df, ["a"], ["b"]) == ["c"]
    with pytest.raises(ValueError, match="missing"):
        classify_columns(df, ["z"])


def test_write_verification(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "2026-01-01", 0.5), (2, "2026-01-01", None)], "id int, as_of_date string, score double")
    sinks.replace_partition(df, path, ["as_of_date"])
    sinks.verify_written(spark.read.parquet(path), 2, ["id"])
    with pytest.raises(RuntimeError, match="read 2 back"):
        sinks.verify_written(spark.read.parquet(path), 3)
    with pytest.raises(RuntimeError, match="null values"):
        sinks.verify_written(spark.read.parquet(path), 2, ["score"])


def test_put_items_sends_batches_without_nulls(spark, tmp_path):
    """The external writer runs on executors; here each batch becomes a file."""
    folder = str(tmp_path)

    def put(client, batch):
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}.json", "w") as out:
            json.dump(batch, out)

    items = spark.range(60).selectExpr("cast(id as string) PK", "'x' SK", "if(id % 2 = 0, id, null) v").repartition(2)
    sinks.put_items(items, lambda: None, put)
    batches = [json.loads(f.read_text()) for f in tmp_path.iterdir()]
    assert sum(map(len, batches)) == 60 and max(map(len, batches)) == 25
    assert all(("v" in i) == (int(i["PK"]) % 2 == 0) for b in batches for i in b)


class FolderClient:
    """A store of one file per item for the sink's tests: it refuses every third item once, and fails a task half way once."""

    def __init__(self, options):
        self.folder, self.fail = Path(options["folder"]), options.get("fail") == "once"

    def put(self, items, load):
        left = []
        for item in items:
            path = self.folder / f"{item['PK']}-{item['SK']}.json"
            refused = self.folder / f"{path.name}.refused"
            if int(item["SK"]) % 3 == 0 and not refused.exists():
                refused.touch()
                left.append(item)
            elif not path.exists() or json.loads(path.read_text())["load"] != load:
                with open(self.folder / "puts.log", "a") as log:
                    log.write(f"{path.name}\n")
                path.write_text(json.dumps({"load": load, "item": item}))
        if self.fail and len(items) < 5 and not (self.folder / "failed").exists():
            (self.folder / "failed").touch()
            raise RuntimeError("the connection is lost after a put")
        return left

    def finish(self, load, count):
        with open(self.folder / "loads.log", "a") as log:
            log.write(f"{load} {count}\n")

    def abandon(self, load):
        (self.folder / "abandoned").write_text(load)


def items_of(spark, n):
    return spark.range(n).select(F.lit("P").alias("PK"), F.col("id").cast("string").alias("SK"), F.when(F.col("id") % 2 == 0, "even").alias("kind"),
                                 F.struct(F.col("id").alias("n"), F.lit(None).cast("string").alias("none")).alias("inner"))


def test_items_are_put_once_though_tasks_repeat(spark, tmp_path):
    spark.dataSource.register(ItemSink)
    write = lambda folder, **more: items_of(spark, 63).repartition(3).write.format("items").options(client="tests.test_runs:FolderClient", folder=str(folder), load="l1", batch="10", **more).mode("append")
    write(tmp_path).save()
    write(tmp_path).save()  # the whole load again
    puts = (tmp_path / "puts.log").read_text().split()
    assert len(puts) == len(set(puts)) == 63 and (tmp_path / "loads.log").read_text().split() == ["l1", "63"] * 2
    stored = {p.stem: json.loads(p.read_text())["item"] for p in tmp_path.glob("P-*.json")}
    assert stored["P-4"] == {"PK": "P", "SK": "4", "kind": "even", "inner": {"n": 4}} and "kind" not in stored["P-5"]
    broken = tmp_path / "broken"
    broken.mkdir()
    with pytest.raises(Exception, match="connection is lost"):
        write(broken, fail="once").save()
    assert (broken / "abandoned").read_text() == "l1"
    write(broken, fail="once").save()  # the driver tries again: what had been put before stays as it is
    puts = (broken / "puts.log").read_text().split()
    assert len(puts) == len(set(puts)) == 63 and (broken / "loads.log").read_text().split() == ["l1", "63"]


def test_items_of_a_stream(spark, tmp_path):
    spark.dataSource.register(ItemSink)
    source, store = str(tmp_path / "in"), tmp_path / "store"
    store.mkdir()
    for k in range(2):
        items_of(spark, 20 + k).where(f"SK >= {k * 20}").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(items_of(spark, 1).schema).option("maxFilesPerTrigger", 1).parquet(source)
    stream.writeStream.format("items").options(client="tests.test_runs:FolderClient", folder=str(store), checkpointLocation=str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()
    puts = (store / "puts.log").read_text().split()
    assert len(puts) == len(set(puts)) == 21
    assert sorted((store / "loads.log").read_text().splitlines()) == ["stream/0 20", "stream/1 1"]
