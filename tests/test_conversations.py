import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidemark.config.bank import BANK
from tidemark.operators import sketches
from tidemark.plans import conversations as conv
from tidemark.sources import readers
from tidemark.streaming import jobs, latest, stateful

START = datetime.datetime(2026, 1, 1, 8)


@pytest.fixture(scope="module")
def turns():
    rng, rows = random.Random(5), []
    for i in range(900):
        user = "hot" if i % 3 == 0 else f"u{rng.randrange(12)}"
        outcome = rng.choice(["fail", "fail", "ok", "neutral"])
        rows.append((i, user, START + datetime.timedelta(seconds=rng.randrange(6 * 86400)), outcome == "fail", outcome == "neutral"))
    return rows


LAYOUT = "id long, user string, ts timestamp, failed boolean, neutral boolean"


def brute_streaks(rows):
    state, out = {}, {}
    for i, user, ts, failed, neutral in sorted(rows, key=lambda r: (r[2], r[0])):
        n = state.get(user, 0)
        n = n + 1 if failed else n if neutral else 0
        handoff = failed and n >= 2
        n = 0 if handoff else n
        state[user] = n
        out[i] = (n, handoff)
    return out


def brute_sessions(rows, minutes):
    out = {}
    for _, user, ts, *_ in sorted(rows, key=lambda r: r[2]):
        runs = out.setdefault(user, [])
        if runs and ts - runs[-1][1] <= datetime.timedelta(minutes=minutes):
            runs[-1] = (runs[-1][0], ts, runs[-1][2] + 1)
        else:
            runs.append((ts, ts, 1))
    return sorted((u, *r) for u, rs in out.items() for r in rs)


def test_streaks_match_a_loop(spark, turns):
    df = spark.createDataFrame(turns, LAYOUT).repartition(6)
    out = conv.failure_streaks(df, "user", [F.col("ts"), F.col("id")], F.col("failed"), F.col("neutral"))
    assert {r.id: (r.consecutive_failures, r.escalated) for r in out.collect()} == brute_streaks(turns)


@pytest.mark.parametrize("minutes", [10, 45, 180])
def test_sessions_match_a_loop(spark, turns, minutes):
    out = conv.sessions(spark.createDataFrame(turns, LAYOUT), "user", "ts", minutes)
    assert sorted((r.user, r.session_start, r.session_end, r.events) for r in out.collect()) == brute_sessions(turns, minutes)


def test_idle_boundary(spark):
    at = lambda s: START + datetime.timedelta(seconds=s)
    rows = [(1, "a", at(0), False, False), (2, "a", at(600), False, False), (3, "a", at(1201), False, False)]
    assert conv.sessions(spark.createDataFrame(rows, LAYOUT), "user", "ts", 10).count() == 2  # ten minutes stay together, a second more does not


def write_files(spark, rows, folder, parts):
    """Arriving files in time order."""
    rows = sorted(rows, key=lambda r: r[2])
    size = len(rows) // parts + 1
    for k in range(parts):
        chunk = rows[k * size:(k + 1) * size]
        if chunk:
            spark.createDataFrame(chunk, LAYOUT).coalesce(1).write.mode("append").parquet(folder)


def test_streamed_streaks_over_several_batches(spark, turns, tmp_path):
    folder = str(tmp_path / "in")
    write_files(spark, turns, folder, 4)
    stream = spark.readStream.schema(LAYOUT).option("maxFilesPerTrigger", 1).parquet(folder)
    for file in range(3):  # the same stream goes on from its checkpoint
        out = stateful.count_failures(stream, "user", "ts", "id", str(tmp_path / "out"), str(tmp_path / "progress"))
        assert {r.id: (r.consecutive_failures, r.escalated) for r in out.collect()} == brute_streaks(arrived(spark, folder))
        if file < 2:
            late = [(5000 + 300 * file + k, "hot", max(r[2] for r in turns) + datetime.timedelta(minutes=30 * (file + 1), seconds=7 * (k % 250)), k % 3 > 0, k % 7 == 0) for k in range(300)]
            spark.createDataFrame(late, LAYOUT).coalesce(1).write.mode("append").parquet(folder)
    written = spark.read.parquet(str(tmp_path / "out"))
    assert 0 < written.count() < out.count()


def arrived(spark, folder):
    return [(r.id, r.user, r.ts, r.failed, r.neutral) for r in spark.read.parquet(folder).collect()]


def test_sessions_end_when_their_state_is_forgotten(spark, turns, tmp_path):
    """In one batch or in many, the same sessions end: those whose last turn is longer ago than they are kept."""
    keep = datetime.timedelta(minutes=60)
    at = max(r[2] for r in turns).replace(microsecond=0)
    rows = turns + [(9000 + k, "hot", at - datetime.timedelta(minutes=k // 3 * 2), k % 2 > 0, False) for k in range(300)]
    runs = {}
    for _, user, ts, *_ in sorted(rows, key=lambda r: r[2]):
        mine = runs.setdefault(user, [])
        if mine and ts - mine[-1][-1] <= keep:
            mine[-1].append(ts)
        else:
            mine.append([ts])
    last = max(r[2] for r in rows)
    horizon = last.replace(microsecond=last.microsecond // 1000 * 1000) - datetime.timedelta(minutes=10)
    want = sorted((u, r[0], r[-1], len(r)) for u, mine in runs.items() if u is not None for r in mine if r[-1] + keep < horizon)
    for parts in (1, 4):
        folder = str(tmp_path / f"in{parts}")
        write_files(spark, rows, folder, parts)
        stream = spark.readStream.schema(LAYOUT).option("maxFilesPerTrigger", 1).parquet(folder).where("user IS NOT NULL")
        ended = stateful.end_sessions(stream, "user", "ts", "id", str(tmp_path / f"out{parts}"), str(tmp_path / f"progress{parts}"), 60)
        assert sorted((r.user, r.first_turn, r.last_turn, r.turns) for r in ended.collect()) == want
    assert len(want) > 5


def test_chunks_that_overlap_come_out_in_order():
    counter = stateful.FailureCounter("s", "t", "n", 60, 2)

    class Slots(dict):
        keys = dict.keys
        getValue, removeKey = dict.get, dict.pop

        def updateValue(self, slot, value):
            self[slot] = value

    class Handle:
        timers: list = []

        def registerTimer(self, at):
            self.timers.append(at)

    counter.pending, counter.handle = Slots(), Handle()
    rng = random.Random(1)
    turns = [(rng.randrange(10_000), k, False, False) for k in range(500)]
    for low in range(0, 500, 60):
        counter.put(sorted(turns[low:low + 60]))
    assert list(counter.in_order(7_000)) == sorted(t for t in turns if t[0] < 7_000)
    assert list(counter.in_order(99_999)) == sorted(t for t in turns if t[0] >= 7_000) and not counter.pending


def test_streamed_sessions_equal_batch(spark, turns, tmp_path):
    folder = str(tmp_path / "in")
    write_files(spark, turns, folder, 3)
    stream = spark.readStream.schema(LAYOUT).option("maxFilesPerTrigger", 1).parquet(folder)
    jobs.run_available(jobs.sessions(stream, "user", "ts", 45), str(tmp_path / "out"), str(tmp_path / "progress"))
    got = sorted((r.user, r.session_start, r.session_end, r.events) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    closed = max(r[2] for r in turns) - datetime.timedelta(minutes=10)
    assert got == [s for s in brute_sessions(turns, 45) if s[2] + datetime.timedelta(minutes=45) <= closed]
    still = [(r.user, r.session_start, r.session_end, r.events) for r in jobs.open_sessions(spark, str(tmp_path / "progress"), "user").collect()]
    assert still and sorted(got + still) == brute_sessions(turns, 45)


def test_sketches_merge_within_their_error(spark):
    n = 200_000
    rows = spark.range(n).select((F.col("id") * 7919 % n).alias("v"), F.timestamp_seconds(F.col("id") * 13).alias("at"))
    minutes = rows.groupBy(F.date_trunc("minute", "at").alias("at")).agg(F.count("*").alias("n"), sketches.sketch("v", 200).alias("s"))
    days = sketches.rolled_up(sketches.rolled_up(minutes, "at", "hour", "s", ["n"]), "at", "year", "s", ["n"])
    got = days.select("n", *sketches.quantile_columns("s", "v", (1, 50, 99))).collect()
    assert sum(r.n for r in got) == n and len(got) == 1
    assert all(abs(getattr(got[0], f"v_p{p}") / n - p / 100) < sketches.rank_error(200) for p in (1, 50, 99))
    assert rows.where("v < 0").agg(sketches.sketch("v").alias("s")).select(sketches.quantile("s", 0.5).alias("q")).first().q is None


def test_streamed_keep_latest_over_several_batches(spark, turns, tmp_path):
    folder = str(tmp_path / "in")
    write_files(spark, turns, folder, 3)
    stream = spark.readStream.schema(LAYOUT).option("maxFilesPerTrigger", 1).parquet(folder).select("user", "id", "ts")
    newest = [F.col("ts").desc(), F.col("id").desc()]
    table, store = latest.keep_latest(spark, str(tmp_path / "table"), ["user"], newest, stream.schema, buckets=4)
    assert table.read().count() == 0
    jobs.run_batches(stream, store, str(tmp_path / "progress"))
    want = {}
    for i, user, ts, *_ in sorted(turns, key=lambda r: (r[2], r[0])):
        want[user] = i
    assert {r.user: r.id for r in table.read().collect()} == want and table.read().count() == len(want)
    assert table.versions() == [0, 1, 2]


def test_keep_latest_store_replays_a_batch_and_serves_readers_meanwhile(spark, tmp_path):
    layout, at = "user string, id long, ts timestamp", lambda m: START + datetime.timedelta(minutes=m)
    rows = lambda *r: spark.createDataFrame(list(r), layout)
    table, store = latest.keep_latest(spark, str(tmp_path / "table"), ["user"], [F.col("ts").desc(), F.col("id").desc()], rows(("a", 1, at(0))).schema, buckets=8)
    shown = lambda: {r.user: r.id for r in table.read().collect()}
    store(rows(*((f"u{k}", k, at(k)) for k in range(30)), ("a", 100, at(5))), 0)
    first = table.manifest()
    reader = table.read()
    store(rows(("a", 101, at(9)), ("a", 99, at(1))), 1)
    moved = {b for b, f in table.manifest().items() if first.get(b) != f}
    assert shown()["a"] == 101 and len(shown()) == 31 and len(moved) == 1  # one bucket is rewritten
    assert {r.user: r.id for r in reader.collect()}["a"] == 100  # who began before goes on with what there was
    before = shown()
    store(rows(("a", 101, at(9)), ("a", 99, at(1))), 1)  # the batch again, after a failure
    assert shown() == before and table.versions() == [0, 1]
    # a batch that fails before its manifest leaves the table as it is, whatever it has written
    rows(("a", 7, at(99))).write.parquet(str(tmp_path / "table/data/version=2/bucket=0"))
    assert shown() == before
    store(rows(("a", 102, at(10))), 2)
    assert shown()["a"] == 102 and len(table.superseded(keep=1)) == 2 and not set(table.superseded(keep=1)) & set(table.manifest().values())


def test_streamed_delivery_is_flagged(spark, lake, tmp_path):
    spec = BANK["transactions"]
    jobs.run_available(jobs.ingest(readers.stream_bronze(spark, lake, spec, 1), spec, BANK), str(tmp_path / "out"), str(tmp_path / "progress"))
    rows = {r.transaction_id: r for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.transaction_id}
    assert sorted(rows["T-9"].dq_reasons) == ["not_allowed", "out_of_range"] and rows["T-6"].currency == "USD" and rows["T-1"].dq_is_valid


def test_late_rows_are_counted_not_dropped(spark, tmp_path):
    rows = [(START, START), (START - datetime.timedelta(days=5), START), (START, START + datetime.timedelta(days=2))]
    spark.createDataFrame(rows, "ts timestamp, arrived timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, arrived timestamp").parquet(str(tmp_path / "in"))
    jobs.run_available(jobs.late_counts(stream, "ts", "arrived"), str(tmp_path / "out"), str(tmp_path / "progress"))
    first = spark.read.parquet(str(tmp_path / "out")).first()
    assert (first.rows, first.late_rows) == (2, 1)


def test_quota_stream(spark, tmp_path):
    rows = [(START + datetime.timedelta(seconds=s), 3) for s in (0, 10, 20, 300, 4000)]
    spark.createDataFrame(rows, "ts timestamp, n int").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, n int").parquet(str(tmp_path / "in"))
    jobs.run_available(jobs.quota_alarms(stream, "ts", "n", 5), str(tmp_path / "out"), str(tmp_path / "progress"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(START, 9)]


def test_transcripts_continue_in_parts(spark):
    rows = [("c", i, "user" if i % 2 else "assistant", f"t{i}") for i in range(7)]
    out = conv.transcripts(spark.createDataFrame(rows, "c string, n long, role string, text string"), "c", "n", "role", "text", per_row=5)
    got = {r.part: r.transcript for r in out.collect()}
    assert got[0].startswith("assistant: t0\nuser: t1") and got[1] == "user: t5\nassistant: t6"


def test_handoff_queue(spark):
    rows = [("h1", "s1", "pending", 1), ("h2", "s1", "done", 2), ("h3", "s2", "pending", 3)]
    df = spark.createDataFrame(rows, "id string, session_id string, status string, created_at long")
    ids = lambda **k: [r.id for r in conv.handoff_queue(df, **k).collect()]
    assert ids() == ["h3", "h1"] and ids(status=None) == ["h3", "h2", "h1"] and ids(limit=1) == ["h3"]
    assert ids(handoff_id="h2") == ["h2"] and ids(session="s1") == ["h1"]


def test_retention_and_facts(spark):
    df = spark.createDataFrame([(1, START), (2, START - datetime.timedelta(days=8))], "id int, ts timestamp")
    assert [r.id for r in conv.unexpired(df, "ts", 7, F.lit(START)).collect()] == [1]
    facts = [("s", f"tool{i % 12}", i) for i in range(30)]
    out = conv.current_facts(spark.createDataFrame(facts, "s string, tool string, at int"), "s", "tool", "at")
    assert sorted(r.at for r in out.collect()) == list(range(20, 30))
