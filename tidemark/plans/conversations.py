"""Turn tables as batch jobs: sessions, failure streaks, metrics, retention, transcripts and handoff queues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordering import latest_per_key, nearest_ranks, pages, running_totals
from tidemark.operators.sketches import quantile, sketch

# Fixed values.
IDLE_MINUTES = 10
FAILURES_BEFORE_HANDOFF = 2
MAX_TURNS, MAX_FACTS = 20, 10
SESSION_DAYS, HANDOFF_DAYS = 7, 30
PART_TURNS = 1000  # turns on a page of a transcript


def sessions(df: DataFrame, user: str, ts: str, idle_minutes: int = IDLE_MINUTES) -> DataFrame:
    """Sessions per user: a gap longer than the idle time starts a new one.

    Two steps, so that one user's events may fill the cluster: runs without a long gap are found within each
    user and hour, then neighbouring runs are joined. The second step sees a few rows per user and hour,
    however many events they hold.
    """
    idle = F.expr(f"INTERVAL {idle_minutes} MINUTES")
    at = df.where(F.col(user).isNotNull() & F.col(ts).isNotNull()).groupBy(user, ts).agg(F.count("*").alias("_n"))

    def runs(rows: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(start, end)
        gap = F.col(start) > F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)) + idle
        numbered = rows.withColumn("_new", F.coalesce(gap, F.lit(True)).cast("int")).withColumn(
            "_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        return numbered.groupBy(*keys, "_run").agg(F.min(start).alias("session_start"), F.max(end).alias("session_end"), F.sum("_n").alias("_n")).drop("_run")

    hourly = at.withColumns({"_hour": F.date_trunc("hour", ts), "_end": F.col(ts)})
    pieces = runs(hourly, [user, "_hour"], ts, "_end").drop("_hour")
    return runs(pieces, [user], "session_start", "session_end").withColumnRenamed("_n", "events")


def failure_streaks(df: DataFrame, session: str, order: Sequence[Column], failed: Column, neutral: Column,
                    limit: int = FAILURES_BEFORE_HANDOFF, start: Column | None = None) -> DataFrame:
    """consecutive_failures after each turn, and whether the turn hands off. A failure adds one, a success resets, a
    neutral turn changes nothing, a handoff resets; `start` is what a session begins with. Running totals are taken over range slices,
    so a session of any length spreads over tasks; the failures before the last success come along as a running maximum."""
    fails = F.coalesce(failed, F.lit(False))
    success = ~fails & ~F.coalesce(neutral, F.lit(False))
    # `_failed`/`_success` are per-turn marks, `_fails`/`_wins` how many so far in the session
    marked = df.withColumns({"_failed": fails.cast("int"), "_success": success.cast("int")})
    # a success does not add a failure, so what counts before a turn is the total at the latest success
    counted = running_totals(marked, [session], order, {"_fails": F.col("_failed")}, {"_before": ("_fails", F.col("_success") == 1)})
    inside = F.col("_fails") - F.coalesce("_before", -start if start is not None else F.lit(0))
    hands_off = (F.col("_failed") == 1) & (inside % limit == 0)
    return counted.withColumns({"consecutive_failures": (inside % limit).cast("int"), "escalated": hands_off}).drop("_failed", "_success", "_fails", "_before")


def turn_metrics(df: DataFrame, ts: str, window: str = "5 minutes", keys: Sequence[str] = ()) -> DataFrame:
    """Turns, failures, escalations, blocks and fallbacks per window; latency as a mergeable sketch and its quantiles; mean requests and tokens."""
    return with_figures(df.groupBy(F.window(F.col(ts), window).alias("window"), *keys).agg(*metric_columns()))


# What every window keeps, and the type of its one buffer in a stream's state.
METRIC_BUFFERS = ("turns bigint, failed bigint, escalated bigint, blocked bigint, fallback bigint, latency binary, latency_max double, "
                  "requests_n bigint, requests_sum bigint, input_n bigint, input_sum bigint, output_n bigint, output_sum bigint")


def metric_columns() -> list[Column]:
    means = [c for name, column in (("requests", "model_requests"), ("input", "input_tokens"), ("output", "output_tokens"))
             for c in (F.count(column).alias(f"{name}_n"), F.sum(F.col(column).cast("bigint")).alias(f"{name}_sum"))]
    return [
        F.count("*").alias("turns"), F.count_if("failed").alias("failed"), F.count_if("escalated").alias("escalated"),
        F.count_if(F.col("status") == "blocked").alias("blocked"), F.count_if("fallback_used").alias("fallback"),
        sketch("latency_ms").alias("latency"), F.max("latency_ms").alias("latency_max"), *means]


def with_figures(windows: DataFrame) -> DataFrame:
    """Quantiles and means of windows that hold sketches and sums; the sketch stays, for longer windows."""
    means = {name: F.col(f"{part}_sum") / F.col(f"{part}_n") for name, part in (("requests", "requests"), ("input_tokens", "input"), ("output_tokens", "output"))}
    figured = windows.withColumns({**means, "latency_p50": quantile("latency", 0.5), "latency_p95": quantile("latency", 0.95)})
    return figured.drop(*(f"{p}_{k}" for p in ("requests", "input", "output") for k in ("n", "sum")))


def latency_counts(df: DataFrame, ts: str, window: str = "5 minutes", latency: str = "latency_ms") -> DataFrame:
    """How often each latency occurs in each window. Counts of parts add up to those of the whole and to those of longer windows, so quantiles
    taken from them are exact at any size, where a sketch is up to its parameter."""
    return df.groupBy(F.window(F.col(ts), window)["start"].alias("start"), F.col(latency).alias("latency")).agg(F.count("*").alias("turns"))


def with_exact_quantiles(windows: DataFrame, counts: DataFrame, percents: Sequence[int] = (50, 95)) -> DataFrame:
    """Windows with the quantiles of their latency counts instead of those of their sketch."""
    summed = counts.groupBy("start", "latency").agg(F.sum("turns").alias("turns"))
    found = nearest_ranks(summed, "latency", "turns", percents, ["start"], "latency", "_turns").drop("_turns")
    return windows.drop(*(f"latency_p{p}" for p in percents)).withColumn("start", F.col("window.start")).join(found, "start", "left").drop("start")


def latency_levels(counts: DataFrame, units: Sequence[str], percents: Sequence[int]) -> DataFrame:
    """Turns and latency quantiles of the longer windows that hold the counted ones."""
    levels = F.array(*[F.struct(F.lit(u).alias("level"), F.date_trunc(u, "start").alias("start")) for u in units])
    summed = counts.select("latency", "turns", F.inline(levels)).groupBy("level", "start", "latency").agg(F.sum("turns").alias("turns"))
    return nearest_ranks(summed, "latency", "turns", percents, ["level", "start"], "latency", "turns")


def by_engine_and_status(df: DataFrame) -> DataFrame:
    return df.groupBy("engine", "status").agg(
        F.count("*").alias("turns"), F.avg("latency_ms").alias("avg_ms"), F.avg("model_requests").alias("requests"),
        F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"))


def slowest(df: DataFrame, n: int = 20, tie: str = "turn_id") -> DataFrame:
    return df.orderBy(F.col("latency_ms").desc(), F.col(tie).asc()).limit(n)


def quota_alarms(df: DataFrame, ts: str, requests: str, per_minute: float) -> DataFrame:
    """Minutes with more requests than the quota."""
    counted = df.groupBy(F.window(F.col(ts), "1 minute").alias("window")).agg(F.sum(requests).alias("requests"))
    return counted.where(F.col("requests") > per_minute).select(F.col("window.start").alias("minute"), "requests")


def unexpired(df: DataFrame, ts: str, days: int, now: Column) -> DataFrame:
    """Rows that retention still keeps at `now`."""
    return df.where(F.col(ts) + F.make_dt_interval(F.lit(days)) > now)


def transcripts(df: DataFrame, session: str, number: str, role: str, text: str, per_row: int = PART_TURNS) -> DataFrame:
    """Each conversation as text in turn order, in parts that follow each other, so none is cut and none has to fit one row."""
    turn = F.struct(F.col(number).alias("n"), F.col(role).alias("role"), F.col(text).alias("text"))
    listed = pages(df, [session], [F.col(c).asc() for c in (number, role, text)], per_row, "part").groupBy(session, "part").agg(F.array_sort(F.collect_list(turn)).alias("_turns"))
    lines = F.transform("_turns", lambda t: F.concat(t["role"], F.lit(": "), t["text"]))
    return listed.select(session, "part", F.size("_turns").alias("turns"), F.array_join(lines, "\n").alias("transcript"))


def recent_turns(df: DataFrame, session: str, order: Sequence[str], opening: Column | None = None, n: int = MAX_TURNS) -> DataFrame:
    """The newest turns since the opening one; earlier turns belong to an expired conversation."""
    alive = df if opening is None else df.where(opening)
    return latest_per_key(alive, [session], [F.col(c).desc() for c in order], n)


def since_opening(df: DataFrame, session: str, order: str, is_opening: Column) -> DataFrame:
    """Turns from the session's latest opening message on. One value per session is joined back."""
    starts = df.groupBy(session).agg(F.max(F.when(is_opening, F.col(order))).alias("_start"))
    return df.join(starts, session).where(F.col("_start").isNull() | (F.col(order) >= F.col("_start"))).drop("_start")


def current_facts(df: DataFrame, session: str, tool: str, at: str, n: int = MAX_FACTS) -> DataFrame:
    """The latest fact per tool, the most recent ones of a session. Facts of one moment are told apart by their content, so a rerun
    keeps the same one."""
    content = F.xxhash64(*[c for c, t in df.dtypes if "map<" not in t and "variant" not in t])
    latest = latest_per_key(df, [session, tool], [F.col(at).desc(), content.desc()])
    return latest_per_key(latest, [session], [F.col(at).desc(), F.col(tool).desc()], n)


def handoff_queue(df: DataFrame, status: str | None = "pending", limit: int | None = None, handoff_id: str | None = None,
                  session: str | None = None) -> DataFrame:
    """Handoffs newest first: one by id whatever its status, or those of a status, optionally of one session."""
    if handoff_id:
        df = df.where(F.col("id") == handoff_id)
    elif status:
        df = df.where(F.col("status") == status)
    if session:
        df = df.where(F.col("session_id") == session)
    ordered = df.orderBy(F.col("created_at").desc(), F.col("id").asc())
    return ordered.limit(limit) if limit else ordered
