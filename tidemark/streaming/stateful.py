"""Stateful stream operators whose result does not depend on how turns arrive.

Turns of a session wait in map state, in chunks of one Arrow batch or less, until the watermark has passed; then they are worked through in
event time. A chunk is fetched when the merge reaches its first turn, so that a session is never held whole: arrivals are nearly in
order, and a few chunks overlap. What is remembered of a session is one value with a lifetime in event time: it is forgotten
`keep_minutes` after its last turn. What the watermark has not reached when a stream stops is read from the state of its
checkpoint, and a batch form gives its result.
"""

from __future__ import annotations

import itertools
import json
import random
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.plans.conversations import FAILURES_BEFORE_HANDOFF, SESSION_DAYS, failure_streaks
from tidemark.streaming.jobs import run_available, state_of, with_event_time

PENDING, MEMORY = "pending", "memory"
MEMORY_SCHEMA = "failures int, turns bigint, first bigint, last bigint"  # times in microseconds
AT_ONCE = 10_000  # turns worked through between two outputs
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Deals a session's turns (time, turn, failed, neutral) out in their order."""

    def __init__(self, session: str, ts: str, turn: str, keep_minutes: int):
        self.session, self.ts, self.turn, self.keep = session, ts, turn, keep_minutes * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState(PENDING, "first bigint, chunk bigint", "turns string")
        self.memory = handle.getValueState(MEMORY, MEMORY_SCHEMA)

    def put(self, turns: list[tuple]) -> None:
        """Keeps turns, which are in order, until a timer finds the watermark beyond the first of them."""
        columns = dict(zip(("at", "turn", "failed", "neutral"), map(list, zip(*turns))))
        self.pending.updateValue((turns[0][0], random.getrandbits(62)), (json.dumps(columns),))
        self.handle.registerTimer(turns[0][0] // 1000 + 1)

    def take(self, slot: tuple, horizon: int) -> Iterator[tuple]:
        """The turns of a chunk before the horizon; later ones are kept again."""
        turns = list(zip(*json.loads(self.pending.getValue(slot)[0]).values()))
        self.pending.removeKey(slot)
        due = bisect_left(turns, horizon, key=lambda t: t[0])
        if due < len(turns):
            self.put(turns[due:])
        return iter(turns[:due])

    def in_order(self, horizon: int) -> Iterator[tuple]:
        slots = sorted(k for k in map(tuple, self.pending.keys()) if k[0] < horizon)
        heap: list = []  # the next turn of every chunk that has been reached, and the rest of that chunk
        while slots or heap:
            while slots and (not heap or slots[0][0] <= heap[0][0][0]):
                chunk = self.take(slots[0], horizon)
                heappush(heap, (next(chunk), slots.pop(0), chunk))
            turn, slot, chunk = heappop(heap)
            following = next(chunk, None)
            if following is not None:
                heappush(heap, (following, slot, chunk))
            yield turn

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            at = batch[self.ts].astype("datetime64[us, UTC]" if batch[self.ts].dt.tz else "datetime64[us]").astype("int64").tolist()
            marks = (batch[c].fillna(False).astype(bool).tolist() for c in ("failed", "neutral"))
            self.put(sorted(zip(at, batch[self.turn].tolist(), *marks)))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        horizon = timerValues.getCurrentWatermarkInMs() * 1000  # all turns before it are here
        known = self.memory.get()  # null when nothing is remembered
        for turns in itertools.batched(self.in_order(horizon), AT_ONCE):
            known, out = self.advance(key, known, turns)
            if len(out):
                yield out
        if known is not None and known[3] + self.keep < horizon:
            ended, known = self.ended(key, known), None
            if len(ended):
                yield ended
        if known is None:
            self.memory.clear()
        else:
            self.memory.update(tuple(known))
            self.handle.registerTimer((known[3] + self.keep) // 1000 + 1)

    def advance(self, key, known, turns: Sequence[tuple]):
        """What is remembered after these turns, and the rows they give."""
        raise NotImplementedError

    def ended(self, key, known) -> pd.DataFrame:
        return pd.DataFrame()

    def close(self) -> None:
        pass


class FailureCounter(InOrder):
    """consecutive_failures after every turn; a failure adds one, a success resets, a handoff resets, a forgotten session starts anew."""

    def __init__(self, session: str, ts: str, turn: str, keep_minutes: int, limit: int):
        super().__init__(session, ts, turn, keep_minutes)
        self.limit = limit

    def advance(self, key, known, turns):
        failures, n, first, last = known or (0, 0, turns[0][0], turns[0][0])
        counts, handoffs = [], []
        for at, _, failed, neutral in turns:
            if at > last + self.keep:
                failures, n, first = 0, 0, at
            failures = (failures + 1) % self.limit if failed else failures if neutral else 0
            counts.append(failures)
            handoffs.append(failed and failures == 0)
            n, last = n + 1, at
        out = pd.DataFrame({self.session: [key[0]] * len(turns), self.turn: [t[1] for t in turns], self.ts: pd.to_datetime([t[0] for t in turns], unit="us", utc=True),
                            "consecutive_failures": pd.array(counts, "int32"), "escalated": handoffs})
        return (failures, n, first, last), out


class Retention(InOrder):
    """One row for every session that ended because nothing came for `keep_minutes`: its first and last turn, and how many."""

    def rows(self, key, ends: list[tuple]) -> pd.DataFrame:
        """All ended sessions of a call in one frame, times in microseconds: a frame for each would cost more than the turns themselves."""
        return pd.DataFrame({self.session: [key[0]] * len(ends), "first": [e[2] for e in ends], "last": [e[3] for e in ends], "turns": [e[1] for e in ends]})

    def advance(self, key, known, turns):
        ends = []
        for at, *_ in turns:
            if known is not None and at > known[3] + self.keep:
                ends.append(known)
                known = None
            known = (0, 1, at, at) if known is None else (0, known[1] + 1, known[2], at)
        return known, self.rows(key, ends) if ends else pd.DataFrame()

    def ended(self, key, known):
        return self.rows(key, [known])


@contextmanager
def state_in_rocksdb(spark: SparkSession):
    """Timers and state variables need this store; other queries of the session keep theirs."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def marked(df: DataFrame, session: str, ts: str, turn: str, delay: str) -> DataFrame:
    return with_event_time(df.select(session, turn, ts, "failed", "neutral"), ts, delay).groupBy(session)


def count_failures(df: DataFrame, session: str, ts: str, turn: str, target: str, checkpoint: str, limit: int = FAILURES_BEFORE_HANDOFF,
                   delay: str = "10 minutes", keep_minutes: int = SESSION_DAYS * 1440) -> DataFrame:
    """Runs the counter over what has arrived of a stream with columns failed and neutral, into `target`; returns the rows written and,
    for the turns that still wait in the state, what the counter would give them."""
    spark, kinds = df.sparkSession, dict(df.dtypes)
    output = f"{session} {kinds[session]}, {turn} {kinds[turn]}, {ts} timestamp, consecutive_failures int, escalated boolean"
    counter = FailureCounter(session, ts, turn, keep_minutes, limit)
    with state_in_rocksdb(spark):
        run_available(marked(df, session, ts, turn, delay).transformWithStateInPandas(counter, output, "Append", "EventTime"), target, checkpoint)
        waiting = pending_turns(spark, checkpoint, session, ts, turn, kinds)
        known = remembered(spark, checkpoint, session, kinds).select(F.col(session).alias("_session"), "failures", F.col("last").alias("_last"))
    begun = waiting.groupBy(session).agg(F.min(ts).alias("_from")).join(known, F.col(session) == F.col("_session"))
    alive = begun.where(F.unix_micros("_from") <= F.col("_last") + F.lit(keep_minutes * 60_000_000)).select("_session", "failures")
    # One row per session: the join meets it with the session's waiting turns, which AQE splits where they are many.
    rows = waiting.join(alive, F.col(session) == F.col("_session"), "left").drop("_session")
    start = F.coalesce("failures", F.lit(0))
    opened = failure_streaks(rows, session, [F.col(ts), F.col(turn)], F.col("failed"), F.col("neutral"), limit, start)
    return spark.read.schema(output).parquet(target).unionByName(opened.select(session, turn, ts, "consecutive_failures", "escalated"))


def end_sessions(df: DataFrame, session: str, ts: str, turn: str, target: str, checkpoint: str, keep_minutes: int, delay: str = "10 minutes") -> DataFrame:
    """Runs the retention over what has arrived of a stream, into `target`, and returns the rows written."""
    spark, kinds = df.sparkSession, dict(df.dtypes)
    output = f"{session} {kinds[session]}, first bigint, last bigint, turns bigint"
    with state_in_rocksdb(spark):
        found = marked(df, session, ts, turn, delay).transformWithStateInPandas(Retention(session, ts, turn, keep_minutes), output, "Append", "EventTime")
        ended = found.select(session, F.timestamp_micros("first").alias("first_turn"), F.timestamp_micros("last").alias("last_turn"), "turns")
        run_available(ended, target, checkpoint)
    return spark.read.schema(f"{session} {kinds[session]}, first_turn timestamp, last_turn timestamp, turns bigint").parquet(target)


# ---- What a stream has not emitted yet, from its checkpoint ----

def pending_turns(spark: SparkSession, checkpoint: str, session: str, ts: str, turn: str, kinds: dict[str, str]) -> DataFrame:
    """The turns that wait for the watermark."""
    entries = state_of(spark, checkpoint, PENDING)
    chunk = F.from_json(F.col("user_map_value.turns"), f"at array<bigint>, turn array<{kinds[turn]}>, failed array<boolean>, neutral array<boolean>")
    lists = entries.select(F.col(f"key.{session}").alias(session), chunk.alias("c")).select(session, "c.*")
    rows = lists.select(session, F.explode(F.arrays_zip("at", "turn", "failed", "neutral")).alias("t"))
    return rows.select(session, F.col("t.turn").alias(turn), F.timestamp_micros("t.at").alias(ts), "t.failed", "t.neutral")


def remembered(spark: SparkSession, checkpoint: str, session: str, kinds: dict[str, str]) -> DataFrame:
    """What is remembered of every session that has not been forgotten."""
    return state_of(spark, checkpoint, MEMORY).select(F.col(f"key.{session}").alias(session), "value.*")

