"""Publishing gates measured by the job that writes: no second read, and no failure before its report is written.

A gate is an aggregate of the rows as they pass to the sink (`Dataset.observe`). What it measures is a share of checked rows, a count, or a
largest value; above its limit it fails. The verdicts are one row per gate. Repeated attempts of a task count once, as the measured
operator stands in the stage that writes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.sinks import append_report

REPORT = "gate string, subject string, measured double, allowed double, checked_rows bigint, status string"


class QualityGateError(RuntimeError):
    """A gate failed; the table and its report are already written."""


@dataclass(frozen=True)
class Gate:
    """`measured` is an aggregate; with `checked`, another one, it counts rows and is judged as a percentage of these."""

    name: str
    subject: str
    measured: Column
    allowed: float
    checked: Column | None = None


def share_gate(name: str, subject: str, broken: Column, allowed_pct: float, among: Column | None = None) -> Gate:
    """At most `allowed_pct` percent of the rows (of those `among`) may be broken."""
    rows = F.count("*") if among is None else F.count_if(among)
    return Gate(name, subject, F.count_if(F.coalesce(broken, F.lit(False))), allowed_pct, rows)


def none_gate(name: str, subject: str, broken: Column) -> Gate:
    """No row may be broken; a rule that is not decided is broken."""
    return Gate(name, subject, F.count_if(F.coalesce(broken, F.lit(True))), 0.0)


def verdicts(gates: Sequence[Gate], found: dict) -> list[tuple]:
    out = []
    for k, gate in enumerate(gates):
        measured, rows = found.get(f"m{k}"), found.get(f"c{k}")
        value = float(measured or 0)
        if gate.checked is not None:
            value = round(100.0 * value / rows, 3) if rows else 0.0
        out.append((gate.name, gate.subject, value, float(gate.allowed), rows, "fail" if value > gate.allowed else "ok"))
    return out


def write_through(df: DataFrame, gates: Sequence[Gate], write: Callable[[DataFrame], None], report: str | None = None, drop: Sequence[str] = ()) -> list[tuple]:
    """Hands the rows (less the columns of `drop`, which only gates read) to `write`, and returns the verdicts, which are appended to the folder
    `report` first."""
    if not gates:
        write(df.drop(*drop))
        return []
    seen = Observation(f"gates-{uuid.uuid4().hex}")
    aggregates = [c.alias(f"{n}{k}") for k, g in enumerate(gates) for n, c in (("m", g.measured), ("c", g.checked)) if c is not None]
    write(df.observe(seen, *aggregates).drop(*drop))
    found = verdicts(gates, seen.get)
    if report:
        append_report(as_report(df.sparkSession, found), report)
    return found


def as_report(spark: SparkSession, found: Sequence[tuple]) -> DataFrame:
    """The verdicts as rows: one per configured gate."""
    return spark.createDataFrame(list(found), REPORT).coalesce(1)


def enforce(found: Sequence[tuple]) -> None:
    """Stops when a gate failed."""
    bad = sorted(f"{name} {subject} ({measured:g} > {allowed:g})" for name, subject, measured, allowed, _, status in found if status == "fail")
    if bad:
        raise QualityGateError(" | ".join(bad))
