"""Turning delivered text into typed columns. A bad value becomes null; it never fails the job."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config.model import SQL_TYPES, TableSpec

# Texts that mean "no value", spellings to unify, texts that mean true.
NULL_WORDS = ["", "nan", "NaN", "None", "null", "NULL", "N/A"]
COUNTRY_SPELLING = {"Mexico": "México"}
TRUE_WORDS = ["true", "1", "t", "yes", "si", "sí"]
CURRENCY_COLUMNS = {"currency", "source_currency", "target_currency"}
COUNTRY_COLUMNS = {"country", "transaction_country", "target_country", "country_of_origin", "ip_country"}


def blank_to_null(text: Column) -> Column:
    trimmed = F.trim(text)
    return F.when(~trimmed.isin(*NULL_WORDS), trimmed)


def respell(text: Column, spelling: Mapping[str, str]) -> Column:
    out = text
    for wrong, right in spelling.items():
        out = F.when(text == wrong, F.lit(right)).otherwise(out)
    return out


def typed(text: Column, kind: str) -> Column:
    """A cleaned text as the given type word; the try_ forms give null where ANSI mode would throw."""
    if kind == "date":
        # a full timestamp is accepted and cut to its day
        return F.coalesce(F.try_to_date(text), text.try_cast("date"))
    if kind == "timestamp":
        return text.try_cast("timestamp")
    if kind == "int":  # through double, so "3.0" is 3
        return text.try_cast("double").try_cast("int")
    if kind == "money":
        return text.try_cast("decimal(20,8)")
    if kind == "double":
        return text.try_cast("double")
    if kind == "bool":  # null stays null, any other text is false
        return F.lower(text).isin(*TRUE_WORDS)
    if kind in ("long", "timestamp_ntz"):
        return text.try_cast(SQL_TYPES[kind])
    return text


def clean(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Every declared column cleaned and typed in one projection; other columns pass through."""
    out = []
    for c in df.columns:
        if c not in spec.types:
            out.append(F.col(c))
            continue
        value = typed(blank_to_null(F.col(c)), spec.types[c])
        if c in CURRENCY_COLUMNS:
            value = F.upper(value)
        if c in COUNTRY_COLUMNS:
            value = respell(value, COUNTRY_SPELLING)
        out.append(value.alias(c))
    return df.select(*out)
