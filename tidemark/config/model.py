"""Tables, contracts and references described as data. Nothing here touches Spark."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from graphlib import TopologicalSorter

# Column type words used in table texts -> Spark SQL types. Money is exact; other numbers are doubles.
SQL_TYPES = {
    "string": "string", "date": "date", "timestamp": "timestamp", "int": "int", "double": "double",
    "bool": "boolean", "money": "decimal(20,8)", "long": "bigint", "timestamp_ntz": "timestamp_ntz",
}


@dataclass(frozen=True)
class Reference:
    """A foreign key. `optional`: a null is not an orphan. `known_broken`: why its values cannot be used;
    such a key is reported but never flags a row nor fails a run."""

    column: str
    parent: str
    parent_column: str
    optional: bool = False
    known_broken: str = ""


@dataclass(frozen=True)
class TableSpec:
    name: str
    key: tuple[str, ...]
    types: Mapping[str, str]  # column -> type word, in header order
    required: frozenset[str] = frozenset()
    unique: tuple[str, ...] = ()
    allowed: Mapping[str, tuple] = field(default_factory=dict)
    ranges: Mapping[str, tuple] = field(default_factory=dict)  # column -> (low, high or None), inclusive
    in_order: tuple[tuple[str, str], ...] = ()  # (earlier, later)
    references: tuple[Reference, ...] = ()
    event_time: str = ""  # must fall inside the dataset's dates
    day_start: str = "00:00:00"  # when the table's business day begins
    lag_anchor: str = ""  # "", "session" or "parent": whose time process_date follows
    updated_by: str = ""
    partition_by: str = ""
    dropped: tuple[str, ...] = ()
    expected_rows: int | None = None

    @property
    def source_columns(self) -> list[str]:
        return list(self.types)

    @property
    def kept_columns(self) -> list[str]:
        return [c for c in self.types if c not in self.dropped]

    def sql_type(self, column: str) -> str:
        return SQL_TYPES[self.types[column]]


@dataclass(frozen=True)
class Catalog:
    """All tables of one dataset and the dates it covers."""

    tables: Mapping[str, TableSpec]
    start: str
    end: str

    def __getitem__(self, name: str) -> TableSpec:
        return self.tables[name]

    def build_order(self, names=None) -> list[str]:
        """Parents before children, so every reference is checked against a finished parent."""
        names = list(names or self.tables)
        parents = {n: {r.parent for r in self.tables[n].references} & set(names) for n in names}
        return list(TopologicalSorter(parents).static_order())


def table(name: str, key: str, columns: str, **options) -> TableSpec:
    """A TableSpec from a text of `column`, `column:type` or `column:type!` (! = may not be null)."""
    types, required = {}, set()
    for word in columns.split():
        must = word.endswith("!")
        column, _, kind = word.rstrip("!").partition(":")
        types[column] = kind or "string"
        if must:
            required.add(column)
    return TableSpec(name=name, key=tuple(key.split()), types=types, required=frozenset(required), **options)


def with_options(spec: TableSpec, **options) -> TableSpec:
    return replace(spec, **options)
