"""A Spark data source that writes items to an external key-value store, from batch jobs and from streams.

    spark.dataSource.register(ItemSink)
    items.write.format("items").option("client", "package.module:factory").option("load", "2026-07-01").mode("append").save()
    items.writeStream.format("items").option("client", ...).option("checkpointLocation", ...).start()

`client` names a function of the options that gives an object with

* `put(items, load)`: stores a list of items unless they already carry this load, and returns those it has not taken on;
* `finish(load, count)` and `abandon(load)`: told once, from the driver, when all tasks have ended or the write has failed.

A put carries the name of its load (in a stream, with the number of its batch), so a task or batch that is repeated finds its own items
and puts each once. What a client has not taken on is sent again with growing pauses; what is left after that fails the task. Absent values
are left out of items. Tasks hold one batch of items at a time.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass
from importlib import import_module
from itertools import batched

from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

BATCH_ITEMS, ATTEMPTS, FIRST_PAUSE = 25, 6, 0.05


def client_of(options: dict):
    module, _, name = options["client"].partition(":")
    return getattr(import_module(module), name)(dict(options))


def stored_form(value):
    """A value as an item holds it: rows as dictionaries, absent fields left out at any depth."""
    if isinstance(value, Row):
        return {k: stored_form(v) for k, v in zip(value.__fields__, value) if v is not None}
    if isinstance(value, (list, tuple)):
        return [stored_form(v) for v in value]
    return value


@dataclass
class Sent(WriterCommitMessage):
    """What one task has put."""

    count: int


def send(rows: Iterator[Row], options: dict, load: str) -> Sent:
    client, count = client_of(options), 0
    for batch in batched(map(stored_form, rows), int(options.get("batch", BATCH_ITEMS))):
        left = list(batch)
        for attempt in range(ATTEMPTS):
            if attempt:
                time.sleep(FIRST_PAUSE * 2**attempt)
            left = client.put(left, load) or []
            if not left:
                break
        if left:
            raise RuntimeError(f"the store has not taken {len(left)} items on after {ATTEMPTS} attempts, the first is {left[0].get('PK')}, {left[0].get('SK')}")
        count += len(batch)
    return Sent(count)


class BatchWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.options = options
        self.load = options["load"]

    def write(self, iterator: Iterator[Row]) -> Sent:
        return send(iterator, self.options, self.load)

    def commit(self, messages: list) -> None:
        client_of(self.options).finish(self.load, sum(m.count for m in messages if m))

    def abort(self, messages: list) -> None:
        client_of(self.options).abandon(self.load)


class StreamWriter(DataSourceStreamWriter):
    """A task does not know its batch's number, so a stream's items carry the load's name, and the batch is named when it is finished."""

    def __init__(self, options: dict):
        self.options = options
        self.load = options.get("load", "stream")

    def write(self, iterator: Iterator[Row]) -> Sent:
        return send(iterator, self.options, self.load)

    def commit(self, messages: list, batchId: int) -> None:
        client_of(self.options).finish(f"{self.load}/{batchId}", sum(m.count for m in messages if m))

    def abort(self, messages: list, batchId: int) -> None:
        client_of(self.options).abandon(f"{self.load}/{batchId}")


class ItemSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "items"

    def writer(self, schema: StructType, overwrite: bool) -> BatchWriter:
        return BatchWriter(dict(self.options))

    def streamWriter(self, schema: StructType, overwrite: bool) -> StreamWriter:
        return StreamWriter(dict(self.options))
