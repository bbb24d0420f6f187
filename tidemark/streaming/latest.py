"""A table with one row per key, kept by a stream: buckets of keys, and a manifest per version that says where each bucket is.

A batch rewrites the buckets its keys fall into, into folders named after the batch, and then writes a manifest; its row per bucket is the
pointer, moved last. A reader takes the newest complete manifest, so it sees the table before or after a batch and never half of it. A
batch that is repeated reads the version before itself and replaces its own folders. Folders that no manifest in use points to are left for
`superseded`, as a reader may still be on them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.ordering import latest_per_key

MANIFEST = "bucket int, folder string"


class LatestStore:
    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], order: Sequence[Column], schema, buckets: int = 16):
        self.spark, self.path, self.key, self.order, self.schema, self.buckets = spark, path.rstrip("/"), list(key), list(order), schema, buckets

    def versions(self) -> list[int]:
        """Complete manifests, oldest first. A manifest is one file, which its writer moves into place whole."""
        try:
            found = self.spark.read.schema(f"{MANIFEST}, version int").json(f"{self.path}/manifests").select("version").distinct().collect()
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":  # nothing has been written yet
                return []
            raise
        return sorted(r["version"] for r in found)

    def manifest(self, before: int | None = None) -> dict[int, str]:
        """Bucket -> folder, of the newest version or of the newest before another: at most one entry per bucket."""
        versions = [v for v in self.versions() if before is None or v < before]
        if not versions:
            return {}
        rows = self.spark.read.schema(MANIFEST).json(f"{self.path}/manifests/version={versions[-1]}").collect()
        return {r["bucket"]: r["folder"] for r in rows}

    def read(self, manifest: dict[int, str] | None = None) -> DataFrame:
        folders = sorted((self.manifest() if manifest is None else manifest).values())
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def store(self, batch: DataFrame, number: int) -> None:
        """A foreachBatch writer."""
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        newest = latest_per_key(batch, self.key, self.order)
        newest.write.mode("overwrite").parquet(f"{self.path}/arrived/version={number}")
        arrived = self.spark.read.schema(self.schema).parquet(f"{self.path}/arrived/version={number}")
        touched = {r[0] for r in arrived.select(bucket).distinct().collect()}  # at most `buckets` numbers
        before = self.manifest(before=number)
        held = self.read({b: f for b, f in before.items() if b in touched})
        folder = f"{self.path}/data/version={number}"
        latest_per_key(held.unionByName(arrived), self.key, self.order).withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(folder)
        after = {**before, **{b: f"{folder}/bucket={b}" for b in touched}}
        self.spark.createDataFrame(sorted(after.items()), MANIFEST).coalesce(1).write.mode("overwrite").json(f"{self.path}/manifests/version={number}")

    def superseded(self, keep: int = 2) -> list[str]:
        """Folders that the newest `keep` versions do not use: free to remove once no older reader is left."""
        versions = self.versions()
        used = {f for v in versions[-keep:] for f in self.manifest(before=v + 1).values()}
        every = {f for v in versions for f in self.manifest(before=v + 1).values()}
        return sorted(every - used)


def keep_latest(spark: SparkSession, path: str, key: Sequence[str], order: Sequence[Column], schema, buckets: int = 16) -> tuple[LatestStore, Callable[[DataFrame, int], None]]:
    store = LatestStore(spark, path, key, order, schema, buckets)
    return store, store.store
