"""Session settings and the one way this library cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Local runs use few shuffle partitions; on a cluster leave `shuffle_partitions` to the deployment
# (AQE coalesces what is too many, so a generous number is the safe direction).
def build_session(name: str = "tidemark", master: str | None = None, shuffle_partitions: int | None = None,
                  **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # A skewed join is split even when that costs one more exchange above it.
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder. It comes from `spark.checkpoint.dir`; only a local session may fall
    back to a temporary folder, because executors elsewhere could not read one."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can read")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise `df` reliably, so that reading it twice sees the same partitions even if executors are
    lost in between. Never localCheckpoint: its blocks die with their executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written once as Parquet into the checkpoint folder and read again: for many readers of a few columns each, which a checkpoint
    would give whole rows."""
    folder = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
