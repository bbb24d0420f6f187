"""Token counts from a digest cache: only contents that the cache does not hold are encoded, once each.

A content's key is the SHA-256 of its normalised text together with the tokenizer's version, itself a digest of the
vocabulary file. Normalisation may only join texts whose counts are equal: for a tokenizer that collapses white space,
runs of blanks become one; for any other, texts stay as they are.

Null texts count as empty, repeated rows are encoded once and each keeps its row, an empty table gives no row, and other
columns of `docs` are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import in_arrow, stored, text_slices
from tidemark.llm.tokens import cut_of, encoder

CACHE_SCHEMA = "digest binary, version string, n_tokens bigint"


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()[:16]


def drops_blanks(path: str) -> bool:
    with open(path, encoding="utf-8") as file:
        return cut_of(json.load(file)) == "blank"


def read_cache(spark, folder: str) -> DataFrame:
    """The stored counts; a folder that does not exist yet is an empty cache."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(folder)


def counted(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    tokens = encoder(path)
    for batch in batches:
        for rows, texts in text_slices(batch, "text"):
            yield pa.RecordBatch.from_arrays([rows.column("digest"), pa.array(tokens.counts(texts))], ["digest", "n_tokens"])


def count_tokens(docs: DataFrame, path: str, cache: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """`id`, `n_bytes` and `n_tokens` of every row; what was missing is appended to the cache folder first.

    Texts are shuffled once, by digest and after equal ones met within a map task, so that copies of one content never
    gather in a task. The counts are joined back by digest without the texts; AQE splits the digest of a much copied one.
    """
    spark, version = docs.sparkSession, tokenizer_version(path)
    content = F.coalesce(F.col(text), F.lit(""))
    normal = F.trim(F.regexp_replace(content, r"[ \t\n\r]+", " ")) if drops_blanks(path) else content
    keyed = docs.select(F.col(id).alias("id"), content.alias("text"), F.unhex(F.sha2(normal, 256)).alias("digest"),
                        F.octet_length(content).cast("bigint").alias("n_bytes"))
    known = read_cache(spark, cache).where(F.col("version") == version)
    misses = keyed.select("digest", "text").dropDuplicates(["digest"]).join(known, "digest", "left_anti")
    (in_arrow(misses, lambda batches: counted(batches, path), "digest binary, n_tokens bigint")
     .select("digest", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(cache))
    # Two writers may have added one digest: the counts are equal. Stored, so that no aggregate stands above the shuffle of the
    # join and AQE can split a much copied digest.
    counts = stored(read_cache(spark, cache).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    return keyed.drop("text").join(counts, "digest").select(F.col("id").alias(id), "n_bytes", "n_tokens")
