"""A corpus pipeline over `documents`: quality, boilerplate lines, near duplicates, benchmark passages, packing.

Each stage is an operator of tidemark.llm. It works on all that the stage before it kept, is written as Parquet and read again, so a
lost executor costs at most its own stage. All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, line_dedup, near_copies, packing, quality_model, simhash
from tidemark.llm.common import stored, table

LEAST_SCORE = 0.3


def _resized(docs: DataFrame) -> DataFrame:
    """`n_chars` again, for texts that lost something."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model of labels.quality scores at least LEAST_SCORE."""
    model = quality_model.learn(docs, table(spark, sf_dir, "labels"), "quality", max_rows=20_000)
    name = "".join(docs.columns) + "_score"  # no column of theirs
    return quality_model.with_scores(docs, model, keep=tuple(docs.columns), name=name).where(F.col(name) >= LEAST_SCORE).select(*docs.columns)


def boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that more than 5 % of their source's documents hold; no document goes."""
    return _resized(line_dedup.without_boilerplate(docs, "source", "text", max_ratio=0.05, min_pages=5))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: first that of the smallest id of those linked by fingerprints of 5-word shingles that
    differ in at most 2 bits; of those left, none of which the shingles are to 80 % (Jaccard) those of a document that stays."""
    return near_copies.without_near_copies(simhash.one_of_each(docs, radius=2, size=5), percent=80, size=5)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents of which a 20th or more is benchmark windows, and without such passages in the others."""
    return _resized(decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"), window=13, coverage=20))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A slot in a sequence of 2048 tokens for every piece of every document left."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=2048)


STAGES = [
    ("quality_classifier", quality_classifier), ("line_dedup", boilerplate_lines), ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_decontamination), ("packing", best_fit_packing),
]

# Fitted models, hashes and token ids are beyond SQL: the stages are tested against plain forms.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        rows = stored(stage(spark, rows, sf_dir), name)
    return STAGES[-1][1](spark, rows, sf_dir)
