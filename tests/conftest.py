import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tidemark-tests", master="local[8]", shuffle_partitions=4, spark__ui__enabled="false",
        spark__driver__memory="8g", spark__checkpoint__dir=tempfile.mkdtemp(prefix="spark-"),
        spark__sql__warehouse__dir=tempfile.mkdtemp(prefix="spark-"),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def lake(spark, tmp_path_factory):
    """A small delivered lake with one planted case per rule, taken through silver once."""
    from tests.lake import write_lake
    from tidemark.operators.gates import QualityGateError
    from tidemark.plans.silver import run_silver

    root = str(tmp_path_factory.mktemp("spark-lake"))
    write_lake(root)
    # so few rows that every planted orphan is above the failing share; tables and reports are written first
    with pytest.raises(QualityGateError, match=r"transactions.product_id"):
        run_silver(spark, root)
    return root


@pytest.fixture(scope="session")
def silver(spark, lake):
    return lambda name: spark.read.parquet(f"{lake}/silver/{name}/")


@pytest.fixture(scope="session")
def reasons(silver):
    """key value -> sorted reasons of one table."""

    def read(name, key):
        rows = silver(name).select(key, "dq_reasons").collect()
        return {r[0]: sorted(r[1]) for r in rows}

    return read
