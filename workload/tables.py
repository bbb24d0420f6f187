"""The driver's tables as one configuration of the engine, and small readers for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config.model import Catalog, Reference, table

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")

LINEITEM = table(
    "lineitem", "l_orderkey l_linenumber",
    "l_orderkey:long! l_partkey:long! l_suppkey:long! l_linenumber:int! l_quantity:double! l_extendedprice:double! "
    "l_discount:double l_tax:double l_returnflag l_linestatus l_shipdate:timestamp_ntz!",
    allowed={"l_returnflag": ("A", "N"), "l_linestatus": ("O", "F")},
    ranges={"l_quantity": (1, 45), "l_discount": (0, 0.08), "l_extendedprice": (1000, None)},
    event_time="l_shipdate",
    references=(Reference("l_orderkey", "orders", "o_orderkey"), Reference("l_partkey", "part", "p_partkey"),
                Reference("l_suppkey", "supplier", "s_suppkey", optional=True)),
    updated_by="l_shipdate",
)
ORDERS = table(
    "orders", "o_orderkey",
    "o_orderkey:long! o_custkey:long! o_orderstatus! o_totalprice:double! o_orderdate:timestamp_ntz! o_orderpriority!",
    allowed={"o_orderpriority": PRIORITIES[:4]}, ranges={"o_totalprice": (1000, 450000)}, event_time="o_orderdate",
    references=(Reference("o_custkey", "customer", "c_custkey"),),
)
CUSTOMER = table(
    "customer", "c_custkey", "c_custkey:long! c_name! c_nationkey:int! c_acctbal:double! c_mktsegment!",
    unique=("c_acctbal",), allowed={"c_mktsegment": ("BUILDING", "MACHINERY", "HOUSEHOLD")},
    ranges={"c_acctbal": (0, None)},
    references=(Reference("c_nationkey", "nation", "n_nationkey"),),
)
PART = table(
    "part", "p_partkey", "p_partkey:long! p_name! p_brand! p_type! p_size:int! p_retailprice:double!",
    unique=("p_name",), allowed={"p_type": ("ECONOMY", "SMALL", "PROMO")}, ranges={"p_size": (1, 40)},
)
SUPPLIER = table(
    "supplier", "s_suppkey", "s_suppkey:long! s_name! s_nationkey:int! s_acctbal:double!",
    unique=("s_name",), ranges={"s_acctbal": (0, 9000)},
    references=(Reference("s_nationkey", "nation", "n_nationkey", known_broken="kept as an example of an unusable key"),),
)
NATION = table("nation", "n_nationkey", "n_nationkey:int! n_name! n_regionkey:int!",
               references=(Reference("n_regionkey", "region", "r_regionkey"),))
REGION = table("region", "r_regionkey", "r_regionkey:int! r_name!")
DOCUMENTS = table("documents", "doc_id", "doc_id:long! text! lang! source! n_chars:long")
LABELS = table("labels", "doc_id", "doc_id:long! quality:int! toxic:int!",
               references=(Reference("doc_id", "documents", "doc_id"),))

CATALOG = Catalog(
    tables={t.name: t for t in (REGION, NATION, CUSTOMER, SUPPLIER, PART, ORDERS, LINEITEM, DOCUMENTS, LABELS)},
    start="1995-06-01", end="2001-06-01",
)


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def reader(spark: SparkSession, sf_dir: str):
    return lambda name: read(spark, sf_dir, name)


def day(column: str):
    return F.to_date(F.col(column))
