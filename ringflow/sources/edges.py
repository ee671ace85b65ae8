"""Edge tables: the CSV dialects and views over order data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordered import lead_over
from ..functions.scalars import cents

TRANSFER_SCHEMA = "src BIGINT, dst BIGINT, amount DECIMAL(20,2)"
WEIGHT_SCHEMA = "src BIGINT, dst BIGINT, weight BIGINT"

#: Priorities of the orders that make thinned graphs, for queries whose results explode with the degree: about four edges a vertex, and about two.
DENSE = ("1-URGENT", "2-HIGH")
SPARSE = ("1-URGENT",)


def read_transfers(spark: SparkSession, path: str) -> DataFrame:
    """src, dst, cents from lines ``src,dst,amount`` without header; malformed lines fail, the last needs no newline."""
    raw = spark.read.schema(TRANSFER_SCHEMA).csv(path, mode="FAILFAST", header=False, ignoreTrailingWhiteSpace=True)
    return raw.select("src", "dst", cents(F.col("amount")).alias("cents"))


def read_topology(spark: SparkSession, path: str) -> DataFrame:
    """src, dst alone; the reader parses no other column."""
    return spark.read.schema(TRANSFER_SCHEMA).csv(path, mode="FAILFAST", header=False).select("src", "dst")


def read_weighted(spark: SparkSession, path: str) -> DataFrame:
    """src, dst, weight with positive weights only."""
    return positive_weights(spark.read.schema(WEIGHT_SCHEMA).csv(path, mode="FAILFAST", header=False, ignoreTrailingWhiteSpace=True))


def positive_weights(edges: DataFrame) -> DataFrame:
    return edges.where("weight > 0")


def order_transfers(spark: SparkSession, sf_dir: str, priorities: tuple[str, ...] = ()) -> DataFrame:
    """src, dst, cents, weight: each order's customer pays the next order's customer; all orders, or those of some priorities."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    led = lead_over(orders, "o_orderkey", "o_custkey", "dst").where("dst IS NOT NULL")
    if priorities:
        led = led.where(F.col("o_orderpriority").isin(*priorities))
    return led.select(
        F.col("o_custkey").alias("src"),
        "dst",
        cents(F.col("o_totalprice")).alias("cents"),
        (1 + F.col("o_orderkey") % 97).cast("bigint").alias("weight"),
    )


def nation_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, n: shipments from a customer's nation to a supplier's, summed before the small tables are joined."""
    read = lambda t, *c: spark.read.parquet(f"{sf_dir}/{t}.parquet").select(*c)
    lines = read("lineitem", "l_orderkey", "l_suppkey").join(read("orders", "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    pairs = lines.groupBy("o_custkey", "l_suppkey").agg(F.count("*").alias("n"))
    to_nation = pairs.join(read("customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(read("supplier", "s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return to_nation.groupBy(F.col("c_nationkey").cast("bigint").alias("src"), F.col("s_nationkey").cast("bigint").alias("dst")).agg(F.sum("n").alias("n"))
