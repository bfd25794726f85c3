"""Readers of the Parquet tables and their binding to the reference's entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review events (user, item, rating, ts) from orders and lineitem; ts is in UTC milliseconds."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_shipdate")
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("user"),
        F.col("l_partkey").alias("item"),
        F.least(F.lit(5), 1 + F.floor((F.col("l_quantity") - 1) / 10)).cast("int").alias("rating"),
        F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("ts"),
    )


#: The same relation for DuckDB.
REVIEWS_SQL = """
reviews AS (
  SELECT o_custkey AS "user", l_partkey AS item,
         CAST(least(5, 1 + floor((l_quantity - 1) / 10)) AS INTEGER) AS rating, epoch_ms(l_shipdate) AS ts
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog rows (item, title, store, category, price, features) from part."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("store"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").alias("price"),
        F.split("p_name", " ").alias("features"),
    )


CATALOG_SQL = """
catalog AS (
  SELECT p_partkey AS item, p_name AS title, p_brand AS store, p_type AS category, p_retailprice AS price,
         string_split(p_name, ' ') AS features FROM part)
"""
