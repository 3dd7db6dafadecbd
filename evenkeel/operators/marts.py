"""The transformations that the assets are built with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mart_customers(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Every customer with number and sum of orders, zero for none."""
    per = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    joined = customers.join(per, "c_custkey", "left")
    return joined.select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).cast("long").alias("order_count"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("order_total"))


def mart_order_summary(orders: DataFrame) -> DataFrame:
    return orders.groupBy(F.col("o_orderstatus").alias("status")).agg(
        F.count(F.lit(1)).alias("order_count"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.round(F.avg("o_totalprice"), 4).alias("average")
    )


def mart_product_summary(parts: DataFrame) -> DataFrame:
    return parts.groupBy(F.col("p_type").alias("category")).agg(F.count(F.lit(1)).alias("products"), F.round(F.avg("p_retailprice"), 4).alias("average_price"))


def orders_enriched(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders with their customer's name and segment as one text."""
    named = customers.select("c_custkey", F.concat("c_name", F.lit(" "), "c_mktsegment").alias("customer"))
    return orders.join(named, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", "customer", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("amount"))


def staging_projection(orders: DataFrame) -> DataFrame:
    return orders.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("amount"))
