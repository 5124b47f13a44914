"""Retail views over order-processing Parquet tables.

Columns without a counterpart are derived by fixed arithmetic, so that any
engine reading the same files gets the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martlens.sources.tables import RetailTables, check_order_ids


def retail_views(
    spark: SparkSession,
    folder: str,
    unique_order_ids: bool | Callable[[DataFrame], bool] = check_order_ids,
) -> RetailTables:
    @cache
    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}.parquet")

    return RetailTables(
        customers=lambda: _customers(
            read("customer"), read("nation"), read("region"), read("orders")
        ),
        products=lambda: _products(read("part")),
        orders=lambda: _orders(read("orders")),
        order_items=lambda: _order_items(read("lineitem")),
        unique_order_ids=unique_order_ids,
        primary_keys={
            "customers": ("customer_id",),
            "products": ("product_id",),
            "orders": ("order_id",),
            "order_items": ("order_id", "line_no"),
        },
    )


def _orders(orders: DataFrame) -> DataFrame:
    # Null-safe nested IFs fold under a status filter into a comparison on the
    # source column, which then reaches the Parquet scan.
    return orders.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").cast("date").alias("order_date"),
        F.expr(
            "if(o_orderstatus <=> 'F', 'Delivered', if(o_orderstatus <=> 'O', 'Returned', "
            "if(o_orderkey % 2 = 0, 'Cancelled', 'Pending')))"
        ).alias("status"),
        F.col("o_orderpriority").alias("payment_method"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("total_amount"),
        F.expr("if(o_orderstatus <=> 'F', cast(1 + o_orderkey % 10 as int), null)").alias(
            "shipping_days"
        ),
    )


def _customers(
    customer: DataFrame, nation: DataFrame, region: DataFrame, orders: DataFrame
) -> DataFrame:
    first_orders = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.min("o_orderdate").cast("date").alias("registration_date")
    )
    return (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .join(first_orders, "c_custkey", "left")
        .select(
            F.col("c_custkey").alias("customer_id"),
            (F.lit(18) + F.col("c_custkey") % 48).cast("int").alias("age"),
            F.expr(
                "if(c_custkey % 3 = 0, 'Male', if(c_custkey % 3 = 1, 'Female', 'Other'))"
            ).alias("gender"),
            F.col("r_name").alias("region"),
            "registration_date",
            F.col("c_mktsegment").alias("loyalty_tier"),
        )
    )


def _products(part: DataFrame) -> DataFrame:
    price = F.col("p_retailprice").cast("decimal(18,2)")
    return part.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        price.alias("base_price"),
        F.round(price * F.lit(0.55).cast("decimal(4,2)"), 2)
        .cast("decimal(18,2)")
        .alias("cost_price"),
        (F.col("p_partkey") * 37 % 501).cast("int").alias("stock_quantity"),
        F.concat(F.lit("Supplier_"), (F.col("p_partkey") % 20 + 1).cast("string")).alias(
            "supplier"
        ),
    )


def _order_items(lineitem: DataFrame) -> DataFrame:
    gross = F.col("l_extendedprice").cast("decimal(18,2)")
    discount = F.col("l_discount").cast("decimal(4,2)")
    return lineitem.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.try_divide(F.col("l_extendedprice"), F.col("l_quantity"))
        .cast("decimal(18,2)")
        .alias("unit_price"),
        discount.alias("discount_pct"),
        F.round(gross * (F.lit(1) - discount), 2).cast("decimal(18,2)").alias("line_total"),
    )
