"""Declared schemas and keys of the retail tables."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
FRACTION = T.DecimalType(4, 2)

CUSTOMERS = T.StructType(
    [
        T.StructField("customer_id", T.StringType(), False),
        T.StructField("age", T.IntegerType()),
        T.StructField("gender", T.StringType()),
        T.StructField("region", T.StringType()),
        T.StructField("registration_date", T.DateType()),
        T.StructField("loyalty_tier", T.StringType()),
    ]
)

PRODUCTS = T.StructType(
    [
        T.StructField("product_id", T.StringType(), False),
        T.StructField("product_name", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("base_price", MONEY),
        T.StructField("cost_price", MONEY),
        T.StructField("stock_quantity", T.IntegerType()),
        T.StructField("supplier", T.StringType()),
    ]
)

ORDERS = T.StructType(
    [
        T.StructField("order_id", T.StringType(), False),
        T.StructField("customer_id", T.StringType()),
        T.StructField("order_date", T.DateType()),
        T.StructField("status", T.StringType()),
        T.StructField("payment_method", T.StringType()),
        T.StructField("total_amount", MONEY),
        T.StructField("shipping_days", T.IntegerType()),
    ]
)

ORDER_ITEMS = T.StructType(
    [
        T.StructField("order_item_id", T.StringType(), False),
        T.StructField("order_id", T.StringType()),
        T.StructField("product_id", T.StringType()),
        T.StructField("quantity", T.IntegerType()),
        T.StructField("unit_price", MONEY),
        T.StructField("discount_pct", FRACTION),
        T.StructField("line_total", MONEY),
    ]
)

CHURN_PREDICTIONS = T.StructType(
    [
        T.StructField("customer_id", T.StringType(), False),
        T.StructField("churn_probability", T.DoubleType()),
        T.StructField("predicted_segment", T.StringType()),
    ]
)

BASE_SCHEMAS = {
    "customers": CUSTOMERS,
    "products": PRODUCTS,
    "orders": ORDERS,
    "order_items": ORDER_ITEMS,
}

# Partition column of published orders: the month of the order date as text.
# The part of an order that is dealt over several buckets, and whether it is the
# one that stands for the order.
ORDER_PART, FIRST_PART = "order_part", "first_part"
MONTH_PARTITION = "order_month"

# Declared primary keys, and foreign keys as (child, column, parent).
PRIMARY_KEYS = {
    "customers": ("customer_id",),
    "products": ("product_id",),
    "orders": ("order_id",),
    "order_items": ("order_item_id",),
}
FOREIGN_KEYS = (
    ("orders", "customer_id", "customers"),
    ("order_items", "order_id", "orders"),
    ("order_items", "product_id", "products"),
)
