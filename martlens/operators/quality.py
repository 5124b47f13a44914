"""Key constraints, the joined star, and the money rules between tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlens.functions.exprs import count_where, line_total, money
from martlens.sources.schemas import FOREIGN_KEYS
from martlens.sources.tables import RetailTables


def repeated_keys(df: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """The key values that occur more than once, with their row counts."""
    return (
        df.dropna("any", subset=list(key))
        .groupBy(*key)
        .agg(F.count(F.lit(1)).alias("rows"))
        .where(F.col("rows") > 1)
    )


def duplicate_keys(t: RetailTables) -> DataFrame:
    """Per table: distinct keys, keys that repeat, surplus rows, null keys.

    Rows are counted per key before they move, so a key held by a third of the
    table costs one row per task.
    """
    reports = []
    for name, frame in t.base().items():
        key = t.primary_keys[name]
        has_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in key])
        counted = frame.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"))
        whole = ~has_null
        repeats = whole & (F.col("rows") > 1)
        reports.append(
            counted.agg(
                F.lit(name).alias("table_name"),
                F.lit(",".join(key)).alias("key_columns"),
                count_where(whole).alias("distinct_keys"),
                count_where(repeats).alias("duplicate_keys"),
                F.coalesce(F.sum(F.when(repeats, F.col("rows") - 1)), F.lit(0)).alias(
                    "surplus_rows"
                ),
                F.coalesce(F.sum(F.when(has_null, F.col("rows"))), F.lit(0)).alias(
                    "null_keys"
                ),
            )
        )
    return reduce(DataFrame.unionByName, reports)


def orphan_keys(t: RetailTables) -> DataFrame:
    """Per foreign key: child rows without a parent, and their distinct keys.

    Child rows are counted per key before the anti join; nulls are no orphans.
    """
    frames = t.base()
    reports = []
    for child, column, parent in FOREIGN_KEYS:
        counted = (
            frames[child]
            .where(F.col(column).isNotNull())
            .groupBy(column)
            .agg(F.count(F.lit(1)).alias("rows"))
        )
        orphans = counted.join(frames[parent].select(column), column, "left_anti")
        reports.append(
            orphans.agg(
                F.lit(child).alias("child_table"),
                F.lit(column).alias("key_column"),
                F.lit(parent).alias("parent_table"),
                F.count(F.lit(1)).alias("orphan_keys"),
                F.coalesce(F.sum("rows"), F.lit(0)).alias("orphan_rows"),
            )
        )
    return reduce(DataFrame.unionByName, reports)


def star_view(t: RetailTables) -> DataFrame:
    """All tables joined at item grain; order columns repeat per item.

    Sum ``line_total`` here, never ``total_amount``: use :func:`order_view` for
    order-grain figures. Customers join the orders, not the far more numerous
    items, and the item join comes last, so that a count of distinct orders can
    use its partitioning.
    """
    items = t.order_items.join(t.products, "product_id")
    return items.join(order_view(t), "order_id")


def order_view(t: RetailTables) -> DataFrame:
    """Orders with their customer and, where known, the churn prediction."""
    view = t.orders.join(t.customers, "customer_id")
    if t.churn_predictions is None:
        return view
    return view.join(t.churn_predictions, "customer_id", "left")


def star_view_counts(t: RetailTables) -> DataFrame:
    """Items, orders and revenue per region and category of the star view."""
    return (
        star_view(t)
        .groupBy("region", "category")
        .agg(
            F.count(F.lit(1)).alias("items"),
            F.countDistinct("order_id").alias("orders"),
            money(F.sum("line_total")).alias("revenue"),
        )
    )


def derived_line_totals(t: RetailTables) -> DataFrame:
    """Line totals recomputed from the catalogue price of each product."""
    prices = t.products.select("product_id", "base_price")
    item_key = t.primary_keys["order_items"]
    keys = [c for c in item_key if c not in ("order_id", "product_id")]
    return t.order_items.join(prices, "product_id").select(
        *keys,
        "order_id",
        "product_id",
        money(F.col("line_total")).alias("line_total"),
        money(
            line_total(F.col("base_price"), F.col("quantity"), F.col("discount_pct"))
        ).alias("derived_total"),
    )


def order_total_reconciliation(t: RetailTables) -> DataFrame:
    """Order header amounts against the sum of their lines, per order."""
    lines = t.order_items.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("line_total").alias("_lines_total")
    )
    total = F.coalesce(F.col("_lines_total"), F.lit(0).cast("decimal(18,2)"))
    return t.orders.join(lines, "order_id", "left").select(
        "order_id",
        F.coalesce(F.col("lines"), F.lit(0)).alias("lines"),
        money(F.col("total_amount")).alias("header_total"),
        money(total).alias("lines_total"),
        money(F.col("total_amount") - total).alias("difference"),
        (F.col("total_amount") == total).alias("matches"),
    )
