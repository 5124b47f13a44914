"""Product, category and inventory reports.

Items reach the products either summed per product (one row per product) or
joined on a narrow product projection; the planner broadcasts that projection
when its size allows and otherwise exchanges on the product id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martlens.fixed_values import (
    CRITICAL_STOCK,
    DELIVERED,
    LOW_STOCK,
    STOCK_LABELS,
    TOP_PRODUCTS,
)
from martlens.functions.exprs import (
    first_match,
    half_up,
    money,
    month_start,
    percent,
    ratio,
    year_month,
)
from martlens.sources.tables import RetailTables


# Columns of the wide matrix for orders without a date and for months not asked
# for, and the most month columns it gets without being asked.
NO_MONTH, OTHER_MONTHS = "no_month", "other_months"
MOST_MONTHS = 1200


def items_of_orders(
    t: RetailTables, items: DataFrame, status: str | None, *order_columns: str | Column
) -> DataFrame:
    """Items with the order key joined to the orders of one status; unknown ids drop out."""
    orders = t.orders_by_key(status).select(*t.order_key, *order_columns)
    return items.join(orders, t.order_key)


def _per_product(
    t: RetailTables, status: str | None, *order_columns: Column, by: Sequence[str] = ()
) -> DataFrame:
    """Units and revenue per sold product, before any product column joins."""
    if t.cube is not None and set(by) <= {"_month"}:
        sales = t.cube.product_sales(status).withColumnRenamed("month", "_month")
        return sales.groupBy("product_id", *by).agg(
            F.sum("units").alias("units_sold"), F.sum("revenue").alias("_revenue")
        )
    items = t.items_by_key("product_id", "quantity", "line_total")
    return (
        items_of_orders(t, items, status, *order_columns)
        .groupBy("product_id", *by)
        .agg(F.sum("quantity").alias("units_sold"), F.sum("line_total").alias("_revenue"))
    )


def revenue_by_category(t: RetailTables, status: str | None = DELIVERED) -> DataFrame:
    return (
        _per_product(t, status)
        .join(t.products.select("product_id", "category"), "product_id")
        .groupBy("category")
        .agg(money(F.sum("_revenue")).alias("revenue"))
        .orderBy(F.desc("revenue"), "category")
    )


def product_revenue(
    t: RetailTables,
    k: int | None = TOP_PRODUCTS,
    category: str | None = None,
    status: str | None = DELIVERED,
) -> DataFrame:
    """Units, revenue, profit and margin per product, best sellers first.

    Cost is a product attribute, so items are summed per product before the
    product join: cost times units equals the sum of the line costs.
    """
    products = t.products.select("product_id", "product_name", "category", "cost_price")
    if category is not None:
        products = products.where(F.col("category") == category)
    profit = F.col("_revenue") - F.col("units_sold") * F.col("cost_price")
    ranked = (
        _per_product(t, status)
        .join(products, "product_id")
        .select(
            "product_id",
            "product_name",
            "category",
            "units_sold",
            money(F.col("_revenue")).alias("total_revenue"),
            money(profit).alias("gross_profit"),
            percent(profit, F.col("_revenue")).alias("profit_margin_pct"),
        )
        .orderBy(F.desc_nulls_last("total_revenue"), "product_id")
    )
    return ranked if k is None else ranked.limit(k)


def category_product_detail(t: RetailTables, category: str) -> DataFrame:
    """Every sold product of one category (drill-through from the category)."""
    return product_revenue(t, k=None, category=category)


def category_mix(t: RetailTables, status: str | None = DELIVERED) -> DataFrame:
    """Orders, revenue, revenue share and mean discount per category.

    The order join comes last: its exchange on the order id also serves the
    distinct count of orders.
    """
    categories = t.products.select("product_id", "category")
    if t.cube is not None:
        sales = t.cube.product_sales(status).groupBy("product_id").agg(
            *[F.sum(c).alias(c) for c in ("orders", "revenue", "discount", "discounts")]
        )
        grouped = sales.join(categories, "product_id").groupBy("category").agg(
            F.sum("orders").alias("orders"), F.sum("revenue").alias("_revenue"),
            F.sum("discount").alias("_discount"), F.sum("discounts").alias("_discounts"),
        )
    else:
        items = t.items_by_key("product_id", "line_total", "discount_pct").join(
            categories, "product_id"
        )
        grouped = (
            items_of_orders(t, items, status)
            .groupBy("category")
            .agg(
                F.countDistinct("order_id").alias("orders"),
                F.sum("line_total").alias("_revenue"),
                F.sum("discount_pct").alias("_discount"),
                F.count("discount_pct").alias("_discounts"),
            )
        )
    whole = F.sum("_revenue").over(Window.partitionBy())
    mean_discount = ratio(F.col("_discount"), F.col("_discounts")) * F.lit(100.0)
    return grouped.select(
        "category",
        "orders",
        money(F.col("_revenue")).alias("revenue"),
        percent(F.col("_revenue"), whole).alias("revenue_share_pct"),
        half_up(mean_discount, 2).alias("avg_discount_pct"),
    ).orderBy(F.desc("revenue"), "category")


def category_month_revenue(
    t: RetailTables,
    status: str | None = DELIVERED,
    wide: bool = False,
    months: Sequence[str] | None = None,
) -> DataFrame:
    """Revenue per category and month; ``wide`` turns months into columns.

    Orders without a date count under ``no_month``. Without ``months`` the wide
    form first reads the distinct months that occur and has a column for each;
    more than ``MOST_MONTHS`` of them, as bad dates make, stop it. With
    ``months``, revenue of all others is in ``other_months``, so that a row adds
    up to the category's revenue in any case.
    """
    month = month_start(F.col("order_date")).alias("_month")
    label = year_month(F.col("_month")).alias("month")
    cells = (
        _per_product(t, status, month, by=["_month"])
        .join(t.products.select("product_id", "category"), "product_id")
        .groupBy("category", "_month")
        .agg(money(F.sum("_revenue")).alias("revenue"))
        .select("category", label, "revenue")
    )
    if not wide:
        return cells.orderBy("category", "month")
    cells = cells.withColumn("month", F.coalesce("month", F.lit(NO_MONTH)))
    if months is None:
        if t.cube is not None:
            found = t.cube.sums(["month"], status).select(F.col("month").alias("_month"))
        else:
            found = t.orders_with(status).select(month).distinct()
        found = found.select(label).orderBy("month")
        found = found.select(F.coalesce("month", F.lit(NO_MONTH)).alias("month"))
        months = [row.month for row in found.limit(MOST_MONTHS + 1).collect()]
        if len(months) > MOST_MONTHS:
            raise ValueError(f"more than {MOST_MONTHS} months; pass the wanted ones")
        columns = months
    else:
        columns = [*months, OTHER_MONTHS]
        known = F.col("month").isin(list(months))
        cells = cells.withColumn("month", F.when(known, F.col("month")).otherwise(OTHER_MONTHS))
    return (
        cells.groupBy("category")
        .pivot("month", list(columns))
        .agg(half_up(F.sum("revenue"), 2))
        .orderBy("category")
    )


def category_product_rollup(t: RetailTables, status: str | None = DELIVERED) -> DataFrame:
    """Revenue of everything, per category, and per product within category.

    Items are summed per product first, so the grouping sets repeat product
    rows and never item rows. ``level`` is total, category or product.
    """
    leaves = _per_product(t, status).join(
        t.products.select("product_id", "product_name", "category"), "product_id"
    )
    category, product, name = F.col("category"), F.col("product_id"), F.col("product_name")
    level = (
        F.when(F.grouping("product_id") == 0, "product")
        .when(F.grouping("category") == 0, "category")
        .otherwise("total")
    )
    return (
        leaves.groupingSets(
            [[category, product, name], [category], []], category, product, name
        )
        .agg(level.alias("level"), money(F.sum("_revenue")).alias("revenue"))
        .select("level", "category", "product_id", "product_name", "revenue")
        .orderBy("category", F.desc("revenue"), "product_id")
    )


def avg_discount(t: RetailTables, status: str | None = None) -> DataFrame:
    """Mean discount in percent over all items, or those of one order status."""
    items = t.items_by_key("discount_pct")
    if status is not None:
        items = items_of_orders(t, items, status)
    discount = F.col("discount_pct")
    return items.agg(
        half_up(ratio(F.sum(discount), F.count(discount)) * F.lit(100.0), 2).alias(
            "avg_discount_pct"
        )
    )


def low_stock(
    t: RetailTables,
    low: int = LOW_STOCK,
    critical: int = CRITICAL_STOCK,
    inclusive: bool = True,
) -> DataFrame:
    """Products at or below the stock limit (below it if not ``inclusive``)."""
    stock = F.col("stock_quantity")
    status = first_match(
        [stock == 0, stock <= critical, stock <= low], STOCK_LABELS
    )
    return (
        t.products.where(stock <= low if inclusive else stock < low)
        .select(
            "product_id",
            "product_name",
            "category",
            "stock_quantity",
            status.alias("stock_status"),
        )
        .orderBy("stock_quantity", "product_id")
    )
