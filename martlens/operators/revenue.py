"""Revenue over time, by customer attribute, by payment method and by status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martlens.fixed_values import DELIVERED
from martlens.functions.exprs import (
    half_up,
    mean_money,
    money,
    month_start,
    percent,
    ratio,
    year_month,
    year_start,
    year_text,
)
from martlens.operators.cube import ATTRIBUTES
from martlens.sources.tables import RetailTables


def _sums(
    t: RetailTables, by: Sequence[str], status: str | None, *wanted: Column, customers: bool = False
) -> DataFrame:
    """Sums of orders per ``by``: from the cube if there is one, else those wanted.

    Both name them alike; the keys are ``_month``, ``_year`` or columns of orders.
    """
    dates = {"_month": month_start, "_year": year_start}
    if t.cube is not None:
        found = t.cube.sums([c.removeprefix("_") for c in by], status, customers=customers)
        return found.withColumnsRenamed({c.removeprefix("_"): c for c in by})
    keys = [dates[c](F.col("order_date")).alias(c) if c in dates else c for c in by]
    return t.orders_with(status).groupBy(*keys).agg(*wanted)


def _orders(t: RetailTables) -> Column:
    return t.order_count().alias("_orders")


def _rows() -> Column:
    return F.count(F.lit(1)).alias("_rows")


def _distinct_customers() -> Column:
    return F.countDistinct("customer_id").alias("_customers")


def monthly_revenue_trend(t: RetailTables, status: str | None = DELIVERED) -> DataFrame:
    return (
        _sums(t, ["_month"], status, _orders(t), *_amount_sums())
        .select(
            _month_label(), F.col("_orders").alias("total_orders"),
            *_amounts("gross_revenue", "avg_order_value"),
        )
        .orderBy("month")
    )


def yearly_revenue(t: RetailTables, status: str | None = DELIVERED) -> DataFrame:
    return (
        _sums(
            t, ["_year"], status, F.sum("total_amount").alias("_amount"), _orders(t),
            _distinct_customers(), customers=True,
        )
        .select(
            year_text(F.col("_year")).alias("year"),
            money(F.col("_amount")).alias("total_revenue"),
            F.col("_orders").alias("orders_count"),
            F.col("_customers").alias("unique_customers"),
        )
        .orderBy("year")
    )


def kpi_summary(t: RetailTables, status: str | None = DELIVERED) -> DataFrame:
    return (
        _sums(t, [], status, _distinct_customers(), _orders(t), *_amount_sums(), customers=True)
        .select(
            F.col("_customers").alias("customers"), F.col("_orders").alias("total_orders"),
            *_amounts("gross_revenue", "aov"),
        )
    )


def revenue_by_customer_attribute(
    t: RetailTables, by: Sequence[str], status: str | None = DELIVERED
) -> DataFrame:
    """Orders, buying customers, revenue and average order value per attribute.

    With checked order ids the orders are summed per customer before the join,
    so each customer crosses it once however many orders they placed. Otherwise
    distinct order ids must survive the join, and a customer with a large share
    of the orders is split there by the adaptive skew join.
    """
    if t.cube is not None and set(by) <= set(ATTRIBUTES):
        found = t.cube.sums(by, status, customers=True)
        counts = {"_orders": "orders", "_customers": "customers"}
        return found.withColumnsRenamed(counts).select(
            *by, "orders", "customers", *_amounts("revenue", "aov")
        ).orderBy(F.desc("revenue"), *by)
    orders = t.orders_with(status)
    attributes = t.customers.select("customer_id", *by)
    if t.unique_order_ids:
        grouped = (
            orders.groupBy("customer_id")
            .agg(F.count("order_id").alias("orders"), *_amount_sums())
            .join(attributes, "customer_id")
            .groupBy(*by)
            .agg(
                F.sum("orders").alias("orders"),
                F.count(F.lit(1)).alias("customers"),
                F.sum("_amount").alias("_amount"),
                F.sum("_amounts").alias("_amounts"),
            )
        )
    else:
        grouped = (
            orders.select("order_id", "customer_id", "total_amount")
            .join(attributes, "customer_id")
            .groupBy(*by)
            .agg(
                F.countDistinct("order_id").alias("orders"),
                F.countDistinct("customer_id").alias("customers"),
                *_amount_sums(),
            )
        )
    return grouped.select(*by, "orders", "customers", *_amounts("revenue", "aov")).orderBy(
        F.desc("revenue"), *by
    )


def revenue_by_region(t: RetailTables, status: str | None = DELIVERED) -> DataFrame:
    return revenue_by_customer_attribute(t, ["region"], status)


def revenue_by_tier(t: RetailTables, status: str | None = DELIVERED) -> DataFrame:
    return revenue_by_customer_attribute(t, ["loyalty_tier"], status)


def payment_preference(
    t: RetailTables, status: str | None = DELIVERED, digits: int = 2
) -> DataFrame:
    return (
        _sums(t, ["payment_method"], status, _rows(), *_amount_sums())
        .select(
            "payment_method",
            F.col("_rows").alias("transactions"),
            *_amounts("revenue", "avg_order_value"),
            _share("_rows", digits).alias("usage_pct"),
        )
        .orderBy(F.desc("transactions"), "payment_method")
    )


def order_status_breakdown(t: RetailTables, digits: int = 2) -> DataFrame:
    return (
        _sums(t, ["status"], None, _rows(), *_amount_sums())
        .select(
            "status",
            F.col("_rows").alias("orders"),
            _share("_rows", digits).alias("pct_of_total"),
            mean_money(F.col("_amount"), F.col("_amounts")).alias("avg_order_value"),
        )
        .orderBy(F.desc("orders"), "status")
    )


def status_share(t: RetailTables, digits: int = 1) -> DataFrame:
    return (
        _sums(t, ["status"], None, _rows())
        .select("status", F.col("_rows").alias("count"), _share("_rows", digits).alias("pct"))
        .orderBy("status")
    )


def shipping_by_region(t: RetailTables, status: str | None = DELIVERED) -> DataFrame:
    """Shipping days per region, summed per customer before the join."""
    if t.cube is not None:
        return _shipping(t.cube.sums(["region"], status).where(F.col("_shipped") > 0))
    per_customer = (
        t.orders_with(status)
        .where(F.col("shipping_days").isNotNull())
        .groupBy("customer_id")
        .agg(
            F.sum("shipping_days").alias("days"),
            F.count(F.lit(1)).alias("orders"),
            F.min("shipping_days").alias("min_days"),
            F.max("shipping_days").alias("max_days"),
        )
    )
    return _shipping(
        per_customer.join(t.customers.select("customer_id", "region"), "customer_id")
        .groupBy("region")
        .agg(
            F.sum("days").alias("_days"), F.sum("orders").alias("_shipped"),
            F.min("min_days").alias("_min_days"), F.max("max_days").alias("_max_days"),
        )
    )


def _shipping(per_region: DataFrame) -> DataFrame:
    return per_region.select(
        "region",
        half_up(ratio(F.col("_days"), F.col("_shipped")), 1).alias("avg_shipping_days"),
        F.col("_min_days").alias("min_days"),
        F.col("_max_days").alias("max_days"),
    ).orderBy("avg_shipping_days", "region")


def shipping_trend(t: RetailTables, status: str | None = DELIVERED) -> DataFrame:
    days = F.col("shipping_days")
    return (
        _sums(
            t, ["_month"], status, _rows(), F.sum(days).alias("_days"), F.count(days).alias("_shipped")
        )
        .select(
            _month_label(), F.col("_rows").alias("orders"),
            half_up(ratio(F.col("_days"), F.col("_shipped")), 1).alias("avg_shipping_days"),
        )
        .orderBy("month")
    )


def revenue_mom_growth(
    t: RetailTables, status: str | None = DELIVERED, months_back: int = 1
) -> DataFrame:
    """Revenue growth against the calendar month ``months_back`` earlier.

    The range frame looks at the month number, not at the previous row, so a
    month without sales leaves the growth of the next one null. One row per
    calendar month reaches the window.
    """
    number = F.year("_month") * 12 + F.month("_month")
    earlier = Window.orderBy("_number").rangeBetween(-months_back, -months_back)
    monthly = (
        _sums(t, ["_month"], status, F.sum("total_amount").alias("_amount"))
        .withColumn("_number", number)
        .withColumn("_previous", F.max("_amount").over(earlier))
    )
    growth = percent(F.col("_amount") - F.col("_previous"), F.col("_previous"))
    return monthly.select(
        _month_label(),
        money(F.col("_amount")).alias("revenue"),
        money(F.col("_previous")).alias("previous_revenue"),
        growth.alias("growth_pct"),
    ).orderBy("month")


def _month_label() -> Column:
    return year_month(F.col("_month")).alias("month")


def _amount_sums() -> list[Column]:
    return [
        F.sum("total_amount").alias("_amount"),
        F.count("total_amount").alias("_amounts"),
    ]


def _amounts(total: str, mean: str) -> list[Column]:
    return [
        money(F.col("_amount")).alias(total),
        mean_money(F.col("_amount"), F.col("_amounts")).alias(mean),
    ]


def _share(count: str, digits: int) -> Column:
    """Share of the grand total; the window sees one row per group."""
    total = F.sum(count).over(Window.partitionBy())
    return percent(F.col(count), total, digits)
