"""Business measures with optional grouping columns and slicers.

Order measures are one aggregate over orders, to which the profit of sliced or
grouped items is joined per order. Churn and the overall profit have grains of
their own; those parts are stacked by name and collapsed per group, so that no
join of aggregates is needed, grouped or not.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlens.fixed_values import CHURN_DAYS, DELIVERED, RETURNED
from martlens.functions.exprs import (
    count_where,
    days_before,
    mean_money,
    money,
    month_start,
    percent,
    sum_if,
    year_month,
    year_start,
    year_text,
)
from martlens.operators.cube import KEYS
from martlens.sources.tables import RetailTables

CORE = ("total_revenue", "total_orders", "avg_order_value", "unique_customers")
CHURN = ("churned_customers", "unique_customers", "churn_rate_pct")
PROFIT = ("gross_profit", "total_revenue", "profit_margin_pct")
RETURNS = ("returned_orders", "all_orders", "return_rate_pct")

_CUSTOMER_COLUMNS = ("age", "gender", "region", "registration_date", "loyalty_tier")
_ORDER_COLUMNS = {
    "status": lambda: F.col("status"),
    "payment_method": lambda: F.col("payment_method"),
    "month": lambda: month_start(F.col("order_date")),
    "year": lambda: year_start(F.col("order_date")),
}
_LABELS = {"month": year_month, "year": year_text}
_CHURN_ONLY = {"churned_customers", "churn_rate_pct"}
_PROFIT_ONLY = {"gross_profit", "profit_margin_pct"}


def measures(
    t: RetailTables,
    names: Sequence[str],
    by: Sequence[str] = (),
    year: int | None = None,
    region: str | None = None,
    category: str | None = None,
    as_of: date | str | None = None,
    days: int = CHURN_DAYS,
) -> DataFrame:
    """The named measures, per ``by`` and under the slicers.

    Revenue and orders cover delivered orders; customers, profit and returns
    cover all statuses, so the margin mixes both, as published. A category
    slicer keeps the orders with an item of that category, each counted once,
    and only the profit of those items. Churn looks at the last order of any
    kind and date; it can be grouped by customer columns and sliced by region
    only. A year or category slicer would compare churned customers of all years
    with the customers of one, so it stops with an error.
    """
    wanted = set(names)
    known = {*CORE, *CHURN, *PROFIT, *RETURNS}
    if wanted - known:
        raise ValueError(f"unknown measures: {sorted(wanted - known)}")
    unknown = [c for c in by if c not in _CUSTOMER_COLUMNS and c not in _ORDER_COLUMNS]
    if unknown:
        raise ValueError(f"cannot group by {unknown}")

    if wanted & _CHURN_ONLY and (year is not None or category is not None):
        raise ValueError("churn measures take no year and no category")

    sliced = bool(by) or year is not None or region is not None or category is not None
    profit = bool(wanted & _PROFIT_ONLY)
    # The churn part knows the customers unless orders are sliced themselves.
    own_customers = (
        bool(wanted & _CHURN_ONLY) and wanted <= set(CHURN) and year is None and category is None
    )
    from_orders = wanted - {"churned_customers", "gross_profit"} and not own_customers
    parts = []
    from_cube = (
        t.cube is not None and category is None and not (sliced and profit) and set(by) <= set(KEYS)
    )
    if from_orders and from_cube:
        parts.append(_cube_part(t, by, year, region, "unique_customers" in wanted))
    elif from_orders or (sliced and profit):
        orders = _orders_of_year(t, by, year)
        if sliced and profit:
            how = "left" if category is None else "inner"
            orders = orders.join(_profit_per_order(t, category), "order_id", how)
        elif category is not None:
            # Distinct first: an order with very many items sends one id per task.
            wanted_ids = _items(t, category).select("order_id").distinct()
            orders = orders.join(wanted_ids, "order_id", "left_semi")
        parts.append(_order_part(t, orders, by, region))
    if profit and not sliced:
        parts.append(_whole_profit(t))
    if wanted & _CHURN_ONLY:
        if as_of is None:
            raise ValueError("churn measures need as_of")
        churn = _churn_part(t, by, region, as_of, days)
        parts.append(churn if own_customers else churn.drop("_customers"))

    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    columns = [c for c in stacked.columns if c not in by]
    collapsed = stacked.groupBy(*by).agg(*[F.max(c).alias(c) for c in columns])
    keys = [_LABELS[c](F.col(c)).alias(c) if c in _LABELS else F.col(c) for c in by]
    return collapsed.select(*keys, *[_formula(name).alias(name) for name in names])


def _formula(name: str) -> Column:
    revenue, profit = F.col("_revenue"), F.col("_profit")
    return {
        "total_revenue": lambda: money(revenue),
        "total_orders": lambda: _or_zero("_orders"),
        "avg_order_value": lambda: mean_money(revenue, F.col("_orders")),
        "unique_customers": lambda: _or_zero("_customers"),
        "returned_orders": lambda: _or_zero("_returned"),
        "all_orders": lambda: _or_zero("_rows"),
        "return_rate_pct": lambda: percent(F.col("_returned"), F.col("_rows")),
        "gross_profit": lambda: money(profit),
        "profit_margin_pct": lambda: percent(profit, revenue),
        "churned_customers": lambda: _or_zero("_churned"),
        "churn_rate_pct": lambda: percent(F.col("_churned"), F.col("_customers")),
    }[name]()


def _or_zero(count: str) -> Column:
    return F.coalesce(F.col(count), F.lit(0))


def _items(t: RetailTables, category: str | None) -> DataFrame:
    """Items with the cost of their product, of one category if given."""
    products = t.products
    if category is not None:
        products = products.where(F.col("category") == category)
    return t.order_items.join(products.select("product_id", "cost_price"), "product_id")


def _profit_per_order(t: RetailTables, category: str | None) -> DataFrame:
    """One row per order, so the profit can ride along with the order measures."""
    profit = F.col("line_total") - F.col("quantity") * F.col("cost_price")
    return _items(t, category).groupBy("order_id").agg(F.sum(profit).alias("_profit"))


def _whole_profit(t: RetailTables) -> DataFrame:
    """Profit of all items, summed per product before the product join."""
    per_product = t.order_items.groupBy("product_id").agg(
        F.sum("line_total").alias("_lines"), F.sum("quantity").alias("_units")
    )
    costs = t.products.select("product_id", "cost_price")
    profit = F.col("_lines") - F.col("_units") * F.col("cost_price")
    return per_product.join(costs, "product_id").agg(F.sum(profit).alias("_profit"))


def _orders_of_year(t: RetailTables, by: Sequence[str], year: int | None) -> DataFrame:
    order_columns = [c for c in by if c in _ORDER_COLUMNS]
    return t.orders_of_year(year).withColumns({c: _ORDER_COLUMNS[c]() for c in order_columns})


def _order_part(
    t: RetailTables, orders: DataFrame, by: Sequence[str], region: str | None
) -> DataFrame:
    attributes = [c for c in by if c in _CUSTOMER_COLUMNS]
    customers = F.countDistinct("customer_id").alias("_customers")
    if not attributes and region is None:
        return orders.groupBy(*by).agg(*_order_sums(t, orders), customers)

    chosen = t.customers
    if region is not None:
        chosen = chosen.where(F.col("region") == region)
    chosen = chosen.select("customer_id", *attributes)
    if not t.unique_order_ids:
        # Distinct order ids have to survive the join.
        joined = orders.join(chosen, "customer_id")
        return joined.groupBy(*by).agg(*_order_sums(t, joined), customers)
    # Summed per customer first, so that each one crosses the join once.
    order_columns = [c for c in by if c in _ORDER_COLUMNS]
    per_customer = orders.groupBy("customer_id", *order_columns).agg(*_order_sums(t, orders))
    sums = [c for c in per_customer.columns if c not in ("customer_id", *order_columns)]
    return (
        per_customer.join(chosen, "customer_id")
        .groupBy(*by)
        .agg(*[F.sum(c).alias(c) for c in sums], customers)
    )


def _cube_part(
    t: RetailTables, by: Sequence[str], year: int | None, region: str | None, customers: bool
) -> DataFrame:
    names = {"_revenue": "_revenue", "_delivered": "_orders", "_returned": "_returned", "_rows": "_rows"}
    if customers:
        names["_customers"] = "_customers"
    found = t.cube.sums(by, None, year, region, customers)
    return found.select(*by, *[F.col(c).alias(name) for c, name in names.items()])


def _order_sums(t: RetailTables, orders: DataFrame) -> list[Column]:
    delivered = F.col("status") == DELIVERED
    sums = [
        sum_if(delivered, F.col("total_amount")).alias("_revenue"),
        t.order_count(F.when(delivered, F.col("order_id"))).alias("_orders"),
        count_where(F.col("status") == RETURNED).alias("_returned"),
        F.count(F.lit(1)).alias("_rows"),
    ]
    if "_profit" in orders.columns:
        sums.append(F.sum("_profit").alias("_profit"))
    return sums


def _churn_part(
    t: RetailTables, by: Sequence[str], region: str | None, as_of: date | str, days: int
) -> DataFrame:
    other = [c for c in by if c not in _CUSTOMER_COLUMNS]
    if other:
        raise ValueError(f"churn measures cannot be grouped by {other}")
    if t.cube is not None:
        last = t.cube.per_customer().select("customer_id", F.col("last_order").alias("_last"))
    else:
        last = t.orders.groupBy("customer_id").agg(F.max("order_date").alias("_last"))
    if by or region is not None:
        customers = t.customers
        if region is not None:
            customers = customers.where(F.col("region") == region)
        last = last.join(customers.select("customer_id", *by), "customer_id")
    known = F.col("customer_id").isNotNull()
    lapsed = days_before(as_of, F.col("_last")) > days
    return last.groupBy(*by).agg(
        count_where(known).alias("_customers"), count_where(known & lapsed).alias("_churned")
    )


def top_region_kpis(t: RetailTables) -> DataFrame:
    """Key figures of the region with the highest delivered revenue.

    The figures of all regions are a handful of rows, so the best one is picked
    from them instead of being joined back to the orders.
    """
    per_region = measures(t, CORE + ("return_rate_pct",), by=["region"])
    return per_region.orderBy(F.desc_nulls_last("total_revenue"), "region").limit(1)
