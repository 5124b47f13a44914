"""The tables behind each visual of the four dashboard pages."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlens.operators import customers as C
from martlens.operators import measures as M
from martlens.operators import products as P
from martlens.operators import revenue as R
from martlens.sources.tables import RetailTables

Visual = Callable[[], DataFrame]


def revenue_by_month(t: RetailTables) -> DataFrame:
    return R.monthly_revenue_trend(t).selectExpr(
        "month", "gross_revenue AS revenue", "total_orders AS orders"
    )


def payment_volume(t: RetailTables) -> DataFrame:
    return R.payment_preference(t).selectExpr(
        "payment_method", "transactions", "avg_order_value AS aov"
    )


def sliced(
    t: RetailTables,
    year: int | None = None,
    region: str | None = None,
    category: str | None = None,
) -> RetailTables:
    """The tables under the page slicers, so that every visual sees the same rows.

    Orders are those of the year and of the region's customers, and with a
    category those with an item of it, each once. Items are those of the
    category. No slicer means no filter and no join.
    """
    customers, orders, items = t.customers, t.orders_of_year(year), t.order_items
    if region is not None:
        customers = customers.where(F.col("region") == region)
        orders = orders.join(customers.select("customer_id"), "customer_id", "left_semi")
    if category is not None:
        products = t.products.where(F.col("category") == category)
        items = items.join(products.select("product_id"), "product_id", "left_semi")
        wanted = items.select("order_id").distinct()
        orders = orders.join(wanted, "order_id", "left_semi")
    return RetailTables(
        customers, lambda: t.products, orders, items, t.churn_predictions,
        lambda _: t.unique_order_ids, t.primary_keys,
    )


def executive_page(
    t: RetailTables,
    as_of: date | str,
    year: int | None = None,
    region: str | None = None,
    category: str | None = None,
) -> dict[str, Visual]:
    """All visuals under the slicers of the page.

    Churn asks for a customer's last order of any kind and date, so of the
    slicers only the region applies to the churn card.
    """
    s = t if year is region is category is None else sliced(t, year, region, category)
    return {
        "kpi_cards": lambda: M.measures(s, M.CORE),
        "churn_card": lambda: M.measures(t, ("churn_rate_pct",), region=region, as_of=as_of),
        "revenue_by_month": lambda: revenue_by_month(s),
        "revenue_by_region": lambda: R.revenue_by_region(s).select("region", "revenue"),
        "orders_by_status": lambda: R.status_share(s),
        "top_region": lambda: M.top_region_kpis(s),
    }


def customer_page(
    t: RetailTables, as_of: date | str, predicted_segment: str | None = None
) -> dict[str, Visual]:
    """The customer table needs the churn predictions among the tables."""
    page = {
        "recency_monetary": lambda: C.rfm_base(t, as_of),
        "revenue_by_tier": lambda: R.revenue_by_tier(t).select("loyalty_tier", "revenue"),
        "churn_by_region": lambda: M.measures(t, M.CHURN, by=["region"], as_of=as_of),
        "churned_customers": lambda: C.churned_customers(t, as_of),
        "purchase_history": lambda: C.purchase_history(t),
    }
    if t.churn_predictions is not None:
        page["customers"] = lambda: C.customer_360(
            t, as_of, t.churn_predictions, predicted_segment
        )
    return page


def product_page(t: RetailTables, category: str | None = None) -> dict[str, Visual]:
    """``category`` drills the product table down to one category."""
    return {
        "revenue_by_category": lambda: P.revenue_by_category(t),
        "category_treemap": lambda: P.category_product_rollup(t),
        "top_products": lambda: P.product_revenue(t),
        "category_by_month": lambda: P.category_month_revenue(t, wide=True),
        "profit_margin": lambda: M.measures(t, M.PROFIT),
        "avg_discount": lambda: P.avg_discount(t),
        "product_detail": lambda: P.product_revenue(t, k=None, category=category),
    }


def operations_page(t: RetailTables) -> dict[str, Visual]:
    return {
        "orders_by_payment": lambda: payment_volume(t),
        "shipping_trend": lambda: R.shipping_trend(t),
        "low_stock": lambda: P.low_stock(t, inclusive=False),
        "status_funnel": lambda: R.order_status_breakdown(t).select("status", "orders"),
    }


def dashboard(
    t: RetailTables,
    as_of: date | str,
    year: int | None = None,
    region: str | None = None,
    category: str | None = None,
    predicted_segment: str | None = None,
    drill_category: str | None = None,
) -> dict[str, dict[str, Visual]]:
    """Every visual by page and name; call one to get its frame.

    ``year``, ``region`` and ``category`` slice the first page,
    ``predicted_segment`` the customer table, ``drill_category`` the products.
    """
    return {
        "executive": executive_page(t, as_of, year, region, category),
        "customers": customer_page(t, as_of, predicted_segment),
        "products": product_page(t, drill_category),
        "operations": operations_page(t),
    }
