from __future__ import annotations

from decimal import Decimal

import pytest

from martlens.operators import products as P
from tests.builders import by_key, customer, date, item, order, product, tables


@pytest.fixture(scope="module")
def shop(spark):
    return tables(
        spark,
        [customer("a")],
        [
            product("P1", "Books", cost="4.00", stock=0),
            product("P2", "Books", cost="5.00", stock=20),
            product("P3", "Toys", cost="1.00", stock=50),
            product("P4", "Toys", stock=51),
        ],
        [
            order("1", "a", date(2024, 1, 5)),
            order("2", "a", date(2024, 3, 5)),
            order("3", "a", date(2024, 3, 6), status="Returned"),
        ],
        [
            item("i1", "1", "P1", 2, total="20.00", discount="0.10"),
            item("i2", "1", "P2", 1, total="30.00", discount="0.20"),
            item("i3", "2", "P1", 1, total="10.00", discount="0.00"),
            item("i4", "2", "P3", 3, total="0.00", discount="0.30"),
            item("i5", "3", "P2", 9, total="90.00", discount="0.30"),
            item("i6", "missing", "P2", 9, total="90.00"),
        ],
    )


def test_profit_and_margin(shop):
    rows = by_key(P.product_revenue(shop), "product_id")
    assert list(rows) == ["P1", "P2", "P3"]
    assert rows["P1"] | {"units_sold": 3, "total_revenue": 30.0, "gross_profit": 18.0,
                         "profit_margin_pct": 60.0} == rows["P1"]
    assert rows["P3"]["gross_profit"] == -3.0
    assert rows["P3"]["profit_margin_pct"] is None  # no revenue


def test_limit_breaks_ties_by_id(shop):
    assert [r.product_id for r in P.product_revenue(shop, k=1).collect()] == ["P1"]
    assert [r.product_id for r in P.category_product_detail(shop, "Toys").collect()] == ["P3"]


def test_category_mix(shop):
    rows = by_key(P.category_mix(shop), "category")
    assert rows["Books"]["orders"] == 2
    assert rows["Books"]["revenue"] == 60.0
    assert rows["Books"]["revenue_share_pct"] == 100.0
    assert rows["Books"]["avg_discount_pct"] == 10.0
    assert rows["Toys"]["revenue_share_pct"] == 0.0


def test_rollup_levels_add_up(shop):
    rows = P.category_product_rollup(shop).collect()
    by_level = {}
    for row in rows:
        by_level.setdefault(row.level, []).append(row.revenue)
    assert sorted(by_level) == ["category", "product", "total"]
    assert len(by_level["product"]) == 3 and len(by_level["category"]) == 2
    assert all(sum(v) == 60.0 for v in by_level.values())


def test_month_matrix_long_and_wide(shop):
    long = by_key(P.category_month_revenue(shop), "category", "month")
    assert long["Books", "2024-03"]["revenue"] == 10.0
    wide = by_key(P.category_month_revenue(shop, wide=True), "category")
    assert set(wide["Books"]) == {"category", "2024-01", "2024-03"}
    assert wide["Books"]["2024-01"] == 50.0 and wide["Toys"]["2024-01"] is None
    chosen = P.category_month_revenue(shop, wide=True, months=["2024-02"])
    assert chosen.columns == ["category", "2024-02", "other_months"]
    assert by_key(chosen, "category")["Books"]["other_months"] == 60.0


def test_month_matrix_keeps_orders_without_a_date(spark):
    t = tables(
        spark, [customer("a")], [product("P1")],
        [order("1", "a", date(2024, 1, 5)), ("2", "a", None, "Delivered", "UPI", Decimal("9"), 2)],
        [item("i1", "1"), item("i2", "2")],
    )
    wide = P.category_month_revenue(t, wide=True).first().asDict()
    assert wide == {"category": "Books", "2024-01": 10.0, "no_month": 10.0}


def test_discount_over_all_or_one_status(shop):
    assert P.avg_discount(shop).first().avg_discount_pct == 15.0
    assert P.avg_discount(shop, "Delivered").first().avg_discount_pct == 15.0
    assert P.avg_discount(shop, "Returned").first().avg_discount_pct == 30.0


def test_stock_edges(spark):
    stocks = (0, 1, 20, 21, 49, 50, 51)
    t = tables(spark, products=[product(f"P{s:02}", stock=s) for s in stocks])
    rows = [(r.stock_quantity, r.stock_status) for r in P.low_stock(t).collect()]
    assert rows == [
        (0, "OUT OF STOCK"), (1, "CRITICAL"), (20, "CRITICAL"), (21, "LOW"), (49, "LOW"), (50, "LOW"),
    ]
    assert P.low_stock(t, inclusive=False).count() == 5
    assert P.low_stock(t, low=0, critical=0).count() == 1
