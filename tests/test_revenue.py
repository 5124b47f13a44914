from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from martlens.functions.exprs import half_even, half_up, line_total
from martlens.operators import measures as M
from martlens.operators import revenue as R
from tests.builders import AS_OF, by_key, customer, item, order, product, tables


def test_growth_needs_the_calendar_month_before(spark):
    t = tables(
        spark,
        [customer("a")],
        orders=[
            order("1", "a", date(2023, 12, 31), "50"),
            order("2", "a", date(2024, 1, 1), "100"),
            order("3", "a", date(2024, 3, 31), "80"),
            order("4", "a", date(2024, 4, 1), "60"),
            order("5", "a", date(2024, 2, 1), "60", status="Pending"),
        ],
    )
    growth = {r.month: r.growth_pct for r in R.revenue_mom_growth(t).collect()}
    assert growth == {"2023-12": None, "2024-01": 100.0, "2024-03": None, "2024-04": -25.0}
    two = {r.month: r.growth_pct for r in R.revenue_mom_growth(t, months_back=2).collect()}
    assert two["2024-03"] == -20.0 and two["2024-04"] is None


def test_rounding(spark):
    df = spark.sql("SELECT stack(3, 0.125D, 1.005D, -0.125D) AS v")
    rows = df.select(half_up(F.col("v"), 2).alias("up"), half_even(F.col("v"), 2).alias("even"))
    assert [tuple(r) for r in rows.collect()] == [(0.13, 0.12), (1.01, 1.0), (-0.13, -0.12)]
    price = F.lit(Decimal("10.05"))
    total = line_total(price, F.lit(1), F.lit(Decimal("0.10")))
    assert spark.range(1).select(total.alias("v")).first().v == Decimal("9.05")


@pytest.fixture(scope="module", params=[False, True], ids=["any ids", "unique ids"])
def shop(spark, request):
    return _shop(spark, unique_order_ids=request.param)


def _shop(spark, **options):
    return tables(
        spark,
        [customer("a", "North", "Gold"), customer("b", "South", "Gold"), customer("c", "South", "Silver")],
        [product("P1", "Books", cost="4.00"), product("P2", "Toys", cost="1.00")],
        [
            order("1", "a", date(2024, 1, 5), "30.00", shipping=2),
            order("2", "a", date(2024, 1, 6), "10.00", shipping=5),
            order("3", "b", date(2023, 5, 1), "20.00", status="Returned"),
            order("4", "b", date(2023, 5, 2), "25.00", pay="Wallet"),
            order("5", "ghost", date(2024, 12, 1), "5.00", status="Cancelled"),
        ],
        [
            item("i1", "1", "P1", 2, total="20.00"),
            item("i2", "1", "P2", 1, total="10.00"),
            item("i3", "2", "P2", 1, total="10.00"),
            item("i4", "3", "P1", 1, total="20.00"),
            item("i5", "4", "P1", 1, total="25.00"),
        ],
        **options,
    )


def test_revenue_by_region_and_year(shop):
    rows = [tuple(r) for r in R.revenue_by_region(shop).collect()]
    assert rows == [("North", 2, 1, 40.0, 20.0), ("South", 1, 1, 25.0, 25.0)]
    assert R.kpi_summary(shop).first() == (2, 3, 65.0, 21.67)
    year = by_key(R.yearly_revenue(shop), "year")
    assert year["2024"] == {
        "year": "2024", "total_revenue": 40.0, "orders_count": 2, "unique_customers": 1
    }


def test_repeated_order_ids_count_once_unless_checked(spark):
    rows = [order("1", "a"), order("1", "a")]
    loose = R.monthly_revenue_trend(tables(spark, [customer("a")], orders=rows)).first()
    assert (loose.total_orders, loose.gross_revenue, loose.avg_order_value) == (1, 20.0, 10.0)


def test_shares(shop):
    status = by_key(R.order_status_breakdown(shop), "status")
    assert status["Delivered"]["pct_of_total"] == 60.0
    assert status["Returned"]["avg_order_value"] == 20.0
    assert by_key(R.status_share(shop), "status")["Cancelled"]["pct"] == 20.0
    pay = R.payment_preference(shop).collect()
    assert [(r.payment_method, r.usage_pct) for r in pay] == [("UPI", 66.67), ("Wallet", 33.33)]


def test_shipping(shop):
    rows = by_key(R.shipping_by_region(shop), "region")
    assert rows["North"] == {
        "region": "North", "avg_shipping_days": 3.5, "min_days": 2, "max_days": 5
    }
    assert by_key(R.shipping_trend(shop), "month")["2024-01"]["avg_shipping_days"] == 3.5


def test_ungrouped_measures(shop):
    names = ("total_revenue", "total_orders", "avg_order_value", "unique_customers",
             "churned_customers", "churn_rate_pct", "gross_profit", "profit_margin_pct",
             "returned_orders", "all_orders", "return_rate_pct")
    row = M.measures(shop, names, as_of=AS_OF).first().asDict()
    assert row == {
        "total_revenue": 65.0, "total_orders": 3, "avg_order_value": 21.67, "unique_customers": 3,
        "churned_customers": 2, "churn_rate_pct": 66.67, "gross_profit": 67.0,
        "profit_margin_pct": 103.08, "returned_orders": 1, "all_orders": 5, "return_rate_pct": 20.0,
    }


def test_grouped_and_sliced_measures(shop):
    by_region = by_key(M.measures(shop, M.CORE + ("gross_profit",), by=["region"]), "region")
    assert by_region["North"]["gross_profit"] == 30.0
    assert by_region["South"]["total_revenue"] == 25.0
    books = M.measures(shop, ("total_revenue", "total_orders", "gross_profit"), category="Books")
    # Order 1 counts once and whole; only its book contributes profit.
    assert books.first() == (55.0, 2, 49.0)
    assert M.measures(shop, ("total_orders",), category="Toys").first() == (2,)
    assert M.measures(shop, ("total_revenue",), year=2023, region="South").first() == (25.0,)
    both = M.measures(shop, M.CORE, by=["region", "year"])
    assert {(r.region, r.year): (r.total_orders, r.unique_customers) for r in both.collect()} == {
        ("North", "2024"): (2, 1), ("South", "2023"): (1, 1),
    }
    months = by_key(M.measures(shop, ("total_revenue",), by=["year", "month"]), "year", "month")
    assert months["2024", "2024-01"]["total_revenue"] == 40.0
    assert months["2024", "2024-12"]["total_revenue"] is None
    churn = by_key(M.measures(shop, M.CHURN, by=["region"], as_of=AS_OF), "region")
    assert churn["South"]["churn_rate_pct"] == 100.0


def test_no_orders_gives_blanks_not_errors(spark):
    row = M.measures(tables(spark), M.CORE + M.PROFIT + ("return_rate_pct",)).first()
    assert row.total_orders == 0 and row.avg_order_value is None
    assert row.profit_margin_pct is None and row.return_rate_pct is None


def test_rejects_what_it_cannot_group(shop):
    with pytest.raises(ValueError):
        M.measures(shop, ("margin",))
    with pytest.raises(ValueError):
        M.measures(shop, M.CORE, by=["category"])
    with pytest.raises(ValueError):
        M.measures(shop, M.CHURN, by=["month"], as_of=AS_OF)
    with pytest.raises(ValueError):
        M.measures(shop, M.CHURN)
    for slicer in ({"year": 2024}, {"category": "Books"}):
        with pytest.raises(ValueError, match="no year and no category"):
            M.measures(shop, M.CHURN, as_of=AS_OF, **slicer)


def test_top_region(shop):
    assert M.top_region_kpis(shop).first().region == "North"
