"""Properties that hold whatever the data is, on the sample tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from martlens.churn import features as X
from martlens.churn import split as S
from martlens.operators import customers as C
from martlens.operators import products as P
from martlens.operators import revenue as R
from martlens.plans.catalog import AS_OF
from martlens.sources.tpch import retail_views


@pytest.fixture(scope="module")
def t(spark, sample_dir):
    return retail_views(spark, sample_dir)


def total(df, column):
    return df.agg(F.sum(column)).first()[0]


def test_shares_add_up(t):
    assert total(P.category_mix(t), "revenue_share_pct") == pytest.approx(100, abs=0.05)
    assert total(R.payment_preference(t), "usage_pct") == pytest.approx(100, abs=0.05)
    assert total(R.order_status_breakdown(t), "pct_of_total") == pytest.approx(100, abs=0.05)


def test_segments_partition_the_buyers(t):
    segments = C.rfm_segments(t, AS_OF)
    buyers = t.orders_with("Delivered").select("customer_id").distinct().count()
    assert segments.count() == segments.select("customer_id").distinct().count() == buyers
    assert segments.where("customer_segment IS NULL").isEmpty()
    sizes = [r["count"] for r in segments.groupBy("m_score").count().orderBy("m_score").collect()]
    assert max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)
    ends = segments.groupBy("m_score").agg(F.min("monetary"), F.max("monetary"))
    bounds = [(r[1], r[2]) for r in ends.orderBy("m_score").collect()]
    assert all(low[1] <= high[0] for low, high in zip(bounds, bounds[1:]))


def test_totals_agree_between_reports(t):
    revenue = R.kpi_summary(t).first().gross_revenue
    for report, column in (
        (R.monthly_revenue_trend(t), "gross_revenue"),
        (R.yearly_revenue(t), "total_revenue"),
        (R.revenue_by_region(t), "revenue"),
        (R.revenue_by_tier(t), "revenue"),
        (R.payment_preference(t), "revenue"),
        (C.clv(t, k=None), "lifetime_value"),
    ):
        assert total(report, column) == pytest.approx(revenue)
    items = total(P.category_mix(t), "revenue")
    assert total(P.product_revenue(t, k=None), "total_revenue") == pytest.approx(items)
    assert total(P.category_month_revenue(t), "revenue") == pytest.approx(items)
    assert total(P.revenue_by_category(t), "revenue") == pytest.approx(items)


def test_item_grain_is_never_below_order_grain(t):
    by_item = X.churn_features(t, AS_OF).select("customer_id", "monetary")
    covered = t.orders.join(t.order_items.select("order_id").distinct(), "order_id")
    once = covered.groupBy("customer_id").agg(F.sum("total_amount").alias("once"))
    both = by_item.join(once, "customer_id")
    assert both.count() == by_item.count() and both.where("monetary < once").isEmpty()


def test_histogram_counts_every_customer(t):
    buyers = C.rfm_base(t, AS_OF).count()
    counts = C.rfm_histogram(t, AS_OF).groupBy("metric").agg(F.sum("count").alias("n")).collect()
    assert {r.n for r in counts} == {buyers} and len(counts) == 3


def test_split_sizes(t):
    matrix = X.feature_matrix(t, AS_OF)
    sides = {(r.churned, r.is_test): r.customers for r in S.stratified_split_counts(matrix).collect()}
    total = sum(sides.values())
    assert sides[0, True] + sides[1, True] == -(-total // 5)
    for label in (0, 1):
        share = (sides[label, True] + sides[label, False]) * -(-total // 5) / total
        assert abs(sides[label, True] - share) < 1
