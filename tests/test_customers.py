from __future__ import annotations

from datetime import date

import numpy as np
import pytest

from martlens.operators import customers as C
from tests.builders import AS_OF, by_key, customer, days_ago, item, order, tables


@pytest.fixture(scope="module")
def edges(spark):
    """One customer per recency edge, plus customers off the delivered path."""
    days = (30, 31, 90, 91, 180, 181, 365, 366)
    people = [customer(f"R{d}", region="East") for d in days]
    orders = [order(f"o{d}", f"R{d}", days_ago(d)) for d in days]
    people += [customer("none", region="West"), customer("open", region="West")]
    orders.append(order("x1", "open", days_ago(400), status="Returned"))
    return tables(spark, people, orders=orders)


def test_recency_scores(edges):
    scores = by_key(C.rfm_segments(edges, AS_OF), "customer_id")
    assert {k: v["r_score"] for k, v in scores.items()} == {
        "R30": 5, "R31": 4, "R90": 4, "R91": 3, "R180": 3, "R181": 2, "R365": 2, "R366": 1,
    }
    assert scores["R31"]["recency_days"] == 31.0


def test_frequency_scores(spark):
    counts = (1, 2, 4, 5, 9, 10, 19, 20)
    orders = [order(f"{n}-{i}", f"F{n}") for n in counts for i in range(n)]
    t = tables(spark, [customer(f"F{n}") for n in counts], orders=orders)
    scores = by_key(C.rfm_segments(t, AS_OF), "customer_id")
    assert {k: v["f_score"] for k, v in scores.items()} == {
        "F1": 1, "F2": 2, "F4": 2, "F5": 3, "F9": 3, "F10": 4, "F19": 4, "F20": 5,
    }


def test_monetary_tiles_and_repeated_order_ids(spark):
    amounts = {"a": "5.00", "b": "5.00", "c": "5.00", "d": "1.00", "e": "9", "f": "8", "g": "7"}
    orders = [order(f"o{k}", k, amount=v) for k, v in amounts.items()]
    t = tables(spark, [customer(k) for k in amounts], orders=orders + [order("oa", "a", amount="0.00")])
    rows = by_key(C.rfm_segments(t, AS_OF), "customer_id")
    assert {k: v["m_score"] for k, v in rows.items()} == {
        "d": 1, "a": 1, "b": 2, "c": 2, "g": 3, "f": 4, "e": 5,
    }
    assert rows["a"]["frequency"] == 1


@pytest.mark.parametrize(
    "days, orders, segment",
    [
        (10, 20, "Champions"),  # 5 + 5 + m
        (60, 10, "Champions"),
        (100, 10, "Loyal Customers"),
        (10, 1, "Potential Loyalists"),
        (400, 20, "Potential Loyalists"),
        (400, 1, "Churned"),
    ],
)
def test_segments(spark, days, orders, segment):
    """With a single tile everyone has m_score 1, so totals follow r and f."""
    rows = [order(f"o{i}", "a", days_ago(days)) for i in range(orders)]
    t = tables(spark, [customer("a")], orders=rows)
    base = C.rfm_segments(t, AS_OF, m_tiles=1, totals=(9, 8, 6)).first()
    assert base.rfm_total == base.r_score + base.f_score + 1
    assert base.customer_segment == segment


def test_recent_and_at_risk_come_after_totals(spark):
    rows = [order("n1", "new", days_ago(31))]
    rows += [order(f"r{i}", "risk", days_ago(400)) for i in range(10)]
    t = tables(spark, [customer("new"), customer("risk")], orders=rows)
    found = by_key(C.rfm_segments(t, AS_OF, totals=(99, 98, 97)), "customer_id")
    assert found["new"]["customer_segment"] == "Recent Customers"
    assert found["risk"]["customer_segment"] == "At Risk"


def test_customers_without_delivery_count_but_are_not_churned(edges):
    rates = by_key(C.churn_by_region_tier(edges, AS_OF), "region")
    assert rates["West"]["total_customers"] == 2
    assert rates["West"]["churned_customers"] == 0
    assert rates["East"]["churned_customers"] == 3
    assert rates["East"]["churn_rate_pct"] == 37.5


def test_regional_rates_round_half_even_and_compare_with_their_mean(spark):
    # 1 of 16 lapsed is 6.25 %, which rounds to the even tenth.
    people = [customer(f"a{i}", region="A") for i in range(16)] + [customer("b", region="B")]
    t = tables(spark, people, orders=[order("o", "a0", days_ago(181))])
    rates = by_key(C.churn_by_region(t, AS_OF), "region")
    assert rates["A"]["churn_rate"] == 6.2
    assert rates["A"]["avg_rate"] == 3.1
    assert rates["A"]["above_avg"] and not rates["B"]["above_avg"]


def test_churned_customers_are_strictly_beyond_the_limit(edges):
    lapsed = [r.customer_id for r in C.churned_customers(edges, AS_OF).collect()]
    assert lapsed == ["R366", "R365", "R181"]


def test_clv_orders_by_rounded_value_then_id(spark):
    orders = [order("1", "b", amount="20"), order("2", "a", amount="20"), order("3", "c", amount="1"),
              order("4", "c", date(2023, 1, 1), amount="2", status="Pending")]
    t = tables(spark, [customer(k) for k in "abc"], orders=orders)
    top = C.clv(t, k=2).collect()
    assert [r.customer_id for r in top] == ["a", "b"]
    full = by_key(C.clv(t, k=None), "customer_id")
    assert full["c"]["lifetime_value"] == 1.0


def test_histogram_equals_numpy(spark):
    rng = np.random.default_rng(3)
    metrics = {
        "spread": np.round(rng.gamma(2.0, 50.0, 700), 2),
        "whole": rng.integers(1, 12, 500).astype(float),
        "constant": np.full(9, 4.0),
        "edges": np.linspace(0.0, 3.0, 31),
    }
    rows = [(m, float(v)) for m, values in metrics.items() for v in values] + [("spread", None)]
    df = spark.createDataFrame(rows, "metric string, value double")
    found = by_key(C.histogram(df, 30), "metric", "bin")
    assert len(found) == 4 * 30
    for metric, values in metrics.items():
        counts, edges = np.histogram(values, bins=30)
        assert [found[metric, b]["count"] for b in range(1, 31)] == counts.tolist()
        np.testing.assert_allclose([found[metric, b]["lo"] for b in range(1, 31)], edges[:-1])
        np.testing.assert_allclose([found[metric, b]["hi"] for b in range(1, 31)], edges[1:])


def test_approximate_medians(edges):
    rows = by_key(C.rfm_medians(edges, AS_OF, exact=False), "metric")
    assert rows["frequency"]["median"] == 1.0


def test_customer_360_filters_by_band(spark):
    t = tables(spark, [customer("a"), customer("b")], orders=[order("1", "a"), order("2", "b")])
    scores = spark.createDataFrame(
        [("a", 0.9, "High Risk")],
        "customer_id string, churn_probability double, predicted_segment string",
    )
    everyone = by_key(C.customer_360(t, AS_OF, scores), "customer_id")
    assert everyone["b"]["predicted_segment"] is None
    high = C.customer_360(t, AS_OF, scores, segment="High Risk").collect()
    assert [r.customer_id for r in high] == ["a"]


def test_purchase_history(spark):
    orders = [order("1", "a", days_ago(9)), order("2", "a", days_ago(1)), order("3", "b")]
    items = [item("i1", "1", quantity=2), item("i2", "1", quantity=3)]
    t = tables(spark, [customer("a"), customer("b")], orders=orders, items=items)
    rows = C.purchase_history(t, ["a"]).collect()
    assert [(r.order_id, r["items"], r.units) for r in rows] == [("2", 0, 0), ("1", 2, 5)]
    chosen = t.customers.where("customer_id = 'b'")
    assert [r.order_id for r in C.purchase_history(t, chosen).collect()] == ["3"]
    assert C.purchase_history(t).count() == 3
