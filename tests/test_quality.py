from __future__ import annotations

from martlens.operators import quality as Q
from tests.builders import by_key, customer, item, order, product, tables


def shop(spark, **options):
    return tables(
        spark,
        [customer("a", "North"), customer("b", "South"), customer("b", "South")],
        [product("P1", "Books", price="10.00")],
        [order("1", "a", amount="30.00"), order("2", "zoe"), order("3", None), order("4", "a")],
        [
            item("i1", "1", "P1", 2, total="18.00", discount="0.10"),
            item("i2", "1", "P1", 1, total="12.00"),
            item("i2", "9", "P1"),
            item("i3", "1", "PX"),
        ],
        **options,
    )


def test_duplicates(spark):
    found = by_key(Q.duplicate_keys(shop(spark)), "table_name")
    assert found["customers"] == {
        "table_name": "customers", "key_columns": "customer_id", "distinct_keys": 2,
        "duplicate_keys": 1, "surplus_rows": 1, "null_keys": 0,
    }
    assert found["order_items"]["duplicate_keys"] == 1
    assert found["orders"]["duplicate_keys"] == 0
    rows = Q.repeated_keys(shop(spark).customers, ("customer_id",)).collect()
    assert [tuple(r) for r in rows] == [("b", 2)]


def test_orphans_leave_nulls_out(spark):
    found = by_key(Q.orphan_keys(shop(spark)), "child_table", "key_column")
    assert found["orders", "customer_id"]["orphan_rows"] == 1
    assert found["order_items", "order_id"]["orphan_keys"] == 1
    assert found["order_items", "product_id"]["orphan_keys"] == 1


def test_reconciliation_and_derived_totals(spark):
    totals = by_key(Q.order_total_reconciliation(shop(spark)), "order_id")
    assert totals["1"]["lines"] == 3 and totals["1"]["difference"] == -10.0
    assert totals["4"]["lines_total"] == 0.0 and not totals["4"]["matches"]
    derived = Q.derived_line_totals(shop(spark)).where("order_item_id = 'i1'").first()
    assert (derived.line_total, derived.derived_total) == (18.0, 18.0)


def test_star_keeps_item_and_order_grain_apart(spark):
    scores = spark.createDataFrame(
        [("a", 0.8, "High Risk")],
        "customer_id string, churn_probability double, predicted_segment string",
    )
    t = shop(spark, churn_predictions=scores)
    assert Q.star_view(t).where("customer_id = 'a'").count() == 2
    orders = Q.order_view(t)
    assert orders.where("predicted_segment = 'High Risk'").count() == 2
    counts = Q.star_view_counts(t).collect()
    assert [tuple(r) for r in counts] == [("North", "Books", 2, 1, 30.0)]
    t.register_views()
    assert spark.sql("SELECT COUNT(*) AS n FROM churn_predictions").first().n == 1
