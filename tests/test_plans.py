"""What the physical plans may and may not contain."""

from __future__ import annotations

import re

import pytest

from martlens import session
from martlens.churn import features, model
from martlens.operators import cube, ordering
from martlens.operators.revenue import (
    kpi_summary,
    monthly_revenue_trend,
    revenue_by_region,
    yearly_revenue,
)
from martlens.plans import catalog
from martlens.session import tune
from martlens.sources.tpch import retail_views

QUERIES = catalog.queries()
FITTED = {
    "rf_train_metrics", "cv_auc", "feature_importance", "churn_predictions",
    "churn_predictions_check", "feature_importance_check", "rf_support", "forest_nodes_check",
}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def without_broadcast(spark):
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = {k: spark.conf.get(k, None) for k in keys}
    for key in keys:
        spark.conf.set(key, "-1")
    yield spark
    for key, value in before.items():
        spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


@pytest.fixture
def written_plans(monkeypatch):
    """Plans of the tables that operators write on the way."""
    plans = []

    def noting(df):
        plans.append(plan_of(df))
        return session.written(df)

    for module in (catalog, features, model, ordering):
        monkeypatch.setattr(module, "written", noting)
    return plans


@pytest.mark.parametrize("name", sorted(set(QUERIES) - FITTED))
def test_no_cross_join_no_python_no_base_rows_in_one_task(
    without_broadcast, sample_dir, written_plans, name
):
    plan = plan_of(QUERIES[name](without_broadcast, sample_dir))
    for each in [plan, *written_plans]:
        _sound(each)


def _sound(plan):
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "Python" not in plan and "Pandas" not in plan
    lines = plan.splitlines()
    for number, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            below = re.sub(r"^[\s:+|*()\d-]*", "", lines[number + 1])
            # Only aggregated rows may meet in one task.
            assert below.startswith(("HashAggregate", "ObjectHashAggregate", "Project"))
            assert any("HashAggregate" in later for later in lines[number : number + 4])


def test_filters_and_columns_reach_the_scan(spark, sample_dir):
    plan = plan_of(QUERIES["shipping_trend"](spark, sample_dir))
    assert "EqualNullSafe(o_orderstatus,F)" in plan
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    columns = {c.split(":")[0] for c in schema.split(",")}
    assert columns == {"o_orderkey", "o_orderstatus", "o_orderdate"}


def test_unused_customer_lookup_is_pruned(spark, sample_dir):
    """Nothing reads the orders a second time for a registration date nobody asked for."""
    plan = plan_of(QUERIES["shipping_by_region"](spark, sample_dir))
    assert len(re.findall(r"Location: [^\n]*orders\.parquet", plan)) == 1


def test_top_k_is_not_a_full_sort(spark, sample_dir):
    for name in ("clv_top20", "top_products", "top_region_kpis"):
        assert "TakeOrderedAndProject" in plan_of(QUERIES[name](spark, sample_dir))


def test_checked_ids_need_no_exchange_of_ids(spark, sample_dir):
    t = retail_views(spark, sample_dir)
    assert t.unique_order_ids
    plan = plan_of(monthly_revenue_trend(t))
    assert plan.count("Exchange hashpartitioning") == 1 and "distinct" not in plan
    for report in (yearly_revenue, kpi_summary, revenue_by_region):
        assert "Expand" not in plan_of(report(t))


def test_churn_features_exchange_orders_and_items_once(without_broadcast, sample_dir):
    plan = plan_of(QUERIES["churn_features"](without_broadcast, sample_dir))
    # Items and orders by order id, then partial sums by customer.
    assert plan.count("Exchange hashpartitioning") == 3


def test_category_mix_counts_orders_on_the_join_partitioning(without_broadcast, sample_dir):
    plan = plan_of(QUERIES["category_mix"](without_broadcast, sample_dir))
    # Two exchanges per join and one of partial sums; none for the distinct count.
    assert plan.count("Exchange hashpartitioning") == 5


def test_product_sales_sum_and_mark_the_items_where_their_orders_join(without_broadcast, sample_dir):
    t = retail_views(without_broadcast, sample_dir)
    plan = plan_of(cube._product_sales(t, t.orders))
    # Two exchanges per join and one of partial sums; none to sum the items of an order.
    assert plan.count("Exchange hashpartitioning") == 5


def test_tasks_read_less_unless_a_size_was_set(spark):
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size, None)
    try:
        spark.conf.unset(size)
        assert tune(spark).conf.get(size) == "16m"
        spark.conf.set(size, "1k")
        assert tune(spark).conf.get(size) == "1k"
    finally:
        spark.conf.set(size, before) if before is not None else spark.conf.unset(size)
