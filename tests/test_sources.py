from __future__ import annotations

import re
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from martlens import jobs
from martlens.churn.evaluate import risk_bands
from martlens.churn.features import churn_features
from martlens.operators.measures import measures
from martlens.operators.products import avg_discount, category_mix, product_revenue
from martlens.operators.revenue import (
    monthly_revenue_trend,
    revenue_by_region,
    shipping_by_region,
)
from martlens.plans import catalog
from martlens.sources import readers, sinks
from martlens.sources.schemas import BASE_SCHEMAS
from martlens.sources.tables import RetailTables
from tests.builders import customer, item, order, product, tables


@pytest.fixture
def shop(spark):
    return tables(
        spark,
        [customer("a"), customer("b", gender=None)],
        [product("P1", name='Big, "red" box')],
        [order("1", "a"), order("2", "b", status="Pending"), order("3", "a")],
        [item("i1", "1"), item("i2", "3")],
    )


def same(left, right):
    return sorted(map(str, left.collect())) == sorted(map(str, right.collect()))


def test_csv_round_trip(spark, shop, tmp_path):
    sinks.export_tables_csv(shop, str(tmp_path))
    scores = spark.createDataFrame([("a", 0.71234)], "customer_id string, score double")
    sinks.export_predictions(risk_bands(scores), str(tmp_path / "scores"))
    back = readers.read_csv_tables(spark, str(tmp_path), str(tmp_path / "scores"))
    for name, frame in back.base().items():
        assert frame.schema.simpleString() == BASE_SCHEMAS[name].simpleString()
        assert same(frame, shop.base()[name])
    assert back.churn_predictions.first() == ("a", 0.7123, "High Risk")


def test_csv_header_and_bad_values(spark, tmp_path):
    path = tmp_path / "products.csv"
    lines = [
        "product_id,product_name,category,base_price,cost_price,stock_quantity,supplier",
        "P0001,Toys Product 1,Toys,12.50,6.25,,Supplier_2",
    ]
    path.write_text("\n".join(lines))
    row = readers.read_csv(spark, str(path), BASE_SCHEMAS["products"]).first()
    assert row.stock_quantity is None and str(row.base_price) == "12.50"
    path.write_text("\n".join([*lines, "P2,x,Toys,cheap,1.00,1,S"]))
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ"):
        readers.read_csv(spark, str(path), BASE_SCHEMAS["products"]).collect()


PANDAS_ORDERS = [
    "status,order_id,customer_id,total_amount,order_date,payment_method,shipping_days",
    "Delivered,1,a,10.50,2024-12-01,UPI,3.0",
    "Pending,2,a,7,2024-12-02,UPI,",
]


def test_csv_as_pandas_writes_it(spark, tmp_path):
    """Integers with blanks become floats; columns may stand in another order."""
    path = tmp_path / "orders.csv"
    path.write_text("\n".join(PANDAS_ORDERS))
    first, second = sorted(readers.read_csv(spark, str(path), BASE_SCHEMAS["orders"]).collect())
    assert (first.order_id, first.customer_id, first.shipping_days) == ("1", "a", 3)
    assert second.shipping_days is None and str(second.total_amount) == "7.00"
    shop = tables(spark, [customer("a")])
    for name, frame in shop.base().items():
        if name != "orders":
            sinks.write_csv(frame, str(tmp_path / f"{name}.csv"))
    sinks.publish(readers.read_csv_tables(spark, str(tmp_path)), str(tmp_path / "p"))
    row = shipping_by_region(readers.read_published(spark, str(tmp_path / "p"))).first()
    assert row.region == "North" and 3 in row.asDict().values()


@pytest.mark.parametrize("bad", ["Delivered,3,a,1.00,2024-12-02,UPI,3.5",
                                 "Delivered,3,a,10.567,2024-12-02,UPI,3",
                                 "Delivered,3,a,1.00,2024-13-02,UPI,3"])
def test_csv_values_are_never_changed(spark, tmp_path, bad):
    path = tmp_path / "orders.csv"
    path.write_text("\n".join([*PANDAS_ORDERS, bad]))
    with pytest.raises(Exception, match="MALFORMED"):
        readers.read_csv(spark, str(path), BASE_SCHEMAS["orders"]).collect()


def test_malformed_rows_are_set_aside(spark, shop, tmp_path):
    exports, rejects, folder = (str(tmp_path / n) for n in ("exports", "rejects", "tables"))
    sinks.export_tables_csv(shop, exports)
    more = [
        "order_id,customer_id,order_date,status,payment_method,total_amount,shipping_days",
        "7,a,2024-12-01,Delivered,UPI,10.50,3.0",
        "8,a,2024-13-01,Delivered,UPI,10.567,3",
        "9,a,2024-12-01,Delivered,UPI",
        '10,a,2024-12-01,Delivered,UPI,1.00,3,extra',
    ]
    (tmp_path / "exports" / "orders.csv" / "late.csv").write_text("\n".join(more))
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ"):
        jobs.publish_exports(spark, exports, folder)
    with pytest.raises(ValueError, match="orders: 3 of 7"):
        jobs.publish_exports(spark, exports, folder, rejects, 0.4)
    with pytest.raises(FileNotFoundError):
        readers.read_published(spark, folder)
    back = jobs.publish_exports(spark, exports, folder, rejects, 0.5)
    assert {r.order_id for r in back.orders.collect()} == {"1", "2", "3", "7"}
    assert same(back.customers, shop.customers) and same(back.order_items, shop.order_items)
    found = {r.row: r for r in spark.read.parquet(f"{rejects}/orders").collect()}
    assert more[3] in found and more[4] in found and len(found) == 3
    values = next(r for r in found.values() if r.row.startswith("{"))
    assert values.reasons == ["MALFORMED value of order_date: 2024-13-01", "MALFORMED value of total_amount: 10.567"]
    assert all(r.file.endswith("late.csv") for r in found.values())
    counts = {r.table_name: (r.n_read, r.n_rejected) for r in spark.read.parquet(f"{rejects}/_counts").collect()}
    assert counts == {"customers": (2, 0), "products": (1, 0), "orders": (7, 3), "order_items": (2, 0)}


def test_csv_without_a_column_stops(spark, tmp_path):
    path = tmp_path / "orders.csv"
    path.write_text("order_id,customer\n1,a")
    with pytest.raises(ValueError, match="no column customer_id"):
        readers.read_csv(spark, str(path), BASE_SCHEMAS["orders"])


@pytest.mark.parametrize("where", ["_write_orders", "duplicate_keys", "orphan_keys"])
def test_stopped_publish_leaves_the_old_tables(spark, shop, tmp_path, monkeypatch, where):
    folder = str(tmp_path / "p")

    def stop(*_):
        raise RuntimeError("stopped")

    other = tables(spark, [customer("z")], orders=[order("9", "z")])
    with monkeypatch.context() as patched:
        patched.setattr(sinks, where, stop)
        with pytest.raises(RuntimeError):
            sinks.publish(shop, folder)
        with pytest.raises(FileNotFoundError):
            readers.read_published(spark, folder)
    assert sinks.publish(shop, folder) == 1
    with monkeypatch.context() as patched:
        patched.setattr(sinks, where, stop)
        with pytest.raises(RuntimeError):
            sinks.publish(other, folder)
    back = readers.read_published(spark, folder)
    assert same(back.orders.drop("order_month"), shop.orders)
    assert same(back.customers, shop.customers)


def test_write_that_stops_within_a_table_leaves_the_old_tables(spark, shop, tmp_path):
    folder = str(tmp_path / "p")
    sinks.publish(shop, folder)
    broken = F.when(F.col("order_id") == "2", F.raise_error(F.lit("stopped"))).otherwise(F.col("status"))
    torn = tables(spark, [customer("z")], orders=[order(str(i), "z") for i in range(4)])
    torn = RetailTables(torn.customers, torn.products, torn.orders.withColumn("status", broken),
                        torn.order_items)
    with pytest.raises(Exception, match="stopped"):
        sinks.publish(torn, folder)
    assert same(readers.read_published(spark, folder).customers, shop.customers)


def test_readers_hold_a_version(spark, shop, tmp_path):
    folder = str(tmp_path / "p")
    sinks.publish(shop, folder)
    held = readers.read_published(spark, folder)
    other = tables(spark, [customer("z")], orders=[order("9", "z")])
    assert sinks.publish(other, folder) == 2
    assert same(held.orders.drop("order_month"), shop.orders)
    assert readers.read_published(spark, folder).customers.first().customer_id == "z"
    assert same(readers.read_published(spark, folder, version=1).customers, shop.customers)
    sinks.publish(other, folder)
    with pytest.raises(FileNotFoundError):
        readers.read_published(spark, folder, version=1)
    assert sum(1 for _ in (tmp_path / "p" / "customers").glob("publish=*")) == 2


def test_months_are_replaced_and_others_shared(spark, tmp_path):
    folder = tmp_path / "p"
    days = {"1": date(2024, 1, 3), "2": date(2024, 2, 3), "3": date(2024, 3, 3), "4": None}
    orders = [(key, "a", day, "Delivered", "UPI", Decimal("10.00"), 3) for key, day in days.items()]
    sinks.publish(tables(spark, [customer("a")], orders=orders), str(folder))
    first = readers.read_published(spark, str(folder))
    new = tables(spark, orders=[order("5", "a", date(2024, 2, 9)), order("6", "a", date(2024, 4, 9))])
    sinks.replace_months(first, new.orders, str(folder), emptied=["2024-03"])
    back = readers.read_published(spark, str(folder))
    assert sorted(r.order_id for r in back.orders.collect()) == ["1", "4", "5", "6"]
    assert back.orders.where("order_date IS NULL").count() == 1
    parts = {m.name: sum(1 for _ in m.iterdir()) for m in (folder / "orders").glob("order_month=*")}
    assert parts["order_month=2024-01"] == 1 and parts["order_month=2024-02"] == 2
    again = tables(spark, orders=[order("1", "a", date(2024, 4, 9))])
    sinks.replace_months(back, again.orders, str(folder))
    assert not readers.read_published(spark, str(folder)).unique_order_ids


def test_replaced_files_are_checked_again(spark, sample_dir, tmp_path):
    folder = f"file://{tmp_path}"
    orders = spark.read.parquet(f"{sample_dir}/orders.parquet").limit(50).cache()
    spark.read.parquet(f"{sample_dir}/customer.parquet").write.parquet(f"{folder}/customer.parquet")
    counts = []
    for rows in (orders, orders.union(orders)):
        rows.write.mode("overwrite").parquet(f"{folder}/orders.parquet")
        counts.append(catalog.queries()["kpi_summary"](spark, folder).first().total_orders)
    assert counts[0] == counts[1] > 0


def test_no_job_while_published_reports_are_planned(spark, shop, tmp_path):
    sinks.publish(shop, str(tmp_path / "p"))
    back = readers.read_published(spark, str(tmp_path / "p"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "")
    monthly_revenue_trend(back)
    assert not tracker.getJobIdsForGroup("planning")


def test_publish_checks_keys_and_replaces(spark, shop, tmp_path):
    folder = str(tmp_path / "published")
    sinks.publish(shop, folder)
    sinks.publish(shop, folder)
    back = readers.read_published(spark, folder)
    assert back.unique_order_ids and back.orders.count() == 3
    assert same(monthly_revenue_trend(back), monthly_revenue_trend(shop))
    assert same(revenue_by_region(back), revenue_by_region(shop))
    assert dict(back.orders.dtypes)["order_month"] == "string"


def test_year_slicer_skips_month_partitions(spark, tmp_path):
    orders = [order("1", "a", date(2023, 5, 1)), order("2", "a", date(2024, 5, 1))]
    sinks.publish(tables(spark, [customer("a")], orders=orders), str(tmp_path / "p"))
    back = readers.read_published(spark, str(tmp_path / "p"))
    sliced = measures(back, ["total_orders", "total_revenue"], year=2024)
    assert sliced.first() == (1, 10.0)
    plan = sliced._jdf.queryExecution().executedPlan().toString()
    filters = re.search(r"PartitionFilters: \[([^\]]*)\]", plan).group(1)
    assert "order_month" in filters


def test_published_repeats_are_not_trusted(spark, tmp_path):
    t = tables(spark, [customer("a")], orders=[order("1", "a"), order("1", "a")])
    sinks.publish(t, str(tmp_path / "p"))
    back = readers.read_published(spark, str(tmp_path / "p"))
    assert not back.unique_order_ids
    assert monthly_revenue_trend(back).first().total_orders == 1


def test_bucketed_tables_join_without_exchange(spark, shop):
    spark.sql("CREATE DATABASE IF NOT EXISTS shop")
    sinks.publish_bucketed(shop, "shop", 4)
    sinks.publish_bucketed(shop, "shop", 4)
    back = readers.read_catalog_tables(spark, "shop")
    assert same(back.orders, shop.orders)
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        joined = back.order_items.join(back.orders, "order_id")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        features = churn_features(back, "2024-12-31")
        features_plan = features._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(threshold, before)
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert joined.count() == 2
    # Only the partial sums per customer move.
    assert features_plan.count("Exchange hashpartitioning") == 1
    assert same(features, churn_features(shop, "2024-12-31"))


@pytest.fixture(scope="module")
def crowded(spark):
    """Order 7 holds a third of 6,000 items, a sixth have no order id."""
    owner = lambda i: "7" if i % 3 == 0 else None if i % 6 == 1 else str(10 + i % 900)
    items = [
        item(f"i{i}", owner(i), f"P{i % 5}", 1 + i % 4, total=f"{i % 90}.10", discount=f"0.0{i % 7}")
        for i in range(6_000)
    ]
    orders = [order("7", "a", amount="99.50")] + [
        order(str(i), "ab"[i % 2], date(2024, 1 + i % 12, 3), f"{i}.25",
              ["Delivered", "Returned", "Cancelled"][i % 3])
        for i in range(10, 1_000)
    ]
    books = [product(f"P{i}", category=["Books", "Toys"][i % 2]) for i in range(5)]
    made = tables(spark, [customer("a"), customer("b")], books, orders, items)
    spark.sql("CREATE DATABASE IF NOT EXISTS crowded")
    sinks.publish_bucketed(made, "crowded", 8)
    return made, readers.read_catalog_tables(spark, "crowded")


def test_large_orders_are_dealt_over_buckets(spark, crowded):
    made, back = crowded
    assert same(back.orders, made.orders) and same(back.order_items, made.order_items)
    assert back.unique_order_ids and back.order_key == ["order_id", "order_part"]
    copies = {r[0]: r[1] for r in back.orders_by_key().groupBy("order_id").count().collect()}
    assert copies.pop("7") > 8 and set(copies.values()) == {1}
    assert back.orders_by_key().where("first_part").count() == made.orders.count()
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        joined = back.items_by_key("order_item_id").join(back.orders_by_key(), back.order_key)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        sizes = back.items_by_key("order_item_id").groupBy(F.spark_partition_id()).count()
        read = sorted(r["count"] for r in sizes.collect())
        tasks = joined.groupBy(F.spark_partition_id()).count().collect()
        features = churn_features(back, "2024-12-31")
        moves = features._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(threshold, before)
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert moves.count("Exchange hashpartitioning") == 1
    done = sorted(r["count"] for r in tasks)
    for rows in (read, done):
        assert len(rows) == 8 and rows[-1] < 3 * rows[4]
    assert sum(done) == 5_000


def test_reports_of_dealt_orders(crowded):
    made, back = crowded
    for grain in ("item", "order"):
        one, two = (churn_features(t, "2024-12-31", grain) for t in (back, made))
        assert same(one, two)
    repeated = RetailTables(
        back.customers, back.products, back.orders, back.order_items, dealt=back.dealt
    )
    assert same(churn_features(repeated, "2024-12-31"), churn_features(made, "2024-12-31"))
    for report in (product_revenue, category_mix, avg_discount):
        assert same(report(back), report(made))
    assert same(avg_discount(back, "Delivered"), avg_discount(made, "Delivered"))
