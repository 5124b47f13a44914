"""Reports from partial sums against the same reports from the orders."""

from __future__ import annotations

import random
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from martlens.operators import cube, customers, dashboard, measures, products, revenue
from martlens.sources import readers, sinks, snapshots
from martlens.sources.tables import check_order_ids
from tests.builders import AS_OF, customer, item, order, product, tables

REPORTS = {
    "trend": revenue.monthly_revenue_trend,
    "trend_all": lambda t: revenue.monthly_revenue_trend(t, None),
    "yearly": revenue.yearly_revenue,
    "yearly_all": lambda t: revenue.yearly_revenue(t, None),
    "kpi": revenue.kpi_summary,
    "kpi_none": lambda t: revenue.kpi_summary(t, "no such status"),
    "by_region": revenue.revenue_by_region,
    "by_tier": revenue.revenue_by_tier,
    "by_both": lambda t: revenue.revenue_by_customer_attribute(t, ["region", "loyalty_tier"], None),
    "by_gender": lambda t: revenue.revenue_by_customer_attribute(t, ["gender"]),
    "payment": revenue.payment_preference,
    "breakdown": revenue.order_status_breakdown,
    "share": revenue.status_share,
    "shipping": revenue.shipping_by_region,
    "shipping_trend": revenue.shipping_trend,
    "growth": revenue.revenue_mom_growth,
    "core": lambda t: measures.measures(t, measures.CORE),
    "core_sliced": lambda t: measures.measures(
        t, measures.CORE + measures.RETURNS, by=["region", "month"], year=2024, region="North"
    ),
    "core_by_year": lambda t: measures.measures(t, measures.CORE, by=["year", "status"]),
    "core_category": lambda t: measures.measures(t, measures.CORE, category="Books"),
    "profit": lambda t: measures.measures(t, measures.PROFIT),
    "profit_by": lambda t: measures.measures(t, measures.PROFIT, by=["region"]),
    "churn": lambda t: measures.measures(t, measures.CHURN, as_of=AS_OF),
    "churn_by": lambda t: measures.measures(t, measures.CHURN, by=["region"], as_of=AS_OF),
    "by_age": lambda t: measures.measures(t, measures.CORE, by=["age"]),
    "top_region": measures.top_region_kpis,
    "clv": lambda t: customers.clv(t, None),
    "rfm": lambda t: customers.rfm_base(t, AS_OF),
    "churned": lambda t: customers.churned_customers(t, AS_OF),
    "churn_rates": lambda t: customers.churn_by_region_tier(t, AS_OF),
    "mix": products.category_mix,
    "mix_all": lambda t: products.category_mix(t, None),
    "products": lambda t: products.product_revenue(t, None),
    "months": products.category_month_revenue,
    "wide": lambda t: products.category_month_revenue(t, wide=True),
    "rollup": products.category_product_rollup,
    "volume": dashboard.payment_volume,
}


def rows(df):
    return df.columns, sorted(map(str, df.collect()))


def shop_rows(seed=7, n=500):
    """Null dates, statuses, methods, customers and attributes; strangers; a hot order."""
    rng = random.Random(seed)
    people = [
        customer(f"C{i}", rng.choice(["North", "South", None]), rng.choice(["Gold", None]), age=i % 5)
        for i in range(40)
    ]
    goods = [product(f"P{i}", rng.choice(["Books", "Toys", None])) for i in range(9)]
    orders, items = [], []
    for i in range(n):
        who = rng.choice([None, f"X{rng.randrange(5)}", *[f"C{rng.randrange(30)}"] * 12])
        day = rng.choice([None, *[date(2023, 10, 1) + timedelta(days=rng.randrange(400))] * 15])
        status = rng.choice(["Delivered", "Delivered", "Returned", "Pending", None])
        amount = rng.choice([None, *[Decimal(rng.randrange(100, 99_999)) / 100] * 9])
        days = rng.choice([None, 1, 2, 3, 8])
        orders.append((f"O{i}", who, day, status, rng.choice(["UPI", "Card", None]), amount, days))
        for j in range(rng.choice([0, 1, 2, 4, 60 if i == 5 else 3])):
            items.append(item(f"I{i}-{j}", f"O{i}", f"P{rng.randrange(11)}", rng.randrange(1, 4), "12.34", "0.10"))
    items.append(item("lost", "no such order"))
    return people, goods, orders, items


@pytest.fixture(scope="module")
def plain(spark):
    return tables(spark, *shop_rows(), unique_order_ids=True)


@pytest.fixture(scope="module")
def built(plain):
    return plain.with_cube(cube.build(plain))


@pytest.mark.parametrize("name", REPORTS)
def test_reports_agree(plain, built, name):
    assert rows(REPORTS[name](built)) == rows(REPORTS[name](plain))


def test_an_empty_shop(spark):
    nothing = tables(spark, unique_order_ids=True)
    summed = nothing.with_cube(cube.build(nothing))
    for name in ("kpi", "trend", "by_region", "core", "mix", "clv"):
        assert rows(REPORTS[name](summed)) == rows(REPORTS[name](nothing))


def test_repeated_order_ids_are_refused(spark):
    t = tables(spark, [customer("a")], orders=[order("1", "a")] * 2, unique_order_ids=check_order_ids)
    with pytest.raises(ValueError, match="repeat"):
        t.with_cube(cube.build(t))


def test_distinct_customers_roll_up_without_distinct(plain, built):
    by_region = plain.orders.join(plain.customers, "customer_id")
    found = {(r.level, r.period, r.region): r.customers for r in built.cube.customer_rollup().collect()}
    for level, period in (("month", F.trunc("order_date", "month")), ("year", F.trunc("order_date", "year"))):
        direct = by_region.groupBy(period.alias("p"), "region").agg(F.countDistinct("customer_id").alias("n"))
        for row in direct.where("p IS NOT NULL").collect():
            assert found[level, row.p, row.region] == row.n
    assert found["total", None, None] == by_region.select("customer_id").distinct().count()
    plan = built.cube.customer_rollup()._jdf.queryExecution().executedPlan().toString()
    assert "bitmap_or_agg" in plan and "distinct" not in plan.lower()


def test_customers_beyond_one_block(spark, monkeypatch):
    """Numbers that start just below the end of a block."""
    numbered = cube._dictionary
    monkeypatch.setattr(cube, "_dictionary", lambda people, _: numbered(people, 32_768 - 10))
    t = tables(spark, *shop_rows(), unique_order_ids=True)
    summed = t.with_cube(cube.build(t))
    assert summed.cube.cells.select("block").distinct().where("block > 0").count() == 2
    for name in ("by_region", "yearly_all", "core"):
        assert rows(REPORTS[name](summed)) == rows(REPORTS[name](t))


@pytest.fixture
def read_months(monkeypatch):
    """Months whose files were read each time orders were summed."""
    read, summed = [], cube._customer_months

    def noting(orders):
        files = orders.select(F.input_file_name().alias("f")).distinct().collect()
        read.append({f.f.split("order_month=")[1].split("/")[0] for f in files})
        return summed(orders)

    monkeypatch.setattr(cube, "_customer_months", noting)
    return read


def equal_to_built(spark, published, folder):
    t = readers.read_published(spark, published)
    kept, fresh = t.with_cube(cube.read(spark, folder)), t.with_cube(cube.build(t))
    for name in ("trend_all", "yearly_all", "by_region", "core", "core_sliced", "shipping", "clv", "mix_all", "wide"):
        assert rows(REPORTS[name](kept)) == rows(REPORTS[name](fresh)) == rows(REPORTS[name](t)), name


def test_only_changed_months_are_summed_again(spark, plain, tmp_path, read_months):
    published, folder = str(tmp_path / "p"), str(tmp_path / "cube")
    sinks.publish(plain, published)
    months = cube.refresh(spark, published, folder)
    assert len(months) > 12 and snapshots.NO_VALUE in months
    assert cube.refresh(spark, published, folder) == [] and len(read_months) == 1
    equal_to_built(spark, published, folder)

    # One month gets other orders, among them one of a customer nobody knows.
    new = tables(spark, orders=[
        order("N1", "C35", date(2024, 2, 3), "77.00"), order("N2", "stranger", date(2024, 2, 5), "5.00")
    ])
    sinks.replace_months(readers.read_published(spark, published), new.orders, published)
    read_months.clear()
    assert cube.refresh(spark, published, folder) == ["2024-02"]
    assert read_months == [{"2024-02"}]
    equal_to_built(spark, published, folder)

    # A month goes, no other is read.
    t = readers.read_published(spark, published)
    sinks.replace_months(t, new.orders.limit(0), published, emptied=["2024-03"])
    read_months.clear()
    assert cube.refresh(spark, published, folder) == []
    assert read_months == [set()]
    equal_to_built(spark, published, folder)

    # Other customers: every sum may belong to another region.
    people, goods, orders, items = shop_rows(seed=8)
    sinks.publish(tables(spark, people, goods, orders, items), published)
    assert len(cube.refresh(spark, published, folder)) > 12
    equal_to_built(spark, published, folder)


def test_stopped_refresh_leaves_the_old_sums(spark, plain, tmp_path, monkeypatch):
    published, folder = str(tmp_path / "p"), str(tmp_path / "cube")
    sinks.publish(plain, published)
    cube.refresh(spark, published, folder)
    before = rows(cube.cell_sums(cube.read(spark, folder)))
    new = tables(spark, orders=[order("N1", "C35", date(2024, 2, 3), "77.00")])
    sinks.replace_months(readers.read_published(spark, published), new.orders, published)

    def stop(*_, **__):
        raise RuntimeError("stopped")

    with monkeypatch.context() as patched:
        patched.setattr(snapshots, "record_version", stop)
        with pytest.raises(RuntimeError):
            cube.refresh(spark, published, folder)
    assert rows(cube.cell_sums(cube.read(spark, folder))) == before
    assert cube.refresh(spark, published, folder) == ["2024-02"]
    with pytest.raises(FileNotFoundError):
        cube.read(spark, str(tmp_path / "nothing"))
