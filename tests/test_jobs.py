from __future__ import annotations

import random
from datetime import date, timedelta

import pytest

from martlens import jobs
from martlens.__main__ import main
from martlens.operators.dashboard import dashboard
from martlens.sources import readers, sinks
from tests.builders import AS_OF, customer, item, order, product, tables


@pytest.fixture(scope="module")
def exports(spark, tmp_path_factory):
    rng = random.Random(5)
    people = [
        customer(f"C{i}", rng.choice(["North", "South"]), rng.choice(["Gold", "Silver"]),
                 rng.choice(["Male", "Female"]), rng.randrange(18, 65))
        for i in range(60)
    ]
    goods = [product(f"P{i}", rng.choice(["Books", "Toys"]), stock=i * 9) for i in range(12)]
    orders, items = [], []
    for i in range(400):
        who = rng.randrange(60)
        span = 360 if who % 2 else 1090  # every other customer stopped buying
        status = rng.choice(["Delivered"] * 4 + ["Returned", "Cancelled"])
        day = date(2022, 1, 1) + timedelta(days=rng.randrange(span))
        orders.append(order(f"O{i}", f"C{who}", day, f"{rng.randrange(500, 9000) / 100}", status,
                            rng.randrange(1, 10)))
        for j in range(rng.randrange(1, 4)):
            items.append(item(f"I{i}-{j}", f"O{i}", f"P{rng.randrange(12)}", total="12.50"))
    folder = tmp_path_factory.mktemp("exports")
    sinks.export_tables_csv(tables(spark, people, goods, orders, items), str(folder))
    return str(folder)


def test_from_exports_to_predictions(spark, exports, tmp_path):
    published, output = str(tmp_path / "tables"), str(tmp_path / "out")
    main(["publish", "--exports", exports, "--tables", published])
    jobs.run_churn_model(spark, published, output, AS_OF, trees=5)
    predictions = f"{output}/churn_predictions"
    main(["reports", "--tables", published, "--output", output, "--predictions", predictions])

    t = readers.read_published(spark, published, predictions)
    for name in jobs.reports(t, AS_OF):
        frame = spark.read.parquet(f"{output}/reports/{name}")
        assert frame.columns
        if name not in ("orphan_keys", "low_stock_alert"):
            assert frame.count() > 0, name
    for page, visuals in dashboard(t, AS_OF).items():
        for name in visuals:
            assert spark.read.parquet(f"{output}/dashboard/{page}/{name}").count() > 0, name
    assert "customers" in dashboard(t, AS_OF)["customers"]

    auc = spark.read.parquet(f"{output}/churn/roc_auc").first().auc
    assert auc > 0.9
    main(["score", "--tables", published, "--fitted", output, "--output", f"{output}/again"])
    again = readers.read_predictions(spark, f"{output}/again/churn_predictions").collect()
    assert sorted(again) == sorted(readers.read_predictions(spark, predictions).collect())

    bands = spark.read.parquet(f"{output}/churn/risk_band_counts")
    scored = readers.read_predictions(spark, predictions).count()
    assert scored == sum(r.customers for r in bands.collect()) > 0


def scans_of(plans, table):
    """Scans of a published table, a line ``Location`` for each in a formatted plan."""
    return [
        line for plan in plans for line in plan.splitlines()
        if line.startswith("Location") and f"/tables/{table}/" in line
    ]


@pytest.mark.parametrize("kept", [False, True])
def test_reports_scan_orders_three_times_at_most(spark, exports, tmp_path, executed_plans, kept):
    """The cube, its items by product, and the list of purchases."""
    published = str(tmp_path / "tables")
    jobs.publish_exports(spark, exports, published)
    ahead = len(executed_plans())
    folder = str(tmp_path / "cube") if kept else None
    jobs.write_reports(spark, published, str(tmp_path / "out"), AS_OF, cube_folder=folder)
    first = executed_plans()
    assert len(first) > ahead + 30
    assert 2 <= len(scans_of(first[ahead:], "orders")) <= 3
    if kept:
        jobs.write_reports(spark, published, str(tmp_path / "out"), AS_OF, cube_folder=folder)
        assert len(scans_of(executed_plans()[len(first):], "orders")) == 1


def test_missing_tables_say_so(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="no published tables"):
        jobs.run_churn_model(spark, str(tmp_path / "nothing"), str(tmp_path / "o"), AS_OF)
