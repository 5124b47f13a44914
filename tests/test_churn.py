from __future__ import annotations

import hashlib
from datetime import date

import pytest

from martlens.churn import features as X
from martlens.churn import split as S
from martlens.fixed_values import FEATURES
from tests.builders import AS_OF, by_key, customer, days_ago, item, order, tables


@pytest.fixture(scope="module")
def shop(spark):
    return tables(
        spark,
        [
            customer("a", gender="Male", registered=date(2024, 1, 1)),
            customer("b", gender=None, region="South"),
            customer("c", gender="Female"),
            customer("idle", gender="Other"),
        ],
        orders=[
            order("1", "a", days_ago(180), "10.00", shipping=2),
            order("2", "a", days_ago(400), "40.00", status="Returned"),
            order("3", "b", days_ago(181), "7.00", shipping=4),
            order("4", "c", days_ago(5), "9.00", status="Cancelled"),
            order("5", "a", days_ago(1), "99.00", shipping=9),  # no items
        ],
        items=[
            item("i1", "1", discount="0.10"),
            item("i2", "1", discount="0.20"),
            item("i3", "1", discount="0.30"),
            item("i4", "2", discount="0.00"),
            item("i5", "3"),
            item("i6", "4"),
            item("i7", "ghost"),
        ],
    )


def test_item_grain_repeats_orders_per_item(shop):
    a = by_key(X.churn_features(shop, AS_OF), "customer_id")["a"]
    assert a == {
        "customer_id": "a", "recency": 180, "frequency": 2, "monetary": 70.0,
        "avg_order_value": 17.5, "min_shipping": 2, "avg_shipping": 2.0, "returns": 1,
        "cancellations": 0, "avg_discount": 0.15,
    }


def test_order_grain_counts_orders_once_and_keeps_empty_ones(shop):
    a = by_key(X.churn_features(shop, AS_OF, "order"), "customer_id")["a"]
    assert (a["recency"], a["frequency"], a["monetary"]) == (1, 3, 149.0)
    assert (a["avg_shipping"], a["returns"], a["avg_discount"]) == (5.5, 1, 0.15)
    with pytest.raises(ValueError):
        X.churn_features(shop, AS_OF, "line")


def test_label_is_strictly_beyond_the_limit(shop):
    labels = {r.customer_id: r.churned for r in X.churn_labels(shop, AS_OF).collect()}
    assert labels == {"a": 0, "b": 1, "c": 0}


def test_codes_sort_nulls_as_text(shop):
    codes = {r.customer_id: r.gender for r in X.encoded_categories(shop).collect()}
    assert codes == {"c": 0, "a": 1, "idle": 2, "b": 3}  # Female, Male, Other, nan


def test_matrix_codes_buyers_before_dropping_incomplete_rows(shop):
    matrix = X.feature_matrix(shop, AS_OF)
    assert matrix.columns == [*FEATURES, "churned", "customer_id"]
    rows = by_key(matrix, "customer_id")
    # c has no shipping days and drops out, but its gender still takes code 0.
    assert set(rows) == {"a", "b"}
    assert rows["a"]["gender"] == 1 and rows["b"]["gender"] == 2
    assert rows["a"]["tenure_days"] == 365
    assert X.churn_dataset_summary(matrix).first() == (2, 1, 50.0)
    without = X.feature_matrix(shop, AS_OF, exclude_features=["recency"])
    assert "recency" not in without.columns and without.count() == 2


def labelled(spark, sizes):
    rows = [(f"{label}-{i}", label) for label, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "customer_id string, churned int")


@pytest.mark.parametrize(
    "sizes, tests",
    [
        ({0: 103, 1: 57}, {0: 21, 1: 11}),
        ({0: 4, 1: 5}, {0: 1, 1: 1}),
        ({0: 6000, 1: 3}, {0: 1200, 1: 1}),
        ({0: 7, 1: 6}, {0: 2, 1: 1}),
        ({0: 73, 1: 72}, {0: 15, 1: 14}),
    ],
)
def test_split_is_exact_and_follows_the_digest_order(spark, sizes, tests):
    rows = S.stratified_split(labelled(spark, sizes)).collect()
    assert len(rows) == sum(sizes.values())
    for label in sizes:
        ids = sorted(
            (r.customer_id for r in rows if r.churned == label),
            key=lambda k: hashlib.md5(f"42-{k}".encode()).hexdigest(),
        )
        test = {r.customer_id for r in rows if r.churned == label and r.is_test}
        assert test == set(ids[: tests[label]])


def test_split_ignores_partitioning(spark):
    df = labelled(spark, {0: 50, 1: 50})
    one = S.stratified_split(df.coalesce(1)).where("is_test").select("customer_id").collect()
    many = S.stratified_split(df.repartition(7)).where("is_test").select("customer_id").collect()
    assert sorted(one) == sorted(many)


@pytest.mark.parametrize("sizes", [{0: 103, 1: 57}, {0: 3, 1: 12}])
def test_folds_cover_every_row_evenly(spark, sizes):
    rows = S.stratified_folds(labelled(spark, sizes)).collect()
    assert len(rows) == sum(sizes.values())
    for label in sizes:
        counts = [sum(r.fold == f and r.churned == label for r in rows) for f in range(5)]
        assert max(counts) - min(counts) <= 1 and sum(counts) == sizes[label]


def test_balanced_weights(spark):
    weights = by_key(S.balanced_weights(labelled(spark, {0: 75, 1: 25})), "churned")
    assert weights[0]["weight"] == pytest.approx(100 / (2 * 75))
    assert weights[1]["weight"] == 2.0


def test_codes_are_kept_for_later_rows(spark):
    first = spark.createDataFrame([("x", None), ("z", "b"), ("z", "a"), ("y", "b")], "p string, q string")
    codes = X.category_codes(first, ["p", "q"])
    found = {(r.column, r.value): r.code for r in codes.collect()}
    assert found == {("p", "x"): 0, ("p", "y"): 1, ("p", "z"): 2,
                     ("q", "a"): 0, ("q", "b"): 1, ("q", "nan"): 2}
    assert sorted(X.encode(first, ["p", "q"]).collect()) == [(0, 2), (1, 1), (2, 0), (2, 1)]
    later = spark.createDataFrame([("y", "b"), ("new", None), (None, "other")], "p string, q string")
    assert sorted(X.encode(later, ["p", "q"], codes).collect()) == [(1, 1), (3, 2), (3, 3)]
    nothing = X.category_codes(first.limit(0), ["p", "q"])
    assert {tuple(r) for r in X.encode(later, ["p", "q"], nothing).collect()} == {(0, 0)}
