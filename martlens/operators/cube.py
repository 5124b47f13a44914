"""Partial sums of orders by month, status, payment method and customer attribute.

One pass over the orders sums them per month, status, payment method and customer.
From that come three tables, each split by month:

``cells``            sums by month, status, payment method, region, tier and block
                     of 32,768 customer numbers, with a bitmap of the customers;
``customer_months``  sums by month, status and customer, for questions per customer;
``product_sales``    item sums by month, status and product, from a second pass.

Distinct customers of any union of cells are counted exactly: customers have dense
numbers from a written dictionary, bitmaps of a block are joined by OR, and the bits
are counted. Numbers follow region and tier, so a block holds few of them. Distinct
orders per category add up too: of the products of a category in an order, one
carries the mark that counts the order.

A month's sums do not depend on other months. :func:`refresh` keeps, for every month,
the stamps of the files it was summed from, and sums again only where they differ.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlens.fixed_values import DELIVERED, RETURNED
from martlens.functions.exprs import count_where, month_start, sum_if, year_month, year_start
from martlens.operators.ordering import global_position
from martlens.session import file_stamps, written
from martlens.sources import snapshots
from martlens.sources.schemas import MONTH_PARTITION
from martlens.sources.tables import RetailTables

ATTRIBUTES = ("region", "loyalty_tier")
KEYS = ("month", "year", "status", "payment_method", *ATTRIBUTES)

_ADDED = ("rows", "orders", "amount", "amounts", "days", "shipped")
_LEAST, _MOST = ("min_days", "first_order"), ("max_days", "last_order")


def _merged(names: Sequence[str]) -> list[Column]:
    """Partial states of equal keys, put together."""
    return [
        (F.min if n in _LEAST else F.max if n in _MOST else F.sum)(n).alias(n) for n in names
    ]


def _customer_months(orders: DataFrame) -> DataFrame:
    amount, days, day = F.col("total_amount"), F.col("shipping_days"), F.col("order_date")
    return (
        orders.withColumn("month", month_start(day))
        .groupBy("month", "status", "payment_method", "customer_id")
        .agg(
            F.count(F.lit(1)).alias("rows"), F.count("order_id").alias("orders"),
            F.sum(amount).alias("amount"), F.count(amount).alias("amounts"),
            F.sum(days).alias("days"), F.count(days).alias("shipped"),
            F.min(days).alias("min_days"), F.max(days).alias("max_days"),
            F.min(day).alias("first_order"), F.max(day).alias("last_order"),
        )
        .withColumn(MONTH_PARTITION, year_month(F.col("month")))
    )


def _dictionary(people: DataFrame, offset: int) -> DataFrame:
    """Dense customer numbers from ``offset`` + 1, in order of their attributes."""
    ranked = global_position(people, [F.desc("known"), *ATTRIBUTES, "customer_id"])
    return ranked.select(*people.columns, (F.col("position") + offset).alias("number"))


def _cells(customer_months: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The rows of a bitmap meet before it is built, so that none of them is sent.

    Such a group has a row for a customer of its block at most, and orders without a
    customer are one row for each task by then.
    """
    numbered = customer_months.join(dictionary, "customer_id", "left").withColumn(
        "block", F.bitmap_bucket_number("number")
    )
    keys = [MONTH_PARTITION, "month", "status", "payment_method", *ATTRIBUTES, "known", "block"]
    sums = [*_ADDED, "min_days", "max_days"]
    return (
        numbered.repartition(MONTH_PARTITION, "status", "payment_method", "block")
        .groupBy(*keys)
        .agg(*_merged(sums), F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("customers"))
    )


def _product_sales(t: RetailTables, orders: DataFrame) -> DataFrame:
    """Item sums by month, status and product; items of unknown orders or products drop out.

    Items move by product, by order and by the keys of the result, once each. The rows
    of an order meet in the join with the orders, so that summing them per product and
    marking the first product of a category need no exchange of their own. A hot order
    or product is split by the skew join.
    """
    products = t.products.select("product_id", "category")
    days = orders.select("order_id", month_start(F.col("order_date")).alias("month"), "status")
    items = t.order_items.select("order_id", "product_id", "quantity", "line_total", "discount_pct")
    lines = items.join(products, "product_id").join(days, "order_id").groupBy(
        "order_id", "product_id", "category", "month", "status"
    ).agg(
        F.sum("quantity").alias("units"), F.sum("line_total").alias("revenue"),
        F.sum("discount_pct").alias("discount"), F.count("discount_pct").alias("discounts"),
    )
    first = F.row_number().over(Window.partitionBy("order_id", "category").orderBy("product_id"))
    return (
        lines.withColumn("marked", (first == 1).cast("long"))
        .groupBy("month", "status", "product_id")
        .agg(*[F.sum(c).alias(c) for c in ("units", "revenue", "discount", "discounts")],
             F.sum("marked").alias("orders"))
        .withColumn(MONTH_PARTITION, year_month(F.col("month")))
    )


class OrderCube:
    """The three tables of one state of the orders, and the reports' sums from them."""

    def __init__(self, cells: DataFrame, customer_months: DataFrame, product_sales: DataFrame) -> None:
        self.cells, self._customers, self._products = cells, customer_months, product_sales

    def sums(
        self, by: Sequence[str] = (), status: str | None = None, year: int | None = None,
        region: str | None = None, customers: bool = False,
    ) -> DataFrame:
        """Sums per ``by`` (of ``KEYS``), of one status, year or region if given.

        Grouping or slicing by an attribute leaves out orders of unknown customers,
        as a join does. With ``customers`` the distinct ones are counted, and
        ``_customers`` holds their number.
        """
        if set(by) - set(KEYS):
            raise ValueError(f"the cube has no {sorted(set(by) - set(KEYS))}")
        rows = self.cells
        if status is not None:
            rows = rows.where(F.col("status") == status)
        if year is not None:
            rows = rows.where(F.col("month").between(date(year, 1, 1), date(year, 12, 31)))
        if region is not None:
            rows = rows.where(F.col("region") == region)
        if region is not None or set(by) & set(ATTRIBUTES):
            rows = rows.where("known")
        if "year" in by:
            rows = rows.withColumn("year", year_start(F.col("month")))
        delivered = F.col("status") == DELIVERED
        counts = {
            "_rows": F.sum("rows"), "_orders": F.sum("orders"), "_amounts": F.sum("amounts"),
            "_shipped": F.sum("shipped"), "_delivered": sum_if(delivered, F.col("orders")),
            "_returned": sum_if(F.col("status") == RETURNED, F.col("rows")),
        }
        states = {
            **{n: F.coalesce(c, F.lit(0)) for n, c in counts.items()},
            "_amount": F.sum("amount"), "_days": F.sum("days"),
            "_revenue": sum_if(delivered, F.col("amount")),
            "_min_days": F.min("min_days"), "_max_days": F.max("max_days"),
        }
        every = [c.alias(n) for n, c in states.items()]
        if not customers:
            return rows.groupBy(*by).agg(*every)
        again = {n: F.sum(n) for n in states} | {n: F.coalesce(F.sum(n), F.lit(0)) for n in counts}
        again |= {
            "_min_days": F.min("_min_days"), "_max_days": F.max("_max_days"),
            "_customers": F.coalesce(F.sum(F.bitmap_count("_bits")), F.lit(0)),
        }
        joined = rows.groupBy(*by, "block").agg(*every, F.bitmap_or_agg("customers").alias("_bits"))
        return joined.groupBy(*by).agg(*[c.alias(n) for n, c in again.items()])

    def customer_rollup(self, status: str | None = None) -> DataFrame:
        """Distinct customers by month and region, year and region, region, and in all.

        Every level is the OR of the bitmaps below it.
        """
        rows = self.cells if status is None else self.cells.where(F.col("status") == status)
        dated = rows.where("known").withColumn("year", year_start(F.col("month")))
        month, year, region, block = (F.col(c) for c in ("month", "year", "region", "block"))
        sets = [[month, region, block], [year, region, block], [region, block], [block]]
        level = (
            F.when(F.grouping("month") == 0, "month").when(F.grouping("year") == 0, "year")
            .when(F.grouping("region") == 0, "region").otherwise("total")
        )
        joined = dated.groupingSets(sets, month, year, region, block).agg(
            level.alias("level"), F.bitmap_or_agg("customers").alias("_bits")
        )
        return (
            joined.groupBy("level", F.coalesce("month", "year").alias("period"), "region")
            .agg(F.sum(F.bitmap_count("_bits")).alias("customers"))
            .orderBy("level", "period", "region")
        )

    def per_customer(self, status: str | None = None) -> DataFrame:
        """customer_id, rows, orders, amount, amounts, first_order, last_order."""
        rows = self._customers
        if status is not None:
            rows = rows.where(F.col("status") == status)
        names = ("rows", "orders", "amount", "amounts", "first_order", "last_order")
        return rows.groupBy("customer_id").agg(*_merged(names))

    def product_sales(self, status: str | None = None) -> DataFrame:
        """month, status, product_id, units, revenue, discount, discounts, orders.

        ``orders`` adds up to distinct orders over whole categories only.
        """
        rows = self._products
        return rows if status is None else rows.where(F.col("status") == status)


def cell_sums(cube: OrderCube) -> DataFrame:
    """Rows, amount and distinct customers of the finest groups, as reports see them."""
    by = ["month", "status", "payment_method", *ATTRIBUTES]
    return cube.sums(by, customers=True).select(
        *by, F.col("_rows").alias("rows"), F.col("_orders").alias("orders"),
        F.col("_amount").cast("double").alias("amount"), F.col("_customers").alias("customers"),
    )


def _people(t: RetailTables) -> DataFrame:
    return t.customers.select("customer_id", *ATTRIBUTES, F.lit(True).alias("known"))


def _strangers(customer_months: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Customers of orders that have no number, without attributes."""
    ids = customer_months.where(F.col("customer_id").isNotNull()).select("customer_id").distinct()
    return ids.join(dictionary.select("customer_id"), "customer_id", "left_anti").select(
        "customer_id", *[F.lit(None).cast("string").alias(a) for a in ATTRIBUTES],
        F.lit(False).alias("known"),
    )


def build(t: RetailTables) -> OrderCube:
    """A cube in tables that this application wrote.

    Customers without a row in ``customers`` are numbered after the known ones. Orders
    are counted by their ids, each time an id occurs.
    """
    by_customer = written(_customer_months(t.orders))
    known = _people(t)
    dictionary = _dictionary(known.unionByName(_strangers(by_customer, known)), 0)
    return OrderCube(
        written(_cells(by_customer, dictionary)), by_customer, written(_product_sales(t, t.orders))
    )


# The stored cube

TABLES = ("cells", "customer_months", "product_sales")


def refresh(spark: SparkSession, published: str, folder: str, version: int | None = None) -> list[str]:
    """Bring the cube in ``folder`` to a version of the published tables.

    Returns the months that were summed. A month is summed again if its files are
    others than before, by path, time or size; months that are gone leave the cube.
    If the customers or products changed, or there is no cube, all months are summed,
    as every sum may belong to another region or category then. If items changed,
    their sums are made anew for all months, as nothing says whose they are. The new
    state is recorded last.
    """
    from martlens.sources.readers import read_published

    t = read_published(spark, published, version=version)
    parts = snapshots.read_version(spark, published, version)["parts"]
    stamps = {
        month: _stamp(spark, f"{published}/orders/{MONTH_PARTITION}={month}/{snapshots.PART}={name}")
        for month, name in parts["orders"].items()
    }
    others = {n: parts[n][snapshots.WHOLE] for n in ("customers", "products", "order_items")}
    old = snapshots.read_version(spark, folder)
    changed = [] if old is None else [m for m in stamps if old["months"].get(m) != stamps[m]]
    kept = old is not None and all(old["others"][n] == others[n] for n in ("customers", "products"))
    if kept and not changed and old["others"] == others and set(old["months"]) == set(stamps):
        return []
    if not kept:
        changed = list(stamps)
    same_items = kept and old["others"]["order_items"] == others["order_items"]
    orders = _of_months(t.orders, changed) if kept else t.orders
    by_customer = written(_customer_months(orders))
    now: snapshots.Parts = {name: {} for name in TABLES}
    if kept:
        now = {
            name: {m: part for m, part in old["parts"][name].items() if m in stamps and m not in changed}
            for name in TABLES
        }
        if not same_items:
            now["product_sales"] = {}
        now["dictionary"] = dict(old["parts"]["dictionary"])
        numbers = old["numbers"]
        dictionary = _read_dictionary(spark, folder, now)
        added = _strangers(by_customer, dictionary)
    else:
        now["dictionary"], numbers = {}, 0
        known = _people(t)
        added = known.unionByName(_strangers(by_customer, known))
    new = written(_dictionary(added, numbers))
    count = new.count()
    if count:
        now["dictionary"][str(numbers)] = snapshots.write_whole(new, folder, "dictionary")[snapshots.WHOLE]
    dictionary = _read_dictionary(spark, folder, now)
    results = {
        "customer_months": by_customer,
        "cells": _cells(by_customer, dictionary),
        "product_sales": _product_sales(t, orders if same_items else t.orders),
    }
    for name, frame in results.items():
        sized = frame.hint("rebalance", MONTH_PARTITION)
        now[name] |= snapshots.write_by(sized, folder, name, MONTH_PARTITION)
    snapshots.record_version(
        spark, folder, now, months=stamps, others=others, numbers=numbers + count
    )
    snapshots.drop_old(spark, folder, keep=2)
    return changed


def _stamp(spark: SparkSession, folder: str) -> list:
    return [list(file) for file in file_stamps(spark, folder)]


def _of_months(orders: DataFrame, months: Sequence[str]) -> DataFrame:
    """Only the folders of these months are read."""
    named = [m for m in months if m != snapshots.NO_VALUE]
    wanted = F.col(MONTH_PARTITION).isin(named)
    if snapshots.NO_VALUE in months:
        wanted = wanted | F.col(MONTH_PARTITION).isNull()
    return orders.where(wanted)


_DICTIONARY = T.StructType([
    T.StructField("customer_id", T.StringType()),
    *[T.StructField(a, T.StringType()) for a in ATTRIBUTES],
    T.StructField("known", T.BooleanType()), T.StructField("number", T.LongType()),
])


def _read_dictionary(spark: SparkSession, folder: str, parts: snapshots.Parts) -> DataFrame:
    paths = [f"{folder}/dictionary/{snapshots.PART}={n}" for n in parts["dictionary"].values()]
    if not paths:
        return spark.createDataFrame([], _DICTIONARY)
    return spark.read.option("basePath", f"{folder}/dictionary").parquet(*paths).drop(snapshots.PART)


_STATES = {
    "cells": "month date, status string, payment_method string, region string, loyalty_tier string, "
    "known boolean, block long, rows long, orders long, amount decimal(38,2), amounts long, days long, "
    "shipped long, min_days int, max_days int, customers binary",
    "customer_months": "month date, status string, payment_method string, customer_id string, rows long, "
    "orders long, amount decimal(28,2), amounts long, days long, shipped long, min_days int, "
    "max_days int, first_order date, last_order date",
    "product_sales": "month date, status string, product_id string, units long, revenue decimal(38,2), "
    "discount decimal(24,2), discounts long, orders long",
}


def read(spark: SparkSession, folder: str) -> OrderCube:
    """The cube that :func:`refresh` keeps in a folder."""
    record = snapshots.read_version(spark, folder)
    if record is None:
        raise FileNotFoundError(f"no cube in {folder}")
    frames = {
        name: snapshots.read_by(
            spark, folder, name, record["parts"], MONTH_PARTITION, T.StructType.fromDDL(_STATES[name])
        )
        for name in TABLES
    }
    return OrderCube(frames["cells"], frames["customer_months"], frames["product_sales"])
