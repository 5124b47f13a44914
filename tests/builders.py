"""Small hand-made tables."""

from __future__ import annotations

from datetime import date, timedelta
from decimal import Decimal

from martlens.sources.schemas import CUSTOMERS, ORDER_ITEMS, ORDERS, PRODUCTS
from martlens.sources.tables import RetailTables

AS_OF = date(2024, 12, 31)


def days_ago(days: int) -> date:
    return AS_OF - timedelta(days=days)


def customer(key, region="North", tier="Gold", gender="Male", age=30, registered=None):
    return (key, age, gender, region, registered or date(2022, 1, 1), tier)


def product(key, category="Books", price="10.00", cost="4.00", stock=100, name=None):
    return (key, name or f"Product {key}", category, Decimal(price), Decimal(cost), stock, "S1")


def order(key, who, day=None, amount="10.00", status="Delivered", shipping=3, pay="UPI"):
    days = shipping if status == "Delivered" else None
    return (key, who, day or days_ago(10), status, pay, Decimal(amount), days)


def item(key, of, what="P1", quantity=1, total="10.00", discount="0.00", price="10.00"):
    return (key, of, what, quantity, Decimal(price), Decimal(discount), Decimal(total))


def tables(spark, customers=(), products=(), orders=(), items=(), **options) -> RetailTables:
    def frame(rows, schema):
        return spark.createDataFrame(list(rows), schema)

    return RetailTables(
        frame(customers, CUSTOMERS),
        frame(products, PRODUCTS),
        frame(orders, ORDERS),
        frame(items, ORDER_ITEMS),
        **options,
    )


def by_key(df, *keys):
    """Rows as dictionaries, looked up by one or several columns."""
    found = {}
    for row in df.collect():
        key = row[keys[0]] if len(keys) == 1 else tuple(row[k] for k in keys)
        assert key not in found
        found[key] = row.asDict()
    return found
