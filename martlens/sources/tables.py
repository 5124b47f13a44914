"""The bundle of tables every operator takes."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import date
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlens.sources.schemas import FIRST_PART, MONTH_PARTITION, ORDER_PART, PRIMARY_KEYS

if TYPE_CHECKING:
    from martlens.operators.cube import OrderCube

Source = DataFrame | Callable[[], DataFrame]


def check_order_ids(orders: DataFrame) -> bool:
    """Whether no order id is null or repeated: one exchange of counted ids.

    It costs about as much as a single distinct count of orders, and saves one
    in every report that follows.
    """
    bad = (
        orders.groupBy("order_id")
        .agg(F.count(F.lit(1)).alias("rows"))
        .where((F.col("rows") > 1) | F.col("order_id").isNull())
    )
    return bad.isEmpty()


def _of_status(orders: DataFrame, status: str | None) -> DataFrame:
    return orders if status is None else orders.where(F.col("status") == F.lit(status))


class RetailTables:
    """Four base tables and, optionally, the exported churn predictions.

    A table may be given as a function that opens it, so that a query only
    touches the files it needs.

    ``customers`` and ``products`` are dimension tables: their ids are taken as
    unique, as declared. ``orders.order_id`` is declared unique too, but is only
    relied on when ``unique_order_ids`` says that somebody checked; counting
    orders then needs no exchange of order ids. Publishing checks and records
    it; :func:`check_order_ids` as the argument checks on first need.
    """

    def __init__(
        self,
        customers: Source,
        products: Source,
        orders: Source,
        order_items: Source,
        churn_predictions: Source | None = None,
        unique_order_ids: bool | Callable[[DataFrame], bool] = False,
        primary_keys: Mapping[str, tuple[str, ...]] = PRIMARY_KEYS,
        checks: Mapping[str, DataFrame] | None = None,
        cube: OrderCube | None = None,
        dealt: tuple[DataFrame, DataFrame] | None = None,
    ) -> None:
        self._sources = {
            "customers": customers,
            "products": products,
            "orders": orders,
            "order_items": order_items,
            "churn_predictions": churn_predictions,
        }
        self._unique_order_ids = unique_order_ids
        self.primary_keys = dict(primary_keys)
        # Results of the key checks of exactly these tables, where they are recorded.
        self.checks = dict(checks or {})
        # Partial sums of exactly these orders; reports that can use them do.
        self.cube = cube
        # Orders and items of exactly these tables with the parts of large orders.
        self.dealt = dealt

    def _table(self, name: str) -> DataFrame | None:
        source = self._sources[name]
        if callable(source):
            source = self._sources[name] = source()
        return source

    @property
    def customers(self) -> DataFrame:
        return self._table("customers")

    @property
    def products(self) -> DataFrame:
        return self._table("products")

    @property
    def orders(self) -> DataFrame:
        return self._table("orders")

    @property
    def order_items(self) -> DataFrame:
        return self._table("order_items")

    @property
    def churn_predictions(self) -> DataFrame | None:
        return self._table("churn_predictions")

    @property
    def unique_order_ids(self) -> bool:
        if callable(self._unique_order_ids):
            self._unique_order_ids = self._unique_order_ids(self.orders)
        return self._unique_order_ids

    def with_cube(self, cube: OrderCube) -> RetailTables:
        """The same tables, whose reports use partial sums of the orders.

        Counts of orders add up only if no order id repeats.
        """
        if not self.unique_order_ids:
            raise ValueError("orders whose ids repeat cannot be counted from partial sums")
        return RetailTables(
            lambda: self.customers, lambda: self.products, lambda: self.orders,
            lambda: self.order_items, lambda: self.churn_predictions,
            True, self.primary_keys, self.checks, cube, self.dealt,
        )

    def base(self) -> dict[str, DataFrame]:
        return {
            "customers": self.customers,
            "products": self.products,
            "orders": self.orders,
            "order_items": self.order_items,
        }

    def orders_with(self, status: str | None) -> DataFrame:
        """Orders of one status, or all of them for ``None``."""
        return _of_status(self.orders, status)

    @property
    def order_key(self) -> list[str]:
        """Columns on which items meet their orders.

        In bucketed tables the items of a large order are dealt over several
        buckets, and a copy of the order lies in each: a part of the order.
        """
        return ["order_id", ORDER_PART] if self.dealt else ["order_id"]

    def items_by_key(self, *columns: str) -> DataFrame:
        """The order key and these columns of the items."""
        items = self.dealt[1] if self.dealt else self.order_items
        return items.select(*self.order_key, *columns)

    def orders_by_key(self, status: str | None = None) -> DataFrame:
        """One row per order and part, for joins with :meth:`items_by_key`.

        ``first_part`` marks one part of each order. Columns of the order repeat in
        the others, so sums of them must be over first parts.
        """
        if self.dealt:
            return _of_status(self.dealt[0], status)
        return self.orders_with(status).withColumn(FIRST_PART, F.lit(True))

    def orders_of_year(self, year: int | None) -> DataFrame:
        """Orders of one year, or all of them for ``None``.

        The date range is pushed to the scan. Published orders are partitioned
        by month, so there the same range also skips whole partitions.
        """
        if year is None:
            return self.orders
        day = F.col("order_date")
        orders = self.orders.where(day.between(date(year, 1, 1), date(year, 12, 31)))
        if MONTH_PARTITION in orders.columns:
            months = F.col(MONTH_PARTITION).between(f"{year:04}-01", f"{year:04}-12")
            orders = orders.where(months)
        return orders

    def order_count(self, order_id: Column | None = None) -> Column:
        """Aggregate counting the distinct orders of an order-grain frame."""
        key = F.col("order_id") if order_id is None else order_id
        return F.count(key) if self.unique_order_ids else F.countDistinct(key)

    def register_views(self) -> None:
        """Expose the tables to ``spark.sql`` under their own names."""
        frames = self.base()
        if self.churn_predictions is not None:
            frames["churn_predictions"] = self.churn_predictions
        for name, frame in frames.items():
            frame.createOrReplaceTempView(name)
