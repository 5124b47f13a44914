"""Behavioural features, churn label, category codes and the feature matrix."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlens.fixed_values import CANCELLED, CATEGORIES, CHURN_DAYS, FEATURES, RETURNED
from martlens.functions.exprs import (
    days_before,
    half_up,
    mean_money,
    money,
    percent,
    ratio,
    sum_if,
)
from martlens.operators.ordering import position_in_group
from martlens.session import written
from martlens.sources.schemas import FIRST_PART
from martlens.sources.tables import RetailTables


def churn_features(t: RetailTables, as_of: date | str, grain: str = "item") -> DataFrame:
    """Purchase behaviour per customer over orders of every status.

    ``grain="item"`` counts an order once per item, as a join of orders to
    items does: amounts, shipping days, returns and cancellations are weighted
    by the number of items, and orders without items drop out. ``"order"``
    counts each order once and keeps orders without items.

    Items are summed per order before the join instead of repeating the order
    columns per item. The weight then stands for the repeated rows, and an
    order holding a large share of all items is one row, or in bucketed tables
    one row for each of its parts.
    """
    if grain not in ("item", "order"):
        raise ValueError("grain is 'item' or 'order'")
    by_item = grain == "item"
    per_order = t.items_by_key("discount_pct").groupBy(*t.order_key).agg(
        F.count(F.lit(1)).alias("_items"),
        F.sum("discount_pct").alias("_discount"),
        F.count("discount_pct").alias("_discounts"),
    )
    orders = t.orders_by_key().select(
        *t.order_key, FIRST_PART, "customer_id", "order_date", "status", "total_amount",
        "shipping_days",
    ).join(per_order, t.order_key, "inner" if by_item else "left")
    weight = F.col("_items") if by_item else F.col(FIRST_PART).cast("long")
    amount, shipping = F.col("total_amount"), F.col("shipping_days")
    sums = (
        orders.groupBy("customer_id")
        .agg(
            F.max("order_date").alias("_last"),
            t.order_count(F.when(F.col(FIRST_PART), F.col("order_id"))).alias("frequency"),
            F.sum(amount * weight).alias("_amount"),
            sum_if(amount.isNotNull(), weight).alias("_amounts"),
            F.min(shipping).alias("min_shipping"),
            F.sum(shipping * weight).alias("_shipping"),
            sum_if(shipping.isNotNull(), weight).alias("_shippings"),
            F.sum(_one_if(RETURNED, weight)).alias("returns"),
            F.sum(_one_if(CANCELLED, weight)).alias("cancellations"),
            F.sum("_discount").alias("_discount"),
            F.sum("_discounts").alias("_discounts"),
        )
    )
    return sums.select(
        "customer_id",
        days_before(as_of, F.col("_last")).alias("recency"),
        "frequency",
        money(F.col("_amount")).alias("monetary"),
        mean_money(F.col("_amount"), F.col("_amounts")).alias("avg_order_value"),
        "min_shipping",
        half_up(ratio(F.col("_shipping"), F.col("_shippings")), 1).alias("avg_shipping"),
        "returns",
        "cancellations",
        half_up(ratio(F.col("_discount"), F.col("_discounts")), 3).alias("avg_discount"),
    )


def _one_if(status: str, weight):
    return F.when(F.col("status") == status, weight).otherwise(F.lit(0).cast("long"))


def with_label(features: DataFrame, days: int = CHURN_DAYS) -> DataFrame:
    return features.withColumn("churned", (F.col("recency") > days).cast("int"))


def churn_labels(
    t: RetailTables, as_of: date | str, days: int = CHURN_DAYS, grain: str = "item"
) -> DataFrame:
    labelled = with_label(churn_features(t, as_of, grain), days)
    return labelled.select("customer_id", "recency", "churned")


def _text(column: str) -> Column:
    """The value as text; a null counts as the text ``nan``."""
    return F.coalesce(F.col(column).cast("string"), F.lit("nan"))


def category_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Written dictionary (column, value, code): ranks in sorted order, from 0.

    The values of all columns are made distinct together and ranked together across
    tasks, so none of them is kept on the driver or in one task.
    """
    pair = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), _text(c).alias("value")) for c in columns])
    )
    values = df.select(pair.alias("pair")).select("pair.*").distinct()
    return written(
        position_in_group(values, "column", ["value"]).select(
            "column", "value", (F.col("position") - 1).cast("int").alias("code")
        )
    )


def encode(df: DataFrame, columns: Sequence[str], codes: DataFrame | None = None) -> DataFrame:
    """Replace each column by the code of its value.

    Without ``codes`` those of the frame itself are made. With the codes of another
    frame, as when scoring with a model of that frame, equal values get equal codes,
    and all values it did not have get the code after its last.
    """
    if codes is None:
        codes = category_codes(df, columns)
    # A row for each column.
    ends = codes.groupBy("column").agg((F.max("code") + 1).alias("end")).collect()
    unseen = {row.column: row.end for row in ends}
    for column in columns:
        known = codes.where(F.col("column") == column).select(
            F.col("value").alias("_value"), F.col("code").alias("_code")
        )
        coded = df.withColumn("_text", _text(column)).join(
            known, F.col("_text") == F.col("_value"), "left"
        )
        df = coded.withColumn(column, F.coalesce("_code", F.lit(unseen.get(column, 0)))).drop("_text", "_value", "_code")
    return df


def encoded_categories(t: RetailTables) -> DataFrame:
    return encode(t.customers.select("customer_id", *CATEGORIES), CATEGORIES)


def _joined(t: RetailTables, as_of: date | str, days: int, grain: str) -> DataFrame:
    labelled = with_label(churn_features(t, as_of, grain), days)
    tenure = days_before(as_of, F.col("registration_date"))
    return labelled.join(t.customers, "customer_id").withColumn("tenure_days", tenure)


# Categories are never missing once coded.
_NEEDED = [f for f in FEATURES if f not in CATEGORIES]


def matrix_rows(
    t: RetailTables, as_of: date | str, days: int = CHURN_DAYS, grain: str = "item"
) -> DataFrame:
    """The customers that the matrix keeps, with categories as they are.

    Questions about labels alone are answered from this, without any write.
    """
    return _joined(t, as_of, days, grain).dropna("any", subset=_NEEDED)


def feature_matrix(
    t: RetailTables,
    as_of: date | str,
    days: int = CHURN_DAYS,
    grain: str = "item",
    exclude_features: Sequence[str] = (),
    codes: DataFrame | None = None,
) -> DataFrame:
    """Model inputs, label and customer id; rows with a missing input drop out.

    ``codes`` are the category codes of the matrix that a model was fitted on.

    The joined customers are written once, as coding the categories needs a pass
    of its own, and so is the finished matrix: later fits and scores repeat no
    join and read just the columns they need.
    """
    customers = joined_customers(t, as_of, days, grain)
    kept = [f for f in FEATURES if f not in set(exclude_features)]
    coded = encode(customers, CATEGORIES, codes)
    return written(
        coded.dropna("any", subset=_NEEDED).select(*kept, "churned", "customer_id")
    )


def joined_customers(
    t: RetailTables, as_of: date | str, days: int = CHURN_DAYS, grain: str = "item"
) -> DataFrame:
    """Written inputs and label of the customers, before categories are coded."""
    return written(_joined(t, as_of, days, grain).select(*FEATURES, "churned", "customer_id"))


def churn_dataset_summary(matrix: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    churned = F.sum("churned")
    return matrix.agg(
        n.alias("customers"),
        F.coalesce(churned, F.lit(0)).alias("churned"),
        percent(churned, n, 1).alias("churn_pct"),
    )
