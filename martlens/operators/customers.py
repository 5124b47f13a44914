"""Lifetime value, RFM segments, churn rates and per-customer views."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martlens.fixed_values import (
    AT_RISK_SCORE,
    CHURN_DAYS,
    DELIVERED,
    FREQUENCY_LIMITS,
    HISTOGRAM_BINS,
    MONETARY_TILES,
    RECENCY_LIMITS,
    RECENT_SCORE,
    SEGMENT_TOTALS,
    SEGMENTS,
    TOP_CUSTOMERS,
)
from martlens.functions.exprs import (
    count_where,
    days_before,
    first_match,
    half_even,
    half_up,
    mean_money,
    money,
    percent,
    ratio,
    score_high_is_good,
    score_low_is_good,
)
from martlens.operators.ordering import distributed_ntile, exact_medians
from martlens.sources.tables import RetailTables

RFM_METRICS = ("recency", "frequency", "monetary")


def clv(
    t: RetailTables, k: int | None = TOP_CUSTOMERS, status: str | None = DELIVERED
) -> DataFrame:
    """Lifetime value per customer, highest first; ``k=None`` keeps everyone.

    Orders are summed per customer before the join, since region and tier
    depend on the customer alone.
    """
    per_customer = (
        t.cube.per_customer(status).withColumnsRenamed(
            {"orders": "total_orders", "amount": "_amount", "amounts": "_amounts"}
        )
        if t.cube is not None
        else t.orders_with(status)
        .groupBy("customer_id")
        .agg(
            t.order_count().alias("total_orders"),
            F.sum("total_amount").alias("_amount"),
            F.count("total_amount").alias("_amounts"),
            F.min("order_date").alias("first_order"),
            F.max("order_date").alias("last_order"),
        )
    )
    ranked = (
        per_customer.join(
            t.customers.select("customer_id", "region", "loyalty_tier"), "customer_id"
        )
        .select(
            "customer_id",
            "region",
            "loyalty_tier",
            "total_orders",
            money(F.col("_amount")).alias("lifetime_value"),
            mean_money(F.col("_amount"), F.col("_amounts")).alias("avg_order_value"),
            "first_order",
            "last_order",
        )
        .orderBy(F.desc_nulls_last("lifetime_value"), "customer_id")
    )
    return ranked if k is None else ranked.limit(k)


def _rfm(t: RetailTables, as_of: date | str, status: str | None) -> DataFrame:
    if t.cube is not None:
        return t.cube.per_customer(status).select(
            "customer_id",
            days_before(as_of, F.col("last_order")).cast("double").alias("recency_days"),
            F.col("orders").alias("frequency"),
            F.col("amount").alias("monetary"),
        )
    return (
        t.orders_with(status)
        .groupBy("customer_id")
        .agg(
            days_before(as_of, F.max("order_date")).cast("double").alias("recency_days"),
            t.order_count().alias("frequency"),
            F.sum("total_amount").alias("monetary"),
        )
    )


def rfm_base(
    t: RetailTables, as_of: date | str, status: str | None = DELIVERED
) -> DataFrame:
    return _rfm(t, as_of, status).withColumn("monetary", money(F.col("monetary")))


def rfm_segments(
    t: RetailTables,
    as_of: date | str,
    status: str | None = DELIVERED,
    r_cuts: Sequence[int] = RECENCY_LIMITS,
    f_cuts: Sequence[int] = FREQUENCY_LIMITS,
    m_tiles: int = MONETARY_TILES,
    totals: Sequence[int] = SEGMENT_TOTALS,
    recent_r: int = RECENT_SCORE,
    risk_f: int = AT_RISK_SCORE,
    ordered: bool = True,
) -> DataFrame:
    """RFM scores and segment per customer with an order of the given status.

    The monetary tiles rank exact decimals with the customer id as tie-break.
    """
    tiled = distributed_ntile(
        _rfm(t, as_of, status), m_tiles, ["monetary", "customer_id"], "m_score"
    )
    scored = tiled.withColumns(
        {
            "r_score": score_low_is_good(F.col("recency_days"), r_cuts),
            "f_score": score_high_is_good(F.col("frequency"), f_cuts),
        }
    ).withColumn("rfm_total", F.col("r_score") + F.col("f_score") + F.col("m_score"))
    conditions = [F.col("rfm_total") >= least for least in totals]
    conditions += [F.col("r_score") >= recent_r, F.col("f_score") >= risk_f]
    segment = first_match(conditions, SEGMENTS)
    result = scored.select(
        "customer_id",
        "recency_days",
        "frequency",
        money(F.col("monetary")).alias("monetary"),
        "r_score",
        "f_score",
        "m_score",
        "rfm_total",
        segment.alias("customer_segment"),
    )
    return result.orderBy(F.desc("rfm_total"), "customer_id") if ordered else result


def _rfm_long(t: RetailTables, as_of: date | str, status: str | None) -> DataFrame:
    base = rfm_base(t, as_of, status).select(
        F.col("recency_days").alias("recency"),
        F.col("frequency").cast("double").alias("frequency"),
        "monetary",
    )
    return base.unpivot([], list(RFM_METRICS), "metric", "value")


def rfm_histogram(
    t: RetailTables, as_of: date | str, bins: int = HISTOGRAM_BINS, status: str | None = DELIVERED
) -> DataFrame:
    return histogram(_rfm_long(t, as_of, status), bins)


def histogram(long: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width counts of ``value`` per ``metric``, empty bins included.

    Bins are half-open but for the last. A value is placed by arithmetic and
    then moved by at most one bin to agree with the printed edges. A metric with
    a single value gets a range of one around it. The ranges are one row per
    metric, and metrics are columns of a frame, so they are safe to broadcast.
    """
    ranges = long.groupBy("metric").agg(
        F.min("value").alias("_min"), F.max("value").alias("_max")
    )
    flat = F.col("_min") == F.col("_max")
    ranges = ranges.where(F.col("_min").isNotNull()).select(
        "metric",
        F.when(flat, F.col("_min") - 0.5).otherwise(F.col("_min")).alias("_lo"),
        F.when(flat, F.col("_max") + 0.5).otherwise(F.col("_max")).alias("_hi"),
    )
    step = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))

    def edge(number):
        inner = F.col("_lo") + number * step
        return F.when(number == bins, F.col("_hi")).otherwise(inner)

    raw = F.floor((F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins)
    slot = F.least(raw, F.lit(bins - 1))
    moved = (
        F.when(F.col("value") < edge(F.col("_slot")), F.col("_slot") - 1)
        .when(
            (F.col("_slot") < bins - 1) & (F.col("value") >= edge(F.col("_slot") + 1)),
            F.col("_slot") + 1,
        )
        .otherwise(F.col("_slot"))
    )
    counts = (
        long.where(F.col("value").isNotNull())
        .join(F.broadcast(ranges), "metric")
        .withColumn("_slot", slot)
        .groupBy("metric", (moved + 1).alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    grid = ranges.select(
        "metric", "_lo", "_hi", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin")
    ).withColumn("bin", F.col("bin").cast("long"))
    return (
        grid.join(counts, ["metric", "bin"], "left")
        .select(
            "metric",
            "bin",
            edge(F.col("bin") - 1).alias("lo"),
            edge(F.col("bin")).alias("hi"),
            F.coalesce(F.col("count"), F.lit(0)).alias("count"),
        )
        .orderBy("metric", "bin")
    )


def rfm_medians(
    t: RetailTables,
    as_of: date | str,
    exact: bool = True,
    status: str | None = DELIVERED,
) -> DataFrame:
    """Median of each RFM metric; ``exact=False`` uses a bounded sketch."""
    long = _rfm_long(t, as_of, status)
    if exact:
        return exact_medians(long, "metric", "value").orderBy("metric")
    return (
        long.groupBy("metric")
        .agg(F.percentile_approx("value", 0.5).alias("median"))
        .orderBy("metric")
    )


def _last_orders(t: RetailTables, status: str | None) -> DataFrame:
    if t.cube is not None:
        return t.cube.per_customer(status).select("customer_id", "last_order")
    return (
        t.orders_with(status)
        .groupBy("customer_id")
        .agg(F.max("order_date").alias("last_order"))
    )


def _churn_counts(
    t: RetailTables, by: Sequence[str], as_of: date | str, days: int, status: str | None
) -> DataFrame:
    """Customers and churned customers per attribute.

    A customer without such an order counts in the total but is not churned.
    """
    churned = days_before(as_of, F.col("last_order")) > days
    return (
        t.customers.select("customer_id", *by)
        .join(_last_orders(t, status), "customer_id", "left")
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias("_total"), count_where(churned).alias("_churned"))
    )


def churn_by_region_tier(
    t: RetailTables,
    as_of: date | str,
    days: int = CHURN_DAYS,
    by: Sequence[str] = ("region", "loyalty_tier"),
    status: str | None = DELIVERED,
) -> DataFrame:
    return (
        _churn_counts(t, by, as_of, days, status)
        .select(
            *by,
            F.col("_total").alias("total_customers"),
            F.col("_churned").alias("churned_customers"),
            percent(F.col("_churned"), F.col("_total")).alias("churn_rate_pct"),
        )
        .orderBy(F.desc("churn_rate_pct"), *by)
    )


def churn_by_region(
    t: RetailTables,
    as_of: date | str,
    days: int = CHURN_DAYS,
    by: Sequence[str] = ("region",),
    status: str | None = DELIVERED,
) -> DataFrame:
    """Churn rate per region against the plain mean of the rounded rates."""
    rates = _churn_counts(t, by, as_of, days, status).select(
        *by,
        F.col("_total").alias("total"),
        F.col("_churned").alias("churned"),
        half_even(
            ratio(F.col("_churned"), F.col("_total")) * F.lit(100.0), 1
        ).alias("churn_rate"),
    )
    groups = Window.partitionBy()
    tenths = F.col("churn_rate").cast("decimal(10,1)")
    mean = ratio(F.sum(tenths).over(groups), F.count(tenths).over(groups))
    return (
        rates.withColumn("_mean", mean)
        .select(
            "*",
            half_up(F.col("_mean"), 6).alias("avg_rate"),
            (F.col("churn_rate") > F.col("_mean")).alias("above_avg"),
        )
        .drop("_mean")
        .orderBy(*by)
    )


def churned_customers(
    t: RetailTables, as_of: date | str, days: int = CHURN_DAYS, status: str | None = DELIVERED
) -> DataFrame:
    """Customers whose last order of the status is more than ``days`` old."""
    since = days_before(as_of, F.col("last_order"))
    lapsed = (
        _last_orders(t, status)
        .withColumn("days_since_order", since)
        .where(F.col("days_since_order") > days)
    )
    return (
        t.customers.select("customer_id", "region", "loyalty_tier")
        .join(lapsed, "customer_id")
        .orderBy(F.desc("days_since_order"), "customer_id")
    )


def customer_360(
    t: RetailTables,
    as_of: date | str,
    scores: DataFrame,
    segment: str | None = None,
    status: str | None = DELIVERED,
) -> DataFrame:
    """Lifetime value, RFM segment and churn prediction per customer.

    Lifetime value and order count are the monetary and frequency of the RFM
    frame, so orders are read once. ``scores`` holds ``customer_id``,
    ``churn_probability`` and ``predicted_segment``; ``segment`` keeps one band.
    """
    rfm = rfm_segments(t, as_of, status, ordered=False).select(
        "customer_id",
        F.col("frequency").alias("total_orders"),
        F.col("monetary").alias("lifetime_value"),
        "customer_segment",
    )
    bands = scores.select("customer_id", "churn_probability", "predicted_segment")
    how = "left"
    if segment is not None:
        bands = bands.where(F.col("predicted_segment") == segment)
        how = "inner"
    return (
        t.customers.select("customer_id", "region", "loyalty_tier")
        .join(rfm, "customer_id")
        .join(bands, "customer_id", how)
        .orderBy(F.desc_nulls_last("lifetime_value"), "customer_id")
    )


def purchase_history(
    t: RetailTables, customer_ids: Sequence | DataFrame | None = None
) -> DataFrame:
    """Orders with their item counts, newest first within each customer.

    ``customer_ids`` is a short list or a frame with a ``customer_id`` column.
    """
    orders = t.orders
    if isinstance(customer_ids, DataFrame):
        orders = orders.join(customer_ids.select("customer_id"), "customer_id", "left_semi")
    elif customer_ids is not None:
        orders = orders.where(F.col("customer_id").isin(list(customer_ids)))
    lines = t.order_items.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("items"), F.sum("quantity").alias("units")
    )
    return (
        orders.join(lines, "order_id", "left")
        .select(
            "customer_id",
            "order_id",
            "order_date",
            "status",
            "payment_method",
            money(F.col("total_amount")).alias("total_amount"),
            F.coalesce(F.col("items"), F.lit(0)).alias("items"),
            F.coalesce(F.col("units"), F.lit(0)).alias("units"),
        )
        .orderBy("customer_id", F.desc("order_date"), "order_id")
    )
