"""Writers: published Parquet, co-bucketed catalog tables, CSV exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from martlens.functions.exprs import year_month
from martlens.operators.quality import duplicate_keys, orphan_keys
from martlens.session import written
from martlens.sources import snapshots
from martlens.sources.readers import (
    CONSTRAINTS, ORPHANS, REASONS, published_frames, read_catalog_tables, read_csv_checked,
)
from martlens.sources.schemas import BASE_SCHEMAS, FIRST_PART, MONTH_PARTITION, ORDER_PART
from martlens.sources.tables import RetailTables, check_order_ids


def publish(tables: RetailTables, folder: str, keep: int = 2) -> int:
    """Write the tables as a new version, with the result of the key checks.

    The version is recorded last, from checks of the written tables. Until then, and
    for good if the publish stops half-way, readers find the version before. The last
    ``keep`` versions stay, so that a reader can finish on the one it holds. Orders
    are laid out by month. Returns the number of the version.
    """
    frames = tables.base()
    parts = {"orders": _write_orders(frames.pop("orders"), folder)}
    for name, frame in frames.items():
        parts[name] = snapshots.write_whole(frame, folder, name)
    return _checked(tables, folder, parts, keep)


def replace_months(
    tables: RetailTables, orders: DataFrame, folder: str, emptied: Sequence[str] = (),
    keep: int = 2,
) -> int:
    """Publish a version in which the months of ``orders`` hold these orders instead.

    ``tables`` are the published ones. Everything else is shared with the version
    before, and months in ``emptied`` (as ``2024-01``) go. Order ids are checked
    again over all months, as a replaced one may repeat an id of another.
    """
    spark = orders.sparkSession
    parts = snapshots.read_version(spark, folder)["parts"]
    left = {month: name for month, name in parts["orders"].items() if month not in set(emptied)}
    parts = parts | {"orders": left | _write_orders(orders, folder)}
    return _checked(tables, folder, parts, keep)


def _write_orders(orders: DataFrame, folder: str) -> dict[str, str]:
    """The rebalance hint sizes the files and splits a month far larger than others."""
    by_month = orders.withColumn(MONTH_PARTITION, year_month(F.col("order_date")))
    hinted = by_month.hint("rebalance", MONTH_PARTITION)
    return snapshots.write_by(hinted, folder, "orders", MONTH_PARTITION)


def _checked(tables: RetailTables, folder: str, parts: snapshots.Parts, keep: int) -> int:
    spark = tables.orders.sparkSession
    written = RetailTables(**published_frames(spark, folder, parts), primary_keys=tables.primary_keys)
    checks = {CONSTRAINTS: duplicate_keys(written), ORPHANS: orphan_keys(written)}
    for name, frame in checks.items():
        parts[name] = snapshots.write_whole(frame, folder, name)
    number = snapshots.record_version(spark, folder, parts)
    snapshots.drop_old(spark, folder, keep)
    return number


# A part of a large order holds so much of an average bucket's items, about.
PARTS_PER_BUCKET = 8


def publish_bucketed(tables: RetailTables, database: str, buckets: int) -> None:
    """Replace catalog tables with orders and items bucketed by order id.

    Joins of the two on ``order_id`` then need no exchange at all. A bucket is read
    by one task, so orders with more items than an eighth of an average bucket are
    dealt: their items get a part number, a copy of the order goes with each part,
    and the buckets are those of order id and part. Items without an order id are
    dealt as well and have no orders. Items that are equal in all columns and come
    from the same input partition stay together. Repeated rows of one order are not
    dealt, as order ids are declared unique. Without large orders no part number is
    written. The record of the key checks is dropped first and written last.
    """
    spark = tables.orders.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {database}.{CONSTRAINTS}")
    frames = tables.base()
    orders, items = frames.pop("orders"), frames.pop("order_items")
    for name, frame in frames.items():
        frame.write.mode("overwrite").format("parquet").saveAsTable(f"{database}.{name}")
    large = written(_large_orders(items, buckets))
    key = ["order_id"]
    if not large.isEmpty():
        key, items = ["order_id", ORDER_PART], _dealt_items(items, large)
    _save_bucketed(items, f"{database}.order_items", buckets, key)
    if ORDER_PART in key:
        orders = _order_copies(orders, spark.table(f"{database}.order_items"), large)
    _save_bucketed(orders, f"{database}.orders", buckets, key)
    saved = read_catalog_tables(spark, database)
    checks = duplicate_keys(RetailTables(**saved.base(), primary_keys=tables.primary_keys))
    checks.write.mode("overwrite").saveAsTable(f"{database}.{CONSTRAINTS}")


def _save_bucketed(frame: DataFrame, name: str, buckets: int, key: list[str]) -> None:
    writer = frame.repartition(buckets, *key).write.mode("overwrite").format("parquet")
    writer.bucketBy(buckets, *key).sortBy(*key).saveAsTable(name)


def _large_orders(items: DataFrame, buckets: int) -> DataFrame:
    """(large_id, parts) of the orders to deal: fewer than 8 for each bucket."""
    most = items.count() / (buckets * PARTS_PER_BUCKET)
    counts = items.groupBy("order_id").agg(F.count(F.lit(1)).alias("n"))
    parts = F.ceil(F.col("n") / F.lit(most)).cast("int")
    return counts.where((F.col("n") > most) & (F.col("n") > 1)).select(
        F.col("order_id").alias("large_id"), parts.alias("parts")
    )


def _dealt_items(items: DataFrame, large: DataFrame) -> DataFrame:
    """Items with their part, which depends on the row and its input partition alone.

    A repeated task therefore deals its rows as before, in whatever order they come.
    """
    drawn = items.withColumn("_drawn", F.xxhash64(*items.columns, F.spark_partition_id()))
    part = F.coalesce(F.pmod("_drawn", F.col("parts")), F.lit(0)).cast("int")
    # Broadcast: fewer than 8 rows for each bucket.
    return drawn.join(
        F.broadcast(large), F.col("order_id").eqNullSafe(F.col("large_id")), "left"
    ).select(*items.columns, part.alias(ORDER_PART))


def _order_copies(orders: DataFrame, items: DataFrame, large: DataFrame) -> DataFrame:
    """Each order once for every part that has items, the first of which is marked."""
    found = (
        items.join(F.broadcast(large), F.col("order_id") == F.col("large_id"), "left_semi")
        .groupBy(F.col("order_id").alias("large_id"))
        .agg(F.sort_array(F.collect_set(ORDER_PART)).alias("_parts"))
    )
    parts = F.coalesce("_parts", F.array(F.lit(0)))
    # Broadcast: the parts of all large orders are fewer than 16 for each bucket.
    return orders.join(F.broadcast(found), F.col("order_id") == F.col("large_id"), "left").select(
        *orders.columns, F.posexplode(parts).alias(FIRST_PART, ORDER_PART)
    ).withColumn(FIRST_PART, F.col(FIRST_PART) == 0)


def quarantine(
    spark: SparkSession, exports: str, folder: str, max_share: float
) -> RetailTables:
    """The base tables of CSV exports without their malformed rows.

    Rejected rows go to ``folder`` as Parquet, a table for each, with their reasons,
    their text and their file. The load stops if a table has a larger share of them
    than ``max_share``; what was rejected can then be looked up. ``_counts`` in the
    same folder has the rows read and rejected of each table. Files are read twice,
    once for the rejected rows and once for the good ones, so nothing is staged.
    """
    good, counts = {}, []
    for name, schema in BASE_SCHEMAS.items():
        rows = read_csv_checked(spark, f"{exports}/{name}.csv", schema)
        bad, seen = F.col(REASONS).isNotNull(), Observation()
        counted = rows.observe(
            seen, F.count(F.lit(1)).alias("n_read"), F.count_if(bad).alias("n_rejected")
        )
        rejected = counted.where(bad).select(F.col(REASONS).alias("reasons"), F.col("_row").alias("row"), F.col("_file").alias("file"))
        rejected.write.mode("overwrite").parquet(f"{folder}/{name}")
        counts.append((name, seen.get["n_read"], seen.get["n_rejected"]))
        good[name] = rows.where(~bad).select(*schema.names)
    record = spark.createDataFrame(counts, "table_name string, n_read long, n_rejected long")
    record.write.mode("overwrite").parquet(f"{folder}/_counts")
    over = [f"{name}: {bad} of {read}" for name, read, bad in counts if bad > max_share * read]
    if over:
        raise ValueError(f"too many malformed rows, see {folder}: {', '.join(over)}")
    return RetailTables(**good, unique_order_ids=check_order_ids)


def write_csv(df: DataFrame, folder: str) -> None:
    """Header CSV, one file per partition."""
    df.write.mode("overwrite").option("header", True).csv(folder)


def export_tables_csv(tables: RetailTables, folder: str) -> None:
    for name, frame in tables.base().items():
        write_csv(frame, f"{folder}/{name}.csv")


def export_predictions(predictions: DataFrame, folder: str) -> None:
    """Churn scores with the three exported columns."""
    write_csv(
        predictions.select("customer_id", "churn_probability", "predicted_segment"), folder
    )
