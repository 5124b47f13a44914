"""Readers for CSV exports and published Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlens.sources import snapshots
from martlens.sources.schemas import (
    BASE_SCHEMAS, CHURN_PREDICTIONS, FIRST_PART, MONTH_PARTITION, ORDER_PART,
)
from martlens.sources.tables import RetailTables, check_order_ids

CONSTRAINTS, ORPHANS = "_checked_keys", "_orphan_keys"
BROKEN, REASONS = "_broken_line", "_reasons"


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Header CSV whose columns are found by name and converted by a schema.

    Only the header is read ahead; there is no inference pass over the data.
    Columns may come in any order, and further ones are left out. A missing
    column, or files whose headers differ, stop the read. So does a value that
    does not fit its type exactly: ``3.0`` is an integer, ``3.5`` is not, and
    money with more decimals than the column has is not rounded.
    """
    rows = (
        spark.read.option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(path)
    )
    missing = [field.name for field in schema if field.name not in rows.columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return rows.select(*[_exact(field) for field in schema])


def _converted(field: T.StructField) -> tuple[Column, Column]:
    """A text column in the type of ``field``, and whether it fits that type exactly."""
    value, kind = F.trim(F.col(field.name)), field.dataType
    if isinstance(kind, T.IntegerType):
        fits = value.rlike(r"^[+-]?[0-9]+(\.0*)?$")
        number = value.try_cast("decimal(20,6)").try_cast(kind)
    elif isinstance(kind, T.DecimalType):
        fits = value.rlike(rf"^[+-]?[0-9]*(\.[0-9]{{0,{kind.scale}}}0*)?$")
        number = value.try_cast(kind)
    elif isinstance(kind, T.DateType):
        fits = value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
        number = value.try_cast(kind)
    elif isinstance(kind, T.StringType):
        return F.col(field.name), F.lit(True)
    else:
        fits, number = F.lit(True), value.try_cast(kind)
    return number, value.isNull() | (fits & number.isNotNull())


def _wrong(field: T.StructField) -> Column:
    return F.concat(F.lit(f"MALFORMED value of {field.name}: "), F.trim(F.col(field.name)))


def _exact(field: T.StructField) -> Column:
    """A text column in the type of ``field``; other values raise an error."""
    number, good = _converted(field)
    if isinstance(field.dataType, T.StringType):
        return number.alias(field.name)
    return F.when(good, number).otherwise(F.raise_error(_wrong(field)).cast(field.dataType)).alias(field.name)


def read_csv_checked(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows as :func:`read_csv` gives them, and for rows it would stop at, why.

    Columns: those of ``schema``, ``_reasons`` (null for good rows), ``_row`` (the line
    where it has another number of values than the header, else its values as JSON)
    and ``_file``. Missing columns and files with differing headers still stop the read.
    """
    header = spark.read.option("header", True).csv(path).columns
    missing = [field.name for field in schema if field.name not in header]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    texts = T.StructType([T.StructField(name, T.StringType()) for name in [*header, BROKEN]])
    rows = (
        spark.read.schema(texts)
        .option("header", True)
        .option("enforceSchema", False)
        .option("columnPruning", False)  # or lines of a wrong length go unnoticed
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", BROKEN)
        .csv(path)
    )
    converted = [(field, *_converted(field)) for field in schema]
    reasons = F.array_compact(
        F.array(*[F.when(~good, F.coalesce(_wrong(field), F.lit(field.name))) for field, _, good in converted])
    )
    broken = F.col(BROKEN).isNotNull()
    reasons = F.when(broken, F.array(F.lit("MALFORMED line"))).when(F.size(reasons) > 0, reasons)
    whole = F.to_json(F.struct(*[F.col(name) for name in header]))
    return rows.select(
        *[number.alias(field.name) for field, number, _ in converted],
        reasons.alias(REASONS),
        F.when(reasons.isNotNull(), F.when(broken, F.col(BROKEN)).otherwise(whole)).alias("_row"),
        F.col("_metadata.file_path").alias("_file"),
    )


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Exported churn predictions."""
    return read_csv(spark, path, CHURN_PREDICTIONS)


def read_csv_tables(
    spark: SparkSession, folder: str, predictions: str | None = None
) -> RetailTables:
    """The four base tables, and optionally exported predictions, from CSV."""
    frames = {
        name: read_csv(spark, f"{folder}/{name}.csv", schema)
        for name, schema in BASE_SCHEMAS.items()
    }
    scores = read_predictions(spark, predictions) if predictions else None
    return RetailTables(
        **frames, churn_predictions=scores, unique_order_ids=check_order_ids
    )


def published_frames(
    spark: SparkSession, folder: str, parts: snapshots.Parts
) -> dict[str, DataFrame]:
    """The four base tables that a version consists of."""
    frames = {
        name: snapshots.read_whole(spark, folder, name, parts)
        for name in BASE_SCHEMAS if name != "orders"
    }
    frames["orders"] = snapshots.read_by(
        spark, folder, "orders", parts, MONTH_PARTITION, BASE_SCHEMAS["orders"]
    )
    return frames


def read_published(
    spark: SparkSession, folder: str, predictions: str | None = None,
    version: int | None = None,
) -> RetailTables:
    """A version written by :func:`martlens.sources.sinks.publish`, by default the last.

    The tables hold on to that version, whatever is published later. Order ids count
    as unique if publishing found neither repeats nor nulls.
    """
    record = snapshots.read_version(spark, folder, version)
    if record is None:
        raise FileNotFoundError(f"no published tables in {folder}")
    parts = record["parts"]
    checks = {
        name: snapshots.read_whole(spark, folder, name, parts) for name in (CONSTRAINTS, ORPHANS)
    }
    scores = read_predictions(spark, predictions) if predictions else None
    return RetailTables(
        **published_frames(spark, folder, parts), churn_predictions=scores,
        unique_order_ids=ids_are_unique(checks[CONSTRAINTS]), checks=checks,
    )


def ids_are_unique(checks: DataFrame) -> bool:
    """Whether the recorded key checks found neither repeated nor null order ids."""
    orders = checks.where("table_name = 'orders'").first()
    return orders is not None and orders.duplicate_keys == 0 and orders.null_keys == 0


def read_catalog_tables(
    spark: SparkSession, database: str, predictions: str | None = None
) -> RetailTables:
    """Tables saved by :func:`martlens.sources.sinks.publish_bucketed`."""
    frames = {name: spark.table(f"{database}.{name}") for name in BASE_SCHEMAS}
    dealt = None
    if ORDER_PART in frames["orders"].columns:
        dealt = frames["orders"], frames["order_items"]
        frames["orders"] = dealt[0].where(FIRST_PART).drop(ORDER_PART, FIRST_PART)
        frames["order_items"] = dealt[1].drop(ORDER_PART)
    record = f"{database}.{CONSTRAINTS}"
    clean = spark.catalog.tableExists(record) and ids_are_unique(spark.table(record))
    scores = read_predictions(spark, predictions) if predictions else None
    return RetailTables(**frames, churn_predictions=scores, unique_order_ids=clean, dealt=dealt)
