"""Versions of tables in a folder: the data first, one small record last.

A part of a table is a folder ``publish=<name>`` that is written once and never
changed, below the table or below a month of it. A version is a record that says
which part stands for each table and month. It appears under its number in one
step, so a reader finds the old version or the new one and nothing between, and a
write that stops half-way leaves parts that no record names. Parts that several
versions share are written once. One process writes to a folder at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlens.session import hadoop_path, remove_folder

RECORDS = "_versions"
PART = "publish"
WHOLE = ""  # the only part of a table that is not split by month
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"  # Spark's folder name for null

# Part names of a version by table and month.
Parts = dict[str, dict[str, str]]


def versions(spark: SparkSession, folder: str) -> list[int]:
    path, system = hadoop_path(spark, f"{folder}/{RECORDS}")
    if not system.exists(path):
        return []
    names = [status.getPath().getName() for status in system.listStatus(path)]
    return sorted(int(name) for name in names if name.isdigit())


def read_version(spark: SparkSession, folder: str, number: int | None = None) -> dict | None:
    """The record of a version, the latest by default; None if there is none."""
    known = versions(spark, folder)
    if not known or (number is not None and number not in known):
        return None
    path, system = hadoop_path(spark, _record(folder, known[-1] if number is None else number))
    stream = system.open(path)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def record_version(spark: SparkSession, folder: str, parts: Parts, **notes) -> int:
    """Make ``parts`` the latest version; the record is renamed into its place."""
    number = (versions(spark, folder) or [0])[-1] + 1
    draft, system = hadoop_path(spark, f"{folder}/{RECORDS}/.draft-{uuid.uuid4().hex}")
    final, _ = hadoop_path(spark, _record(folder, number))
    stream = system.create(draft, False)
    stream.write(bytearray(json.dumps({"version": number, "parts": parts, **notes}).encode()))
    stream.close()
    if system.exists(final) or not system.rename(draft, final):
        raise RuntimeError(f"version {number} of {folder} was written by somebody else")
    return number


def _record(folder: str, number: int) -> str:
    return f"{folder}/{RECORDS}/{number:012}"


def write_whole(df: DataFrame, folder: str, table: str) -> dict[str, str]:
    """Write a table as one new part."""
    name = uuid.uuid4().hex
    df.write.parquet(f"{folder}/{table}/{PART}={name}")
    return {WHOLE: name}


def write_by(df: DataFrame, folder: str, table: str, column: str) -> dict[str, str]:
    """Write a new part below each value of ``column``, and say which there are."""
    name = uuid.uuid4().hex
    rows = df.withColumn(PART, F.lit(name))
    rows.write.mode("append").partitionBy(column, PART).parquet(f"{folder}/{table}")
    path, system = hadoop_path(df.sparkSession, f"{folder}/{table}/{column}=*/{PART}={name}")
    found = [status.getPath().getParent().getName() for status in system.globStatus(path)]
    return {value.split("=", 1)[1]: name for value in found}


def read_whole(spark: SparkSession, folder: str, table: str, parts: Parts) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}/{PART}={parts[table][WHOLE]}")


def read_by(
    spark: SparkSession, folder: str, table: str, parts: Parts, column: str, schema: T.StructType
) -> DataFrame:
    """The parts of a table; ``column`` comes from their folders and prunes them."""
    kept = [f for f in schema.fields if f.name not in (column, PART)]
    # Without a type, values such as 2024-01 would be read back as dates.
    folders = [T.StructField(column, T.StringType()), T.StructField(PART, T.StringType())]
    paths = [
        f"{folder}/{table}/{column}={value}/{PART}={name}" for value, name in parts[table].items()
    ]
    if not paths:
        return spark.createDataFrame([], T.StructType([*kept, folders[0]]))
    reader = spark.read.schema(T.StructType([*kept, *folders]))
    return reader.option("basePath", f"{folder}/{table}").parquet(*paths).drop(PART)


def drop_old(spark: SparkSession, folder: str, keep: int) -> None:
    """Forget all but the last ``keep`` versions, and delete parts only they name."""
    known = versions(spark, folder)
    kept: set[tuple[str, str]] = set()
    for number in known[-keep:]:
        record = read_version(spark, folder, number)
        kept |= {(t, name) for t, by in record["parts"].items() for name in by.values()}
    for number in known[:-keep]:
        remove_folder(spark, _record(folder, number))
    path, system = hadoop_path(spark, folder)
    for table in system.listStatus(path):
        name = table.getPath().getName()
        if name == RECORDS or not table.isDirectory():
            continue
        for pattern in (f"{PART}=*", f"*/{PART}=*"):
            below, _ = hadoop_path(spark, f"{folder}/{name}/{pattern}")
            for part in system.globStatus(below) or []:
                if (name, part.getPath().getName().split("=", 1)[1]) not in kept:
                    system.delete(part.getPath(), True)
