"""One customer, order, product or amount, or copies of one order, hold a third of the rows."""

from __future__ import annotations

import os

import duckdb
import pytest

from martlens.plans import catalog, sql_checks
from tests.parity import connect, spark_rows, sql_rows

SMALL = "/root/testdata/sf0.001"
FILES = 8
QUERIES = catalog.queries()
STATEMENTS = sql_checks.statements()


def write_skewed(folder, copies: int) -> str:
    con = duckdb.connect()
    changed = {
        "orders": """* REPLACE (
            CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE o_custkey END AS o_custkey,
            CASE WHEN o_orderkey % 3 = 1 THEN 500.0 ELSE o_totalprice END AS o_totalprice)""",
        "lineitem": """* REPLACE (
            CASE WHEN l_linenumber % 3 = 0 THEN 3 ELSE l_orderkey END AS l_orderkey,
            CASE WHEN l_linenumber % 3 = 1 THEN 5 ELSE l_partkey END AS l_partkey)""",
    }
    for name in ("region", "nation", "customer", "part"):
        con.sql(f"COPY (FROM '{SMALL}/{name}.parquet') TO '{folder}/{name}.parquet'")
    for name, columns in changed.items():
        # Several files: a hot partition is split between the tasks that fed it.
        (folder / f"{name}.parquet").mkdir()
        for part in range(FILES):
            con.sql(
                f"COPY (SELECT {columns} FROM read_parquet('{SMALL}/{name}.parquet') "
                f"WHERE file_row_number % {FILES} = {part}) "
                f"TO '{folder}/{name}.parquet/{part}.parquet'"
            )
    if copies:
        con.sql(
            f"COPY (SELECT o.* FROM '{folder}/orders.parquet/*.parquet' o, range({copies}) "
            f"WHERE o_orderkey = 4) TO '{folder}/orders.parquet/copies.parquet'"
        )
    return str(folder)


@pytest.fixture(scope="module")
def skewed_dir(tmp_path_factory):
    if not os.path.isdir(SMALL):
        pytest.skip("sample tables are not available")
    return write_skewed(tmp_path_factory.mktemp("skewed"), copies=0)


@pytest.fixture(scope="module")
def copied_dir(tmp_path_factory):
    if not os.path.isdir(SMALL):
        pytest.skip("sample tables are not available")
    return write_skewed(tmp_path_factory.mktemp("copied"), copies=750)


@pytest.fixture(scope="module")
def eager_splitting(spark):
    """Thresholds low enough for the adaptive skew join to act on small files."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1b",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
        "spark.sql.files.maxPartitionBytes": "16k",
        "spark.sql.files.openCostInBytes": "16k",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_skewed_tables_match_sql(eager_splitting, skewed_dir, name):
    found = spark_rows(QUERIES[name](eager_splitting, skewed_dir))
    assert found == sql_rows(connect(skewed_dir), STATEMENTS[name])


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_repeated_order_ids_match_sql(eager_splitting, copied_dir, name):
    """A third of the orders are copies of one: nothing may rely on unique ids."""
    assert not catalog.open_tables(eager_splitting, copied_dir).unique_order_ids
    found = spark_rows(QUERIES[name](eager_splitting, copied_dir))
    assert found == sql_rows(connect(copied_dir), STATEMENTS[name])


@pytest.mark.parametrize("name", ["category_mix", "top_products", "revenue_by_region"])
def test_hot_join_partitions_are_split(eager_splitting, copied_dir, name):
    df = QUERIES[name](eager_splitting, copied_dir)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString()
    assert "isSkew=true" in final or "skew=true" in final
