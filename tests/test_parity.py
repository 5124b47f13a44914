"""Every query that SQL can express, against DuckDB on the same files."""

from __future__ import annotations

import pytest

from martlens.plans import catalog, sql_checks
from tests.parity import connect, spark_rows, sql_rows

STATEMENTS = sql_checks.statements()
QUERIES = catalog.queries()


@pytest.fixture(scope="module")
def con(sample_dir):
    return connect(sample_dir)


def test_every_statement_has_a_query():
    assert set(STATEMENTS) <= set(QUERIES)
    assert set(QUERIES) - set(STATEMENTS) == {
        "rf_train_metrics",
        "cv_auc",
        "feature_importance",
        "churn_predictions",
    }


SQL_TYPES = {
    "string": "VARCHAR",
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "date": "DATE",
    "boolean": "BOOLEAN",
}


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_types_match_sql(spark, sample_dir, con, name):
    ours = {c: SQL_TYPES[t] for c, t in QUERIES[name](spark, sample_dir).dtypes}
    described = con.execute(f"DESCRIBE {STATEMENTS[name]}").fetchall()
    assert ours == {row[0]: row[1] for row in described}


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_matches_sql(spark, sample_dir, con, name):
    columns, rows = spark_rows(QUERIES[name](spark, sample_dir))
    expected_columns, expected = sql_rows(con, STATEMENTS[name])
    assert columns == expected_columns
    assert len(rows) == len(expected)
    assert rows == expected
    assert rows
