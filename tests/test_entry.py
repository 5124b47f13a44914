from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry_point


def test_contract(spark):
    if not os.path.isdir(entry_point.SMOKE_FOLDER):
        pytest.skip("sample tables are not available")
    df = entry_point.entry(spark)
    assert df.columns[0] == "customer_id" and df.count() > 0
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_shared_folder_comes_from_the_session(spark):
    from martlens.session import shared_folder

    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
