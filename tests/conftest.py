from __future__ import annotations

import json
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from martlens.session import drop_written, local_session  # noqa: E402

SAMPLE = os.environ.get("MARTLENS_SAMPLE_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    root = tmp_path_factory.mktemp("spark")
    (root / "events").mkdir()
    session = local_session(
        "martlens-tests",
        **{
            "spark.checkpoint.dir": str(root / "checkpoints"),
            "spark.sql.warehouse.dir": str(root / "warehouse"),
            "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
            "spark.eventLog.enabled": "true",
            "spark.eventLog.dir": f"file://{root}/events",
            "spark.eventLog.compress": "false",
            "spark.eventLog.rolling.enabled": "false",
        },
    )
    yield session
    drop_written(session)
    session.stop()


@pytest.fixture(scope="session")
def sample_dir():
    if not os.path.isdir(SAMPLE):
        pytest.skip("sample tables are not available")
    return SAMPLE


@pytest.fixture
def executed_plans(spark):
    """Physical plans of the queries that run while a test asks for them."""
    folder = spark.conf.get("spark.eventLog.dir").removeprefix("file://")

    def plans() -> dict[int, str]:
        found = {}
        for name in os.listdir(folder):
            with open(os.path.join(folder, name)) as lines:
                for line in lines:
                    if "SparkListenerSQLExecutionStart" in line:
                        event = json.loads(line)
                        found[event["executionId"]] = event["physicalPlanDescription"]
        return found

    before = set(plans())
    return lambda: [plan for number, plan in plans().items() if number not in before]
