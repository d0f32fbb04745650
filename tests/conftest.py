from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make_events(spark):
    """Events from dicts; unnamed columns get plain defaults."""
    from sablewatch.schemas import EVENT, conform_events

    def build(rows):
        full = []
        for i, row in enumerate(rows):
            base = {
                "event_id": f"e{i:05d}", "ts": START, "service": "ssh",
                "event_type": "auth_attempt", "severity": "medium", "src_ip": "192.0.2.10",
                "tags": [], "threat_tags": [], "extra": {}, **row,
            }
            full.append(tuple(base.get(f.name) for f in EVENT.fields))
        return conform_events(spark.createDataFrame(full, EVENT))

    return build
