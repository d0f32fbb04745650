"""Registered queries against their SQL at the smallest scale.

A representative set runs by default; ``ALL_ORACLES=1`` runs every query.
"""

from __future__ import annotations

import os
from pathlib import Path

import pytest

import __spark_entry__ as entry
from sablewatch.catalog import load_catalog
from tests.check_oracles import compare, connect

SF_DIR = "/root/testdata/sf0.001"
DEFAULT = ("sliding_threshold", "sliding_distinct", "rules_one_pass", "alert_merge",
           "summary_counters", "timeseries_filled", "session_build", "source_scores",
           "enrich_events", "http_tags", "document_iocs", "stream_hourly_counts")
NAMES = sorted(entry.queries()) if os.environ.get("ALL_ORACLES") else DEFAULT


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    ok, note, _ = compare(con, spark, name, entry.queries()[name], entry.oracle_sql().get(name),
                          SF_DIR)
    assert ok, note


def test_every_query_has_an_oracle():
    found, sql = load_catalog()
    assert set(found) == set(sql)
    assert set(sql) <= set(entry.oracle_sql()) and set(found) <= set(entry.queries())


def test_corpus_queries_without_sql_are_tested():
    """The modules of those that SQL cannot express are used by a test of their folder."""
    tests = "\n".join(p.read_text() for p in (Path(__file__).parent / "llm").glob("test_*.py"))
    found = entry.queries()
    for name in set(found) - set(entry.oracle_sql()):
        assert found[name].__module__.rpartition(".")[2] in tests, name


def test_flagship(spark):
    assert entry.entry(spark).limit(1).count() == 1
