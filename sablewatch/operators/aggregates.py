"""Grouped statistics over events: counters, breakdowns, top values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sablewatch.functions.columns import has_text
from sablewatch.functions.topk import first_k, ranked_list


def credential_pair() -> Column:
    return F.concat(
        F.coalesce("username", F.lit("")), F.lit(":"), F.coalesce("password", F.lit(""))
    )


def summary_counters(events: DataFrame) -> DataFrame:
    """Headline numbers in one pass; an empty table gives zeros."""
    is_auth = F.col("event_type") == "auth_attempt"
    return events.agg(
        F.count("*").alias("total_events"),
        F.count_distinct("src_ip").alias("unique_sources"),
        F.count_distinct("country").alias("unique_countries"),
        F.count_if(is_auth).alias("auth_attempts"),
        F.count_if(F.col("event_type") == "command").alias("commands_run"),
        F.count_distinct(F.when(is_auth, credential_pair())).alias("unique_credential_pairs"),
    )


def overview(events: DataFrame, sessions: DataFrame, alerts: DataFrame) -> DataFrame:
    """:func:`summary_counters` plus session and open-alert counts, one row."""
    is_open = F.col("status") == "new"
    return summary_counters(events).select(
        "*",
        sessions.agg(F.count("*")).scalar().alias("sessions"),
        alerts.agg(F.count_if(is_open)).scalar().alias("open_alerts"),
        alerts.agg(F.count_if(is_open & F.col("severity").isin("high", "critical")))
        .scalar()
        .alias("critical_alerts"),
    )


def service_breakdown(events: DataFrame) -> DataFrame:
    return (
        events.groupBy("service")
        .agg(F.count("*").alias("events"), F.count_distinct("src_ip").alias("sources"))
        .orderBy(F.desc("events"), "service")
    )


def top_dimension(events: DataFrame, key: str, name: str, limit: int) -> DataFrame:
    """Top countries or networks: ``key, name, events, sources``."""
    return (
        events.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            F.max(name).alias(name),
            F.count("*").alias("events"),
            F.count_distinct("src_ip").alias("sources"),
        )
        .orderBy(F.desc("events"), key)
        .limit(limit)
    )


def top_countries(events: DataFrame, limit: int = 50) -> DataFrame:
    return top_dimension(events, "country", "country_name", limit)


def top_networks(events: DataFrame, limit: int = 20) -> DataFrame:
    return top_dimension(events, "asn", "as_org", limit)


def credential_pairs(events: DataFrame, limit: int = 100) -> DataFrame:
    return (
        events.filter((F.col("event_type") == "auth_attempt") & F.col("username").isNotNull())
        .groupBy("username", "password")
        .agg(F.count("*").alias("attempts"))
        .orderBy(F.desc("attempts"), "username", F.asc_nulls_first("password"))
        .limit(limit)
    )


TOP_FIELDS = {
    "usernames": "username",
    "passwords": "password",
    "paths": "path",
    "commands": "command",
    "user_agents": "user_agent",
}


def top_values(events: DataFrame, field: str, limit: int = 20) -> DataFrame:
    """Most frequent non-empty values of one of :data:`TOP_FIELDS`."""
    column = TOP_FIELDS.get(field, field)
    if column not in events.columns:
        raise ValueError(f"cannot rank by {field!r}")
    return (
        events.filter(has_text(column))
        .groupBy(F.col(column).alias("value"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "value")
        .limit(limit)
    )


def top_values_per_group(df: DataFrame, key: str, column: str, k: int = 10) -> DataFrame:
    """``key, rank, value, n``: the ``k`` most frequent values of each group.

    Counting combines map-side, and the rank is cut to ``k`` rows per task
    before its shuffle, so neither step gathers a hot group.
    """
    counts = (
        df.filter(has_text(column))
        .groupBy(key, F.col(column).alias("value"))
        .agg(F.count("*").alias("n"))
    )
    return first_k(counts, [key], [F.desc("n"), F.col("value")], k, rank="rank")


def top_lists_per_group(df: DataFrame, key: str, column: str, out: str, k: int = 10) -> DataFrame:
    return (
        top_values_per_group(df, key, column, k)
        .groupBy(key)
        .agg(ranked_list(F.col("value"), "rank").alias(out))
    )


def health(events: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Row count, newest time, and how stale it is in seconds."""
    row = events.agg(F.count("*").alias("events"), F.max("ts").alias("newest"))
    anchor = as_of if as_of is not None else F.col("newest")
    return row.withColumn(
        "stale_seconds", F.unix_timestamp(anchor) - F.unix_timestamp(F.col("newest"))
    )
