"""Alert store operations: merge, triage, notification choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sablewatch.constants import SEVERITY_RANK
from sablewatch.functions.columns import severities_from, severity_rank, since

ALERT_STATUSES = ("new", "acknowledged", "investigating", "resolved", "false_positive")
NOTIFY_PER_RUN = 8


def merge_alerts(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The next snapshot of the alert table; merging twice changes nothing.

    The newer run supplies evidence, severity and title; the span widens, the
    hit count only rises; identity and triage fields stay with the stored row.
    """
    old, new = stored.alias("old"), incoming.alias("new")
    joined = old.join(new, F.col("old.dedupe_key") == F.col("new.dedupe_key"), "full_outer")
    newer = {"evidence", "severity", "title"}
    fold = {"hit_count": F.greatest, "first_seen": F.least, "last_seen": F.greatest}

    def column(name: str) -> Column:
        o, n = F.col(f"old.{name}"), F.col(f"new.{name}")
        if name in fold:
            return fold[name](o, n)
        return F.coalesce(n, o) if name in newer else F.when(
            F.col("old.dedupe_key").isNotNull(), o
        ).otherwise(n)

    return joined.select(*[column(c).alias(c) for c in stored.columns])


def new_alerts(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Alerts whose key was never stored: the ones to announce."""
    return incoming.join(stored.select("dedupe_key"), "dedupe_key", "left_anti").select(
        *incoming.columns
    )


def list_alerts(
    alerts: DataFrame,
    *,
    status: str | None = None,
    min_severity: str | None = None,
    rule_id: str | None = None,
    src_ip: str | None = None,
    hours: float | None = None,
    as_of: Column | None = None,
) -> DataFrame:
    """Matching alerts; page with ``search.page``."""
    out = alerts
    if status:
        out = out.filter(F.col("status") == status)
    if min_severity:
        out = out.filter(F.col("severity").isin(severities_from(min_severity)))
    if rule_id:
        out = out.filter(F.col("rule_id") == rule_id)
    if src_ip:
        out = out.filter(F.col("src_ip") == src_ip)
    return since(out, hours, as_of, "last_seen")


def apply_triage(alerts: DataFrame, updates: DataFrame) -> DataFrame:
    """Overlay ``updates(alert_id, status, notes, updated_at)``, latest wins.

    A null note leaves the stored note alone; evidence is never touched.
    """
    latest = updates.groupBy("alert_id").agg(
        F.max_by("status", "updated_at").alias("_status"),
        F.max_by("notes", F.when(F.col("notes").isNotNull(), F.col("updated_at"))).alias("_notes"),
    )
    return (
        alerts.join(latest, "alert_id", "left")
        .withColumn("status", F.coalesce("_status", "status"))
        .withColumn("notes", F.coalesce("_notes", "notes"))
        .select(*alerts.columns)
    )


def hits_by_rule(alerts: DataFrame) -> DataFrame:
    return (
        alerts.groupBy("rule_id")
        .agg(
            F.max("rule_name").alias("rule_name"),
            F.coalesce(F.sum("hit_count"), F.lit(0)).cast("bigint").alias("hits"),
        )
        .orderBy(F.desc("hits"), "rule_id")
    )


def counts_by_severity(alerts: DataFrame) -> DataFrame:
    """All five levels, zero where nothing fired."""
    spark = alerts.sparkSession
    levels = spark.createDataFrame(list(SEVERITY_RANK.items()), "severity string, rank int")
    counts = alerts.groupBy("severity").agg(F.count("*").alias("alerts"))
    return (
        levels.join(counts, "severity", "left")
        .select("severity", "rank", F.coalesce("alerts", F.lit(0)).alias("alerts"))
        .orderBy(F.desc("rank"))
    )


def choose_notifications(
    alerts: DataFrame, min_severity: str = "high", per_run: int = NOTIFY_PER_RUN
) -> DataFrame:
    """The most severe ``per_run`` alerts and how many more there were.

    ``alerts`` are the new ones of a run. The limit is a top-k sort; the total
    is a scalar subquery over the same filter.
    """
    eligible = alerts.filter(F.col("severity").isin(severities_from(min_severity)))
    total = eligible.agg(F.count("*")).scalar()
    ranked = eligible.orderBy(
        F.desc(severity_rank("severity")), F.desc("last_seen"), "dedupe_key"
    ).limit(per_run)
    order = W.orderBy(F.desc(severity_rank("severity")), F.desc("last_seen"), "dedupe_key")
    # At most per_run rows reach this window.
    return ranked.withColumn("position", F.row_number().over(order)).withColumn(
        "overflow", F.greatest(total - per_run, F.lit(0))
    )
