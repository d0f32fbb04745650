"""The detection run: window, rules, merge, what is new."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sablewatch.functions.columns import since
from sablewatch.operators.alerts import merge_alerts, new_alerts
from sablewatch.operators.rules import evaluate_rules
from sablewatch.plans.rule_catalog import Rule


@dataclass(frozen=True)
class DetectionRun:
    alerts: DataFrame  # of this run
    snapshot: DataFrame  # the next alert table
    created: DataFrame  # alerts never stored before
    counts: DataFrame  # one row


def run_detection(
    events: DataFrame,
    rules: Sequence[Rule],
    stored: DataFrame | None = None,
    hours: float = 24,
    as_of: Column | None = None,
) -> DetectionRun:
    """Evaluate the last ``hours`` and merge into the stored alerts; idempotent."""
    window = since(events, hours, as_of)
    alerts = evaluate_rules(window, rules)
    snapshot = merge_alerts(stored, alerts) if stored is not None else alerts
    created = new_alerts(stored, alerts) if stored is not None else alerts
    made = created.agg(F.count("*")).scalar()
    counts = window.agg(F.count("*").alias("events_evaluated")).select(
        "events_evaluated",
        F.lit(sum(r.enabled for r in rules)).cast("bigint").alias("rules_evaluated"),
        alerts.agg(F.count("*")).scalar().alias("alerts_generated"),
        made.alias("alerts_created"),
        (alerts.agg(F.count("*")).scalar() - made).alias("alerts_updated"),
        F.lit(float(hours)).alias("window_hours"),
    )
    return DetectionRun(alerts, snapshot, created, counts)
