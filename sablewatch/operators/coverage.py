"""ATT&CK coverage: what rules claim against what alerts observed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sablewatch.constants import TACTICS, TECHNIQUES, UNMAPPED_TACTIC
from sablewatch.functions.columns import severity_rank, strings_or_empty
from sablewatch.plans.rule_catalog import Rule


def technique_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TECHNIQUES), "technique string, name string, tactic string")


def claim_rows(rules: Sequence[Rule]) -> list[tuple[str, str, str, str]]:
    return [(t, r.id, r.name, r.severity) for r in rules if r.enabled for t in r.mitre]


def claims_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """One row per technique an enabled rule claims (bounded by the rule list)."""
    rows = spark.createDataFrame(
        claim_rows(rules), "technique string, rule_id string, rule_name string, severity string"
    )
    return rows.groupBy("technique").agg(
        F.array_sort(F.collect_list(F.struct("rule_id", "rule_name", "severity"))).alias("rules"),
        F.count("*").alias("rule_count"),
    )


def unmapped_techniques(rules: Sequence[Rule]) -> list[str]:
    known = {t for t, _, _ in TECHNIQUES}
    return sorted({t for t, *_ in claim_rows(rules)} - known)


def technique_hits(alerts: DataFrame) -> DataFrame:
    """Per technique: alerts, summed hits, newest time, worst severity."""
    return (
        alerts.select(
            F.explode(strings_or_empty("mitre")).alias("technique"),
            "hit_count",
            "last_seen",
            "severity",
        )
        .groupBy("technique")
        .agg(
            F.count("*").alias("alerts"),
            F.coalesce(F.sum("hit_count"), F.lit(0)).cast("bigint").alias("hits"),
            F.max("last_seen").alias("last_seen"),
            F.max_by("severity", severity_rank("severity")).alias("worst_severity"),
        )
    )


def coverage(alerts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Claims full-outer observed, in kill-chain order."""
    spark = alerts.sparkSession
    joined = claims_table(spark, rules).join(technique_hits(alerts), "technique", "full_outer")
    chain = F.array(*[F.lit(t) for t in TACTICS])
    tactic = F.coalesce("tactic", F.lit(UNMAPPED_TACTIC))
    position = F.array_position(chain, tactic)
    return (
        joined.join(F.broadcast(technique_table(spark)), "technique", "left")
        .select(
            "technique",
            F.coalesce("name", "technique").alias("name"),
            tactic.alias("tactic"),
            F.coalesce("rules", F.array().cast("array<struct<rule_id:string,rule_name:string,severity:string>>")).alias("rules"),
            F.coalesce("rule_count", F.lit(0)).alias("rule_count"),
            F.coalesce("alerts", F.lit(0)).alias("alerts"),
            F.coalesce("hits", F.lit(0)).alias("hits"),
            "worst_severity",
            "last_seen",
            F.when(F.col("rule_count").isNull(), "orphaned")
            .when(F.col("alerts").isNull(), "rule-only")
            .otherwise("observed")
            .alias("status"),
            F.when(position > 0, position - 1).otherwise(len(TACTICS)).alias("tactic_order"),
        )
        .orderBy("tactic_order", "technique")
    )


def coverage_totals(report: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    is_ = lambda s: F.count_if(F.col("status") == s)
    claimed = F.count_if(F.col("rule_count") > 0)
    return report.agg(
        claimed.alias("techniques_claimed"),
        is_("observed").alias("techniques_observed"),
        is_("rule-only").alias("techniques_rule_only"),
        is_("orphaned").alias("techniques_orphaned"),
        F.lit(sum(r.enabled for r in rules)).cast("bigint").alias("rules_enabled"),
        F.coalesce(F.bround(F.try_divide(is_("observed"), claimed), 3), F.lit(0.0)).alias(
            "observed_share"
        ),
    )
