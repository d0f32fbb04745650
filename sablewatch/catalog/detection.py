"""Detection, alert and coverage queries."""

from __future__ import annotations

from dataclasses import replace
from functools import lru_cache

from pyspark.sql import functions as F

from sablewatch.catalog.adapter import events, sql
from sablewatch.catalog.registry import query
from sablewatch.functions.columns import micros
from sablewatch.operators import alerts as A
from sablewatch.operators import coverage as C
from sablewatch.operators.rules import condition, evaluate_rules, fired_spans
from sablewatch.operators.search import page
from sablewatch.plans.detection import run_detection
from sablewatch.plans.rule_catalog import SHIPPED_RULES, Rule

DAY = 1440

# The fixture has a few events per source and day, so windows are days here.
COUNT = Rule("busy_source", "Busy source", "medium", "threshold", window_minutes=DAY, threshold=8)
DISTINCT = Rule("many_services", "Many services", "medium", "distinct", window_minutes=DAY,
                distinct_field="service", threshold=5)
MATCH = Rule("fetch", "Fetch", "critical", "match", where={"tags__in_tags": "payload-fetch"})
RATIO = Rule("login_heavy", "Login heavy", "low", "ratio", threshold=0.45,
             numerator_where={"event_type": ["auth_attempt", "auth_success"]})


@lru_cache
def fixture_rules() -> tuple[Rule, ...]:
    """The shipped rules with windows and thresholds that fit the fixture's rate."""
    need = {"threshold": 3, "distinct": 3}
    return tuple(
        replace(r, window_minutes=3 * DAY, threshold=need[r.type]) if r.type in need else r
        for r in SHIPPED_RULES
    )


def _span_rows(df):
    return df.select(
        "rule_id", "key", "observed", F.col("span_lo").alias("lo"), F.col("span_hi").alias("hi")
    )


def count_sql(rule_id: str, key: str, where: str, minutes: int, threshold: float) -> str:
    return f"""
      SELECT '{rule_id}' AS rule_id, CAST(key AS VARCHAR) AS key,
             CAST(max(n) AS DOUBLE) AS observed, min(us) FILTER (n = top) AS hi, {minutes} AS win
      FROM (SELECT *, max(n) OVER (PARTITION BY key) AS top FROM (
        SELECT {key} AS key, epoch_us(ts) AS us,
          count(*) OVER (PARTITION BY {key} ORDER BY epoch_us(ts)
            RANGE BETWEEN {minutes * 60000000} PRECEDING AND CURRENT ROW) AS n
        FROM ev WHERE ({where}) AND {key} IS NOT NULL))
      GROUP BY key HAVING max(n) >= {threshold}"""


def distinct_sql(rule_id, key, value, where, minutes, threshold) -> str:
    return f"""
      SELECT '{rule_id}' AS rule_id, CAST(key AS VARCHAR) AS key,
             CAST(max(n) AS DOUBLE) AS observed, min(us) FILTER (n = top) AS hi, {minutes} AS win
      FROM (SELECT *, max(n) OVER (PARTITION BY key) AS top FROM (
        SELECT a.key, a.us, count(DISTINCT b.v) AS n
        FROM (SELECT {key} AS key, epoch_us(ts) AS us FROM ev WHERE {where}) a
        JOIN (SELECT {key} AS key, epoch_us(ts) AS us, {value} AS v FROM ev WHERE {where}) b
          ON a.key = b.key AND b.us BETWEEN a.us - {minutes * 60000000} AND a.us
        WHERE b.v IS NOT NULL
        GROUP BY a.key, a.us))
      GROUP BY key HAVING max(n) >= {threshold}"""


def match_sql(rule_id, key, where) -> str:
    return f"""
      SELECT '{rule_id}' AS rule_id, CAST({key} AS VARCHAR) AS key,
             CAST(count(*) AS DOUBLE) AS observed, max(epoch_us(ts)) AS hi, NULL AS win
      FROM ev WHERE ({where}) AND {key} IS NOT NULL GROUP BY {key}"""


def where_sql(where: dict) -> str:
    parts = ["TRUE"]
    for key, value in where.items():
        name, _, op = key.partition("__")
        parts.append(
            {
                "": f"{name} = '{value}'",
                "in_tags": f"tag = '{value}'",
                "contains": f"lower({name}) LIKE '%{value}%'",
                "gte": f"{name} >= {value}",
            }[op]
        )
    return " AND ".join(parts)


def rule_sql(rule: Rule) -> str:
    where = where_sql(rule.where)
    if rule.type == "threshold":
        return count_sql(rule.id, rule.group_by, where, int(rule.window_minutes), rule.threshold)
    if rule.type == "distinct":
        return distinct_sql(rule.id, rule.group_by, rule.distinct_field, where,
                            int(rule.window_minutes), rule.threshold)
    return match_sql(rule.id, rule.group_by, where)


SPANS = "spans AS (" + " UNION ALL ".join(rule_sql(r) for r in fixture_rules()) + ")"
# Events inside the firing span of each alert, by rule.
MEMBERS = "members AS (" + " UNION ALL ".join(
    f"""SELECT s.rule_id, s.key, s.observed, e.* FROM spans s JOIN ev e
        ON s.rule_id = '{r.id}' AND CAST(e.{r.group_by} AS VARCHAR) = s.key
        AND ({where_sql(r.where)})
        AND (s.win IS NULL OR epoch_us(e.ts) BETWEEN s.hi - s.win * CAST(60000000 AS BIGINT) AND s.hi)"""
    for r in fixture_rules()
) + ")"
RULES = "rules AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{r.id}', '{r.name}', '{r.severity}', '{r.type}', '{r.group_by}',"
    f" '{r.distinct_field or ''}', '{','.join(r.mitre)}')"
    for r in fixture_rules()
) + ") t(rule_id, rule_name, severity, type, group_by, distinct_field, mitre))"
ALERTS = """alerts AS (
  SELECT m.rule_id, any_value(r.rule_name) AS rule_name, any_value(r.severity) AS severity,
    any_value(r.mitre) AS mitre, m.key, m.rule_id || '|' || m.key AS dedupe_key,
    max(m.observed) AS observed, count(*) AS hit_count,
    min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us,
    CASE WHEN any_value(r.group_by) = 'src_ip' THEN m.key
         ELSE arg_min(m.src_ip, (ts, event_id)) END AS src_ip,
    CASE WHEN count(DISTINCT service) = 1 THEN min(service) END AS service,
    string_agg(DISTINCT service, ',' ORDER BY service) AS services
  FROM members m JOIN rules r USING (rule_id) GROUP BY m.rule_id, m.key)"""
ALERT_CTES = (SPANS, MEMBERS, RULES, ALERTS)


def fixture_alerts(spark, sf):
    return evaluate_rules(events(spark, sf), fixture_rules())


# --------------------------------------------------------------------------- #
# Single rules
# --------------------------------------------------------------------------- #


@query("sliding_threshold", sql(
    "SELECT rule_id, key, observed, hi - 86400000000 AS lo, hi FROM ("
    + count_sql("busy_source", "src_ip", "TRUE", DAY, 8) + ")"))
def sliding_threshold(spark, sf):
    return _span_rows(fired_spans(events(spark, sf), [COUNT]))


@query("sliding_distinct", sql(
    "SELECT rule_id, key, observed, hi - 86400000000 AS lo, hi FROM ("
    + distinct_sql("many_services", "src_ip", "service", "TRUE", DAY, 5) + ")"))
def sliding_distinct(spark, sf):
    return _span_rows(fired_spans(events(spark, sf), [DISTINCT]))


@query("match_rule", sql("""
  SELECT 'fetch' AS rule_id, src_ip AS key, CAST(count(*) AS DOUBLE) AS observed,
         min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi
  FROM ev WHERE tag = 'payload-fetch' GROUP BY src_ip"""))
def match_rule(spark, sf):
    return _span_rows(fired_spans(events(spark, sf), [MATCH]))


@query("ratio_rule", sql("""
  SELECT 'login_heavy' AS rule_id, src_ip AS key, min(epoch_us(ts)) AS lo,
    max(epoch_us(ts)) AS hi,
    round_even(avg(CASE WHEN event_type LIKE 'auth_%' THEN 1 ELSE 0 END), 4) AS observed
  FROM ev GROUP BY src_ip
  HAVING avg(CASE WHEN event_type LIKE 'auth_%' THEN 1 ELSE 0 END) >= 0.45"""))
def ratio_rule(spark, sf):
    return _span_rows(fired_spans(events(spark, sf), [RATIO]))


@query("rule_conditions", sql("""
  SELECT count(*) FILTER (service = 'ssh') AS eq,
    count(*) FILTER (service IN ('ssh', 'ftp')) AS eq_list,
    count(*) FILTER (lower(command) LIKE '%shadow%') AS contains,
    count(*) FILTER (tag = 'log4shell') AS in_tags,
    count(*) FILTER (threat_score >= 40) AS gte, count(*) FILTER (threat_score <= 5) AS lte,
    count(*) FILTER (password IS NULL) AS is_null,
    count(*) FILTER (password IS NOT NULL) AS not_null,
    count(*) FILTER (service = 'ssh' AND threat_score >= 40) AS both FROM ev"""))
def rule_conditions(spark, sf):
    ev = events(spark, sf)
    cases = {
        "eq": {"service": "ssh"},
        "eq_list": {"service": ["ssh", "ftp"]},
        "contains": {"command__contains": "SHADOW"},
        "in_tags": {"tags__in_tags": "log4shell"},
        "gte": {"threat_score__gte": 40},
        "lte": {"threat_score__lte": 5},
        "is_null": {"password__isnull": True},
        "not_null": {"password__isnull": False},
        "both": {"service": "ssh", "threat_score__gte": 40},
    }
    return ev.agg(*[F.count_if(condition(ev, w)).alias(n) for n, w in cases.items()])


# --------------------------------------------------------------------------- #
# All rules
# --------------------------------------------------------------------------- #


@query("rules_one_pass", sql(
    "SELECT dedupe_key, rule_id, severity, src_ip, service, observed, hit_count, first_us, "
    "last_us FROM alerts", *ALERT_CTES))
def rules_one_pass(spark, sf):
    return fixture_alerts(spark, sf).select(
        "dedupe_key", "rule_id", "severity", "src_ip", "service",
        F.col("evidence.observed").alias("observed"), "hit_count",
        micros("first_seen").alias("first_us"), micros("last_seen").alias("last_us"),
    )


def _top(facet: str, n: int, order: str, where: str, distinct: bool = True) -> str:
    inner = f"SELECT {'DISTINCT' if distinct else ''} rule_id, key, {facet} AS v" + (
        "" if distinct else ", ts, event_id")
    return f"""(SELECT rule_id, key, string_agg(v, '~' ORDER BY rn) AS vs FROM (
      SELECT *, row_number() OVER (PARTITION BY rule_id, key ORDER BY {order}) AS rn FROM (
        {inner} FROM members WHERE {where})) WHERE rn <= {n} GROUP BY rule_id, key)"""


@query("alert_evidence", sql(f"""
  SELECT a.dedupe_key, a.services, i.vs AS ips, e.vs AS sample_events, c.vs AS commands,
         p.vs AS paths
  FROM alerts a
  LEFT JOIN {_top("src_ip", 20, "v", "TRUE")} i USING (rule_id, key)
  LEFT JOIN {_top("event_id", 5, "ts, event_id", "TRUE", False)} e USING (rule_id, key)
  LEFT JOIN {_top("command", 10, "ts, event_id", "command <> ''", False)} c USING (rule_id, key)
  LEFT JOIN {_top("path", 25, "v", "path <> ''")} p USING (rule_id, key)""", *ALERT_CTES))
def alert_evidence(spark, sf):
    e = lambda f: F.array_join(f"evidence.{f}", "~")
    return fixture_alerts(spark, sf).select(
        "dedupe_key",
        F.array_join("evidence.services", ",").alias("services"),
        e("source_ips").alias("ips"),
        e("sample_event_ids").alias("sample_events"),
        e("commands").alias("commands"),
        e("paths_sample").alias("paths"),
    )


@query("alert_titles", sql("""
  SELECT dedupe_key, CASE r.type
      WHEN 'threshold' THEN a.rule_name || ': ' || CAST(observed AS BIGINT) || ' events from ' || key
      WHEN 'distinct' THEN a.rule_name || ': ' || CAST(observed AS BIGINT) || ' distinct '
        || distinct_field || ' from ' || key
      ELSE a.rule_name || ': ' || key END AS title
  FROM alerts a JOIN rules r USING (rule_id)""", *ALERT_CTES))
def alert_titles(spark, sf):
    return fixture_alerts(spark, sf).select("dedupe_key", "title")


# --------------------------------------------------------------------------- #
# Alert store
# --------------------------------------------------------------------------- #

_HALVES = [
    f"h{i} AS (SELECT rule_id || '|' || key AS dedupe_key, count(*) AS hit_count, "
    f"min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us FROM ("
    + " UNION ALL ".join(
        f"SELECT '{r.id}' AS rule_id, CAST({r.group_by} AS VARCHAR) AS key, ts FROM ev "
        f"WHERE {where_sql(r.where)} AND {r.group_by} IS NOT NULL AND ts {op} TIMESTAMP '2024-01-16'"
        for r in fixture_rules() if r.type == "match")
    + ") GROUP BY 1)"
    for i, op in ((1, "<"), (2, ">="))
]


def half_alerts(spark, sf):
    """Alerts of the match rules over the two halves of the month."""
    rules = [r for r in fixture_rules() if r.type == "match"]
    ev = events(spark, sf)
    cut = F.lit("2024-01-16").cast("timestamp")
    return (evaluate_rules(ev.filter(F.col("ts") < cut), rules),
            evaluate_rules(ev.filter(F.col("ts") >= cut), rules))


@query("alert_merge", sql("""
  SELECT coalesce(a.dedupe_key, b.dedupe_key) AS dedupe_key,
    greatest(coalesce(a.hit_count, 0), coalesce(b.hit_count, 0)) AS hit_count,
    least(coalesce(a.first_us, b.first_us), coalesce(b.first_us, a.first_us)) AS first_us,
    greatest(coalesce(a.last_us, b.last_us), coalesce(b.last_us, a.last_us)) AS last_us
  FROM h1 a FULL OUTER JOIN h2 b ON a.dedupe_key = b.dedupe_key""", *_HALVES))
def alert_merge(spark, sf):
    old, new = half_alerts(spark, sf)
    return A.merge_alerts(old, new).select(
        "dedupe_key", "hit_count", micros("first_seen").alias("first_us"),
        micros("last_seen").alias("last_us"))


@query("new_alerts", sql(
    "SELECT dedupe_key, hit_count FROM h2 WHERE dedupe_key NOT IN (SELECT dedupe_key FROM h1)",
    *_HALVES))
def new_alerts(spark, sf):
    old, new = half_alerts(spark, sf)
    return A.new_alerts(old, new).select("dedupe_key", "hit_count")


@query("detection_run", sql("""
  SELECT (SELECT count(*) FROM ev) AS events_evaluated, 28 AS rules_evaluated,
    (SELECT count(*) FROM alerts) AS alerts_generated,
    (SELECT count(*) FROM alerts WHERE dedupe_key NOT IN (SELECT dedupe_key FROM h1))
      AS alerts_created,
    (SELECT count(*) FROM alerts WHERE dedupe_key IN (SELECT dedupe_key FROM h1))
      AS alerts_updated""", *ALERT_CTES, *_HALVES))
def detection_run(spark, sf):
    old, _ = half_alerts(spark, sf)
    run = run_detection(events(spark, sf), fixture_rules(), old, hours=24 * 365)
    return run.counts.drop("window_hours")


@query("alert_listing", sql("""
  SELECT dedupe_key, last_us, count(*) OVER () AS total FROM alerts
  WHERE severity IN ('high', 'critical') ORDER BY last_us DESC, dedupe_key LIMIT 50 OFFSET 5""",
  *ALERT_CTES))
def alert_listing(spark, sf):
    rows = A.list_alerts(fixture_alerts(spark, sf), status="new", min_severity="high")
    paged = page(rows, [F.desc("last_seen"), F.asc("dedupe_key")], 50, 5)
    return paged.select("dedupe_key", micros("last_seen").alias("last_us"), "total")


@query("alert_triage", sql("""
  SELECT CASE WHEN rule_id = 'ssh_bruteforce' THEN 'resolved' ELSE 'new' END AS status,
    count(*) AS alerts, count(*) FILTER (rule_id = 'ssh_bruteforce') AS noted
  FROM alerts GROUP BY 1""", *ALERT_CTES))
def alert_triage(spark, sf):
    alerts = fixture_alerts(spark, sf)
    mine = alerts.filter(F.col("rule_id") == "ssh_bruteforce")
    steps = [("acknowledged", "seen", 1), ("resolved", None, 2)]
    updates = mine.select("alert_id", F.explode(F.array(*[
        F.struct(F.lit(s).alias("status"), F.lit(n).cast("string").alias("notes"),
                 F.lit(t).alias("updated_at")) for s, n, t in steps])).alias("u"))
    done = A.apply_triage(alerts, updates.select("alert_id", "u.*"))
    return done.groupBy("status").agg(
        F.count("*").alias("alerts"), F.count_if(F.col("notes") == "seen").alias("noted"))


@query("notification_choice", sql("""
  SELECT dedupe_key, row_number() OVER (ORDER BY (severity = 'critical') DESC, last_us DESC,
    dedupe_key) AS position, greatest(total - 8, 0) AS overflow
  FROM (SELECT *, count(*) OVER () AS total FROM alerts WHERE severity IN ('high', 'critical'))
  ORDER BY 2 LIMIT 8""", *ALERT_CTES))
def notification_choice(spark, sf):
    return A.choose_notifications(fixture_alerts(spark, sf)).select(
        "dedupe_key", F.col("position").cast("bigint").alias("position"), "overflow")


@query("alert_hits_by_rule", sql(
    "SELECT rule_id, max(rule_name) AS rule_name, CAST(sum(hit_count) AS BIGINT) AS hits "
    "FROM alerts GROUP BY rule_id", *ALERT_CTES))
def alert_hits_by_rule(spark, sf):
    return A.hits_by_rule(fixture_alerts(spark, sf))


@query("alerts_by_severity", sql("""
  SELECT s.severity, count(a.dedupe_key) AS alerts
  FROM (VALUES ('info'), ('low'), ('medium'), ('high'), ('critical')) s(severity)
  LEFT JOIN alerts a ON a.severity = s.severity GROUP BY s.severity""", *ALERT_CTES))
def alerts_by_severity(spark, sf):
    return A.counts_by_severity(fixture_alerts(spark, sf)).select("severity", "alerts")


# --------------------------------------------------------------------------- #
# Coverage
# --------------------------------------------------------------------------- #

_SEV = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
_HITS = f"""hits AS (
  SELECT technique, count(*) AS alerts, CAST(sum(hit_count) AS BIGINT) AS hits,
    max(last_us) AS last_us, arg_max(severity, {_SEV}) AS worst_severity
  FROM (SELECT unnest(string_split(mitre, ',')) AS technique, * FROM alerts WHERE mitre <> '')
  GROUP BY technique)"""


@query("technique_hits", sql("SELECT * FROM hits", *ALERT_CTES, _HITS))
def technique_hits(spark, sf):
    return C.technique_hits(fixture_alerts(spark, sf)).select(
        "technique", "alerts", "hits", micros("last_seen").alias("last_us"), "worst_severity")


# Half of the rules claim; alerts of the others show up as orphaned.
def _claiming():
    return [r for i, r in enumerate(fixture_rules()) if i % 2 == 0]


_CLAIMS = "claims AS (SELECT technique, count(*) AS rule_count FROM (VALUES " + ", ".join(
    f"('{t}')" for t, *_ in C.claim_rows(_claiming())) + ") t(technique) GROUP BY technique)"
_COVER = """cover AS (
  SELECT coalesce(c.technique, h.technique) AS technique, coalesce(rule_count, 0) AS rule_count,
    coalesce(alerts, 0) AS alerts, coalesce(hits, 0) AS hits, worst_severity,
    CASE WHEN rule_count IS NULL THEN 'orphaned' WHEN alerts IS NULL THEN 'rule-only'
         ELSE 'observed' END AS status
  FROM claims c FULL OUTER JOIN hits h ON c.technique = h.technique)"""


@query("coverage", sql("SELECT * FROM cover", *ALERT_CTES, _HITS, _CLAIMS, _COVER))
def coverage(spark, sf):
    report = C.coverage(fixture_alerts(spark, sf), _claiming())
    return report.select("technique", "rule_count", "alerts", "hits", "worst_severity", "status")


@query("coverage_totals", sql("""
  SELECT count(*) FILTER (rule_count > 0) AS techniques_claimed,
    count(*) FILTER (status = 'observed') AS techniques_observed,
    count(*) FILTER (status = 'rule-only') AS techniques_rule_only,
    count(*) FILTER (status = 'orphaned') AS techniques_orphaned, 14 AS rules_enabled,
    round_even(count(*) FILTER (status = 'observed') / count(*) FILTER (rule_count > 0), 3)
      AS observed_share FROM cover""", *ALERT_CTES, _HITS, _CLAIMS, _COVER))
def coverage_totals(spark, sf):
    return C.coverage_totals(C.coverage(fixture_alerts(spark, sf), _claiming()), _claiming())
