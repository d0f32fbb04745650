"""Aggregate, time-series, session and search queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sablewatch.catalog.adapter import events, load, sql
from sablewatch.catalog.registry import query
from sablewatch.functions.columns import micros
from sablewatch.functions.text import hash_password
from sablewatch.operators import aggregates as G
from sablewatch.operators import search as S
from sablewatch.operators import sessions as N
from sablewatch.operators import timeseries as T

AS_OF = "TIMESTAMP '2024-02-01'"


def as_of():
    return F.lit("2024-02-01").cast("timestamp")


# --------------------------------------------------------------------------- #
# Counters and breakdowns
# --------------------------------------------------------------------------- #

_PAIR = "coalesce(username, '') || ':' || coalesce(password, '')"
_COUNTERS = f"""count(*) AS total_events, count(DISTINCT src_ip) AS unique_sources,
    count(DISTINCT country) AS unique_countries,
    count(*) FILTER (event_type = 'auth_attempt') AS auth_attempts,
    count(*) FILTER (event_type = 'command') AS commands_run,
    count(DISTINCT {_PAIR}) FILTER (event_type = 'auth_attempt') AS unique_credential_pairs"""


@query("summary_counters", sql(f"SELECT {_COUNTERS} FROM ev"))
def summary_counters(spark, sf):
    return G.summary_counters(events(spark, sf))


@query("summary_counters_empty", sql(f"SELECT {_COUNTERS} FROM ev WHERE ts > {AS_OF}"))
def summary_counters_empty(spark, sf):
    return G.summary_counters(events(spark, sf).filter(F.col("ts") > as_of()))


@query("service_breakdown", sql(
    "SELECT service, count(*) AS events, count(DISTINCT src_ip) AS sources FROM ev GROUP BY 1"))
def service_breakdown(spark, sf):
    return G.service_breakdown(events(spark, sf))


@query("top_countries", sql("""
  SELECT country, max(country_name) AS country_name, count(*) AS events,
    count(DISTINCT src_ip) AS sources FROM ev WHERE country IS NOT NULL GROUP BY 1
  ORDER BY events DESC, country LIMIT 3"""))
def top_countries(spark, sf):
    return G.top_countries(events(spark, sf), 3)


@query("top_networks", sql("""
  SELECT asn, max(as_org) AS as_org, count(*) AS events, count(DISTINCT src_ip) AS sources
  FROM ev WHERE asn IS NOT NULL GROUP BY 1 ORDER BY events DESC, asn LIMIT 5"""))
def top_networks(spark, sf):
    return G.top_networks(events(spark, sf), 5)


@query("top_dimension", """
  SELECT n_nationkey AS nation, max(n_name) AS nation_name, count(*) AS events,
    count(DISTINCT user_id) AS sources
  FROM events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY 1 ORDER BY events DESC, nation LIMIT 10""")
def top_dimension(spark, sf):
    joined = (
        load(spark, sf, "events")
        .join(load(spark, sf, "customer"), F.col("user_id") == F.col("c_custkey"))
        .join(load(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("user_id").alias("src_ip"), F.col("n_nationkey").alias("nation"),
                F.col("n_name").alias("nation_name"))
    )
    return G.top_dimension(joined, "nation", "nation_name", 10)


@query("credential_pairs", sql("""
  SELECT username, password, count(*) AS attempts FROM ev
  WHERE event_type = 'auth_attempt' AND username IS NOT NULL GROUP BY 1, 2
  ORDER BY attempts DESC, username, password NULLS FIRST LIMIT 100"""))
def credential_pairs(spark, sf):
    return G.credential_pairs(events(spark, sf))


def _top_sql(name, column):
    return f"""(SELECT '{name}' AS field, {column} AS value, count(*) AS n FROM ev
      WHERE {column} <> '' GROUP BY 2 ORDER BY n DESC, value LIMIT 20)"""


@query("top_values", sql(" UNION ALL ".join(_top_sql(n, c) for n, c in G.TOP_FIELDS.items())))
def top_values(spark, sf):
    ev = events(spark, sf)
    return reduce(
        DataFrame.unionByName,
        [G.top_values(ev, f).select(F.lit(f).alias("field"), "*") for f in G.TOP_FIELDS],
    )


@query("top_k_per_source", sql("""
  SELECT src_ip, value, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY src_ip
    ORDER BY n DESC, value) AS rank FROM (SELECT src_ip, username AS value, count(*) AS n FROM ev
    WHERE username <> '' GROUP BY 1, 2)) WHERE rank <= 10"""))
def top_k_per_source(spark, sf):
    return G.top_values_per_group(events(spark, sf), "src_ip", "username").withColumn(
        "rank", F.col("rank").cast("bigint"))


@query("health", sql("""
  SELECT count(*) AS events, max(epoch_us(ts)) AS newest_us,
    epoch(date_trunc('second', TIMESTAMP '2024-02-01'))::BIGINT
      - epoch(date_trunc('second', max(ts)))::BIGINT AS stale_seconds FROM ev"""))
def health(spark, sf):
    return G.health(events(spark, sf), as_of()).select(
        "events", micros("newest").alias("newest_us"), "stale_seconds")


# --------------------------------------------------------------------------- #
# Time
# --------------------------------------------------------------------------- #


def _filled_sql(seconds: int, column: str) -> str:
    us = seconds * 1_000_000
    return f"""
      b AS (SELECT epoch_us(ts) // {us} AS i, coalesce(nullif({column}, ''), 'unknown') AS series,
              count(*) AS n FROM ev GROUP BY 1, 2),
      spine AS (SELECT series, unnest(range((SELECT min(i) FROM b),
        (SELECT max(epoch_us(ts)) // {us} + 1 FROM ev))) AS i
        FROM (SELECT DISTINCT series FROM b))"""


@query("timeseries_filled", sql("""
  SELECT i * 3600000000 AS bucket_us, series, coalesce(n, 0) AS n
  FROM spine LEFT JOIN b USING (i, series)""", _filled_sql(3600, "service")))
def timeseries_filled(spark, sf):
    filled = T.timeseries(events(spark, sf), bucket="1h", by="service")
    return filled.select(micros("bucket").alias("bucket_us"), "series", "n")


@query("timeseries_wide", sql("""
  SELECT i * 21600000000 AS bucket_us,
    CAST(sum(n) FILTER (series = 'critical') AS BIGINT) AS critical,
    CAST(sum(n) FILTER (series = 'high') AS BIGINT) AS high,
    CAST(sum(n) FILTER (series = 'low') AS BIGINT) AS low, CAST(sum(n) AS BIGINT) AS total
  FROM (SELECT i, series, coalesce(n, 0) AS n FROM spine LEFT JOIN b USING (i, series))
  GROUP BY i""", _filled_sql(21600, "severity")))
def timeseries_wide(spark, sf):
    filled = T.timeseries(events(spark, sf), bucket="6h", by="severity")
    wide = T.timeseries_wide(filled, ["critical", "high", "low"])
    return wide.select(micros("bucket").alias("bucket_us"), "critical", "high", "low", "total")


@query("timeseries_window", sql(f"""
  SELECT i * 86400000000 AS bucket_us, 'events' AS series,
    (SELECT count(*) FROM ev WHERE ts >= {AS_OF} - INTERVAL 168 HOUR
       AND epoch_us(ts) // 86400000000 = i) AS n
  FROM range(epoch_us({AS_OF} - INTERVAL 168 HOUR) // 86400000000,
             epoch_us({AS_OF}) // 86400000000 + 1) t(i)"""))
def timeseries_window(spark, sf):
    filled = T.timeseries(events(spark, sf), bucket="1d", by="none", hours=168, as_of=as_of())
    return filled.select(micros("bucket").alias("bucket_us"), "series", "n")


@query("heatmap", sql("""
  SELECT w AS weekday, h AS hour, coalesce(n, 0) AS n, (SELECT count(*) FROM ev) AS total,
    (SELECT max(n) FROM cells) AS max_cell
  FROM range(7) a(w) CROSS JOIN range(24) b(h) LEFT JOIN cells USING (w, h)""",
  "cells AS (SELECT isodow(ts) - 1 AS w, hour(ts) AS h, count(*) AS n FROM ev GROUP BY 1, 2)"))
def heatmap(spark, sf):
    return T.heatmap(events(spark, sf))


# --------------------------------------------------------------------------- #
# Sessions
# --------------------------------------------------------------------------- #

_SESSIONS = """ses AS (
  SELECT session_id, arg_min(service, (ts, event_id)) AS service,
    arg_min(src_ip, (ts, event_id)) AS src_ip, arg_min(src_port, (ts, event_id)) AS src_port,
    min(epoch_us(ts)) AS started_us, max(epoch_us(ts)) AS ended_us,
    (max(epoch_us(ts)) - min(epoch_us(ts))) // 1000 AS duration_ms, count(*) AS event_count,
    count(*) FILTER (event_type = 'auth_attempt') AS auth_attempts,
    count(*) FILTER (event_type = 'command') AS commands_run
  FROM ev GROUP BY session_id)"""


@query("session_build", sql("SELECT * FROM ses", _SESSIONS))
def session_build(spark, sf):
    s = N.build_sessions(events(spark, sf))
    return s.select("session_id", "service", "src_ip", "src_port",
                    micros("started_at").alias("started_us"), micros("ended_at").alias("ended_us"),
                    "duration_ms", "event_count", "auth_attempts", "commands_run")


@query("session_build_new", sql("""
  SELECT count(*) AS sessions, CAST(sum(event_count) AS BIGINT) AS events FROM ses
  WHERE session_id NOT IN (SELECT session_id FROM ev WHERE ts < TIMESTAMP '2024-01-10')""",
  _SESSIONS))
def session_build_new(spark, sf):
    ev = events(spark, sf)
    old = N.build_sessions(ev.filter(F.col("ts") < F.lit("2024-01-10").cast("timestamp")))
    return N.build_sessions(ev, old).agg(
        F.count("*").alias("sessions"), F.sum("event_count").alias("events"))


@query("session_listing", sql("""
  SELECT session_id, event_count, commands_run, count(*) OVER () AS total FROM ses
  WHERE event_count >= 3 AND commands_run > 0
  ORDER BY event_count DESC, started_us DESC, session_id LIMIT 50 OFFSET 10""", _SESSIONS))
def session_listing(spark, sf):
    rows = N.list_sessions(N.build_sessions(events(spark, sf)), min_events=3, has_commands=True,
                           sort="event_count", limit=50, offset=10)
    return rows.select("session_id", "event_count", "commands_run", "total")


@query("session_geo", sql("""
  SELECT session_id, max(country) AS country, max(country_name) AS country_name,
    max(asn) AS asn, max(as_org) AS as_org FROM ev GROUP BY 1"""))
def session_geo(spark, sf):
    ev = events(spark, sf)
    return N.with_event_geo(N.build_sessions(ev), ev).select(
        "session_id", "country", "country_name", "asn", "as_org")


@query("session_cap", sql("""
  SELECT session_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id
    ORDER BY ts, event_id) AS rn FROM ev) WHERE rn <= 2"""))
def session_cap(spark, sf):
    return S.first_events_per_session(events(spark, sf), 2).select("session_id", "event_id")


_PACED = """paced AS (SELECT session_id, event_id,
    coalesce((us - lag(us) OVER w) // 1000, 0) AS gap_ms,
    (us - min(us) OVER (PARTITION BY session_id)) // 1000 AS elapsed_ms
  FROM (SELECT *, epoch_us(ts) AS us FROM ev)
  WINDOW w AS (PARTITION BY session_id ORDER BY us, event_id))"""


@query("replay_timeline", sql("""
  SELECT *, least(greatest(gap_ms, 140), 2200) AS step_ms, gap_ms > 5000 AS idle FROM paced""",
  _PACED))
def replay_timeline(spark, sf):
    return N.replay_timeline(events(spark, sf)).select(
        "session_id", "event_id", "gap_ms", "step_ms", "idle", "elapsed_ms")


@query("replay_turns", """
  SELECT conv_id AS session_id, turn, coalesce(length(lag(text) OVER (PARTITION BY conv_id
    ORDER BY turn)), 0) AS previous_chars FROM conversations""")
def replay_turns(spark, sf):
    from sablewatch.functions.skew import chunked_lag

    turns = load(spark, sf, "conversations").select(
        F.col("conv_id").alias("session_id"), "turn",
        F.length("text").cast("bigint").alias("chars"))
    paced = chunked_lag(turns, ["session_id"], ["turn"], F.floor(F.col("turn") / 4), "chars", "p")
    return paced.select("session_id", "turn", F.coalesce("p", F.lit(0)).alias("previous_chars"))


# --------------------------------------------------------------------------- #
# Search and intake
# --------------------------------------------------------------------------- #


@query("event_search", sql("""
  SELECT event_id, service, severity, count(*) OVER () AS total FROM ev
  WHERE severity IN ('medium', 'high', 'critical')
    AND (command ILIKE '%e%' OR path ILIKE '%e%' OR username ILIKE '%e%' OR user_agent ILIKE '%e%')
    AND country = 'DE' ORDER BY ts DESC, event_id DESC LIMIT 100 OFFSET 20"""))
def event_search(spark, sf):
    found = S.search_events(events(spark, sf), min_severity="medium", search="e", country="de")
    return S.event_page(found, 100, 20).select("event_id", "service", "severity", "total")


@query("document_search", """
  SELECT doc_id, lang FROM documents WHERE text ILIKE '%the_e%' OR source ILIKE '%the_e%'""")
def document_search(spark, sf):
    docs = load(spark, sf, "documents")
    return docs.filter(S.text_match(docs, "the_e", ("text", "source"))).select("doc_id", "lang")


@query("event_window", sql(f"""
  SELECT event_id FROM ev WHERE ts >= {AS_OF} - INTERVAL 240 HOUR AND service = 'ssh'
    AND event_type = 'auth_attempt' AND username = 'root'"""))
def event_window(spark, sf):
    return S.search_events(events(spark, sf), service="ssh", event_type="auth_attempt",
                           username="root", hours=240, as_of=as_of()).select("event_id")


@query("live_cursor", sql("""
  SELECT event_id FROM ev WHERE severity <> 'info'
    AND (ts, event_id) > (SELECT (max(ts), '500') FROM ev WHERE event_id = '500')
  ORDER BY ts DESC, event_id DESC LIMIT 50"""))
def live_cursor(spark, sf):
    return S.events_after(events(spark, sf), "500", 50, "low").select("event_id")


@query("keyed_lookup", sql("""
  SELECT 'event' AS kind, event_id AS key FROM ev WHERE event_id = '77'
  UNION ALL SELECT 'session', session_id FROM ses WHERE session_id = 's7-20240101'""", _SESSIONS))
def keyed_lookup(spark, sf):
    ev = events(spark, sf)
    one = S.lookup(ev, "event_id", "77").select(F.lit("event").alias("kind"),
                                                F.col("event_id").alias("key"))
    two = S.lookup(N.build_sessions(ev), "session_id", "s7-20240101").select(
        F.lit("session").alias("kind"), F.col("session_id").alias("key"))
    return one.unionByName(two)


@query("redact", sql("""
  SELECT event_id, CASE WHEN password <> '' THEN '[redacted]' ELSE password END AS password
  FROM ev"""))
def redact(spark, sf):
    return S.redact(events(spark, sf)).select("event_id", "password")


@query("hash_passwords", sql("""
  SELECT event_id, CASE WHEN password <> '' THEN 'sha256:' || left(sha256(password), 32)
    ELSE password END AS password FROM ev"""))
def hash_passwords(spark, sf):
    ev = events(spark, sf)
    return ev.select("event_id", hash_password(F.col("password")).alias("password"))


@query("ignore_list", sql("""
  SELECT count(*) AS kept, count(DISTINCT src_ip) AS sources FROM ev
  WHERE src_ip NOT IN (SELECT src_ip FROM ev WHERE tag = 'mirai-signature')"""))
def ignore_list(spark, sf):
    ev = events(spark, sf)
    ignored = ev.filter(F.array_contains("tags", "mirai-signature")).select("src_ip")
    return S.drop_ignored(ev, ignored).agg(
        F.count("*").alias("kept"), F.count_distinct("src_ip").alias("sources"))


@query("header_truncation", """
  SELECT page_id, least(64, 2) AS headers, least(length(url), 1024) AS url_chars,
    least(length(html), 1024) AS html_chars FROM pages""")
def header_truncation(spark, sf):
    pages = load(spark, sf, "pages").withColumn(
        "h", F.create_map(F.lit("u" * 70), F.col("url"), F.lit("html"), F.col("html")))
    cut = pages.withColumn("h", S.truncate_headers(F.col("h")))
    return cut.select(
        "page_id", F.size("h").alias("headers"),
        F.length(F.element_at("h", F.lit("u" * 64))).alias("url_chars"),
        F.length(F.element_at("h", F.lit("html"))).alias("html_chars"))
