"""Source roll-up, score, class, listings, exports and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sablewatch.catalog.adapter import events, sql
from sablewatch.catalog.detection import ALERT_CTES, fixture_alerts
from sablewatch.catalog.registry import query
from sablewatch.catalog.statistics import AS_OF, as_of
from sablewatch.constants import EXPLOIT_TAGS, SCORE_CEILINGS
from sablewatch.functions.columns import micros
from sablewatch.operators import exports as X
from sablewatch.operators import profiles as P
from sablewatch.operators import reports as R
from sablewatch.operators import scoring as C
from sablewatch.operators.payloads import payloads_of_source
from sablewatch.operators.sessions import build_sessions

_EXPLOITS = ", ".join(f"'{t}'" for t in EXPLOIT_TAGS)
FACTS = f"""facts AS (
  SELECT src_ip, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS event_count,
    count(DISTINCT session_id) AS sessions, count(DISTINCT nullif(username, '')) AS users,
    count(DISTINCT nullif(password, '')) AS passwords,
    count(DISTINCT nullif(path, '')) AS paths, count(DISTINCT service) AS n_services,
    string_agg(DISTINCT service, ',' ORDER BY service) AS services,
    count(*) FILTER (event_type = 'auth_attempt') AS auth_attempts,
    count(*) FILTER (event_type = 'auth_success') AS successes,
    count(*) FILTER (event_type = 'command') AS commands,
    count(*) FILTER (tag = 'payload-fetch') AS fetches,
    max(sev_rank) AS worst, count(*) FILTER (sev_rank >= 3) AS high_events,
    max(threat_score) AS intel, bool_or(service = 'http') AS has_http,
    bool_or(tag IN ('mirai-signature', 'iot-default-credential')) AS iot,
    bool_or(tag IN ({_EXPLOITS})) AS exploit,
    arg_min(country, (ts, event_id)) FILTER (country IS NOT NULL) AS country,
    arg_min(asn, (ts, event_id)) FILTER (asn IS NOT NULL) AS asn,
    any_value(latitude) AS latitude, any_value(as_org) AS as_org,
    any_value(country_name) AS country_name
  FROM ev GROUP BY src_ip)"""
_RAW = {
    "volume": "log10(event_count + 1) * 5",
    "persistence": "ln(1 + (epoch_us(last_seen) - epoch_us(first_seen)) / 3600000000) * 3"
                   " + ln(1 + sessions) * 2",
    "credential_breadth": "ln(1 + users) * 4 + ln(1 + passwords) * 2.5",
    "service_breadth": "(n_services - 1) * 3",
    "severity": "worst * 5 + ln(1 + high_events) * 3",
    "post_exploitation": "successes * 8 + ln(1 + commands) * 6 + fetches * 10",
    "threat_intel": "intel * 0.4",
}
PARTS = "parts AS (SELECT *, " + ", ".join(
    f"round(greatest(0.0, least(CAST({e} AS DOUBLE), {SCORE_CEILINGS[n]})), 2) AS {n}"
    for n, e in _RAW.items()) + " FROM facts)"
_SUM = " + ".join(_RAW)
SCORED = f"""scored AS (
  SELECT *, {_SUM} AS total,
    greatest(0.4, exp(-((epoch_us({AS_OF}) - epoch_us(last_seen)) / 86400000000) / 30)) AS decay,
    CASE WHEN iot THEN 'botnet-loader' WHEN commands >= 3 AND successes > 0 THEN 'targeted-intrusion'
      WHEN exploit THEN 'exploit-attempt'
      WHEN auth_attempts >= 10 OR passwords >= 8 THEN 'credential-bruteforce'
      WHEN has_http AND paths >= 15 THEN 'web-scanner' WHEN n_services >= 3 THEN 'recon-scanner'
      WHEN event_count >= 5 OR auth_attempts >= 1 THEN 'opportunistic-probe'
      ELSE 'low-signal' END AS classification
  FROM parts),
final AS (SELECT *, round(least(total, 100) * decay, 2) AS threat_score FROM scored)"""
SCORE_CTES = (FACTS, PARTS, SCORED)


def sources(spark, sf):
    return C.rebuild_sources(events(spark, sf), as_of())


@query("source_rollup", sql("""
  SELECT src_ip, epoch_us(first_seen) AS first_us, epoch_us(last_seen) AS last_us, event_count,
    sessions AS session_count, auth_attempts, commands AS commands_run,
    users AS distinct_usernames, passwords AS distinct_passwords, services, country, asn
  FROM facts""", FACTS))
def source_rollup(spark, sf):
    return sources(spark, sf).select(
        "src_ip", micros("first_seen").alias("first_us"), micros("last_seen").alias("last_us"),
        "event_count", "session_count", "auth_attempts", "commands_run", "distinct_usernames",
        "distinct_passwords", F.array_join("services", ",").alias("services"), "country", "asn")


def _top10(column: str) -> str:
    return f"""(SELECT src_ip, string_agg(v, '~' ORDER BY rn) AS vs FROM (SELECT *, row_number()
      OVER (PARTITION BY src_ip ORDER BY n DESC, v) AS rn FROM (SELECT src_ip, {column} AS v,
      count(*) AS n FROM ev WHERE {column} <> '' GROUP BY 1, 2)) WHERE rn <= 10 GROUP BY src_ip)"""


@query("source_top_lists", sql(f"""
  SELECT src_ip, coalesce(u.vs, '') AS usernames, coalesce(p.vs, '') AS passwords,
    coalesce(w.vs, '') AS paths FROM facts LEFT JOIN {_top10("username")} u USING (src_ip)
  LEFT JOIN {_top10("password")} p USING (src_ip) LEFT JOIN {_top10("path")} w USING (src_ip)""",
  FACTS))
def source_top_lists(spark, sf):
    return sources(spark, sf).select("src_ip", *[
        F.array_join(f"top_{c}", "~").alias(c) for c in ("usernames", "passwords", "paths")])


@query("source_refresh", sql("""
  SELECT src_ip, event_count FROM facts
  WHERE src_ip IN (SELECT src_ip FROM ev WHERE tag = 'log4shell')""", FACTS))
def source_refresh(spark, sf):
    ev = events(spark, sf)
    changed = ev.filter(F.array_contains("tags", "log4shell")).select("src_ip")
    return C.rebuild_sources(ev, as_of(), only=changed).select("src_ip", "event_count")


@query("score_components", sql("SELECT src_ip, " + ", ".join(
    f"round({e}, 4) AS {n}" for n, e in _RAW.items()) + " FROM facts", FACTS))
def score_components(spark, sf):
    facts = C.source_facts(events(spark, sf))
    return facts.select("src_ip", *[
        F.round(v.cast("double"), 4).alias(n) for n, v in C.score_components().items()])


@query("source_scores", sql("""
  SELECT src_ip, classification, round(threat_score, 1) AS threat_score,
    CASE WHEN threat_score >= 80 THEN 'critical' WHEN threat_score >= 60 THEN 'high'
      WHEN threat_score >= 35 THEN 'medium' WHEN threat_score >= 15 THEN 'low' ELSE 'info' END
      AS band FROM final""", *SCORE_CTES))
def source_scores(spark, sf):
    scored = C.scored_facts(C.source_facts(events(spark, sf)), as_of())
    return scored.select("src_ip", "classification", F.round("threat_score", 1).alias(
        "threat_score"), "band")


@query("source_classes", sql(
    "SELECT classification, count(*) AS sources FROM scored GROUP BY 1", *SCORE_CTES))
def source_classes(spark, sf):
    return sources(spark, sf).groupBy("classification").agg(F.count("*").alias("sources"))


_BY_SESSION = tuple(
    c.replace("SELECT src_ip, min(ts)", "SELECT session_id AS src_ip, min(ts)").replace(
        "FROM ev GROUP BY src_ip", "FROM ev GROUP BY session_id") for c in SCORE_CTES)


@query("session_classes", sql(
    "SELECT classification, count(*) AS sessions, CAST(sum(event_count) AS BIGINT) AS events "
    "FROM scored GROUP BY 1", *_BY_SESSION))
def session_classes(spark, sf):
    """The class ladder over sessions, which are small enough to reach every rung."""
    ev = events(spark, sf).withColumn("src_ip", F.col("session_id"))
    return C.scored_facts(C.source_facts(ev), as_of()).groupBy("classification").agg(
        F.count("*").alias("sessions"), F.sum("event_count").alias("events"))


_TAGS = f"""tagrows AS (
  SELECT DISTINCT src_ip, 0 AS grp, t AS tag FROM (SELECT src_ip, unnest(threat_tags) AS t FROM ev)
    WHERE regexp_matches(t, '^(scanner|research|malware|tool|ti):')
  UNION ALL SELECT DISTINCT src_ip, 1, 'from-hosting-provider' FROM ev
    WHERE list_contains(threat_tags, 'hosting-provider')
  UNION ALL SELECT DISTINCT src_ip, 2, 'from-vpn-or-tor' FROM ev
    WHERE list_contains(threat_tags, 'vpn-or-tor')
  UNION ALL SELECT DISTINCT src_ip, 3, tag FROM ev WHERE tag IN ({_EXPLOITS})
  UNION ALL SELECT src_ip, 4, CASE classification WHEN 'botnet-loader' THEN 'iot-botnet'
      WHEN 'targeted-intrusion' THEN 'hands-on-keyboard' WHEN 'credential-bruteforce' THEN
        CASE WHEN users >= 8 THEN 'username-list-driven' ELSE 'single-account-focus' END
      WHEN 'web-scanner' THEN 'path-enumeration' WHEN 'recon-scanner' THEN 'multi-protocol' END
    FROM scored)"""


@query("source_tags", sql("""
  SELECT src_ip, string_agg(tag, ',' ORDER BY grp, tag) AS tags FROM tagrows
  WHERE tag IS NOT NULL GROUP BY 1""", *SCORE_CTES, _TAGS))
def source_tags(spark, sf):
    return sources(spark, sf).filter(F.size("tags") > 0).select(
        "src_ip", F.array_join("tags", ",").alias("tags"))


@query("score_explanation", sql("""
  SELECT src_ip, round(total, 1) AS raw_score, round(decay, 3) AS recency_decay,
    event_count AS events_considered FROM final""", *SCORE_CTES))
def score_explanation(spark, sf):
    return C.explain_sources(events(spark, sf), as_of()).select(
        "src_ip", F.round("raw_score", 1).alias("raw_score"), "recency_decay",
        "events_considered")


@query("source_listing", sql("""
  SELECT src_ip, event_count, count(*) OVER () AS total FROM final
  WHERE country = 'DE' AND classification = 'botnet-loader' AND threat_score >= 20
  ORDER BY event_count DESC, src_ip LIMIT 50""", *SCORE_CTES))
def source_listing(spark, sf):
    return C.list_sources(sources(spark, sf), country="de", classification="botnet-loader",
                          min_score=20, sort="event_count").select("src_ip", "event_count", "total")


# --------------------------------------------------------------------------- #
# Exports
# --------------------------------------------------------------------------- #

_PICKED = """picked AS (SELECT * FROM final WHERE threat_score >= 50
  ORDER BY threat_score DESC, src_ip LIMIT 5000)"""


def picked(spark, sf):
    return X.select_indicators(sources(spark, sf), 50.0, 24 * 365, as_of())


@query("export_selection", sql("SELECT src_ip, classification FROM picked", *SCORE_CTES, _PICKED))
def export_selection(spark, sf):
    return picked(spark, sf).select("src_ip", "classification")


@query("blocklist", sql("""
  SELECT '# score=' || CAST(round_even(threat_score, 0) AS BIGINT) || ' class=' || classification
    || ' events=' || event_count || ' last=' || strftime(last_seen, '%Y-%m-%d') || chr(10)
    || src_ip AS value FROM picked""", *SCORE_CTES, _PICKED))
def blocklist(spark, sf):
    return X.blocklist_rows(picked(spark, sf))


_ISO = """CASE WHEN epoch_us({0}) % 1000000 = 0 THEN strftime({0}, '%Y-%m-%dT%H:%M:%S+00:00')
  ELSE strftime({0}, '%Y-%m-%dT%H:%M:%S.%f+00:00') END"""

_ZULU = _ISO.replace("+00:00", "Z")
_DNS = "6BA7B8109DAD11D180B400C04FD430C8"


def _uuid5(name: str) -> str:
    """Name-based id of a text in SQL: SHA-1, version and variant bits set."""
    h = f"sha1(unhex('{_DNS}' || hex(encode({name}))))"
    variant = f"substr('89ab', CAST(('0x' || substr({h}, 17, 1)) AS INT) % 4 + 1, 1)"
    return (f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || "
            f"{variant} || substr({h}, 18, 3) || '-' || substr({h}, 21, 12))")


_MARKED = """marked AS (SELECT picked.*, tags FROM picked LEFT JOIN (
  SELECT src_ip, list(tag ORDER BY grp, tag) AS tags FROM tagrows WHERE tag IS NOT NULL GROUP BY 1)
  USING (src_ip))"""
_STIX = f"""stix AS (SELECT 'indicator' AS type, '2.1' AS spec_version,
  'indicator--' || {_uuid5("src_ip")} AS id, 'identity--' || {_uuid5("'sensor'")} AS created_by_ref,
  {_ZULU.format("first_seen")} AS created, {_ZULU.format("last_seen")} AS modified,
  {_ZULU.format("first_seen")} AS valid_from, 'Attacking address ' || src_ip AS name,
  'class ' || classification || '; score ' || CAST(round_even(threat_score, 0) AS BIGINT)
    || '; events ' || event_count || '; sessions ' || sessions || '; services '
    || replace(services, ',', ' ') AS description,
  ['malicious-activity'] AS indicator_types,
  '[ipv4-addr:value = ''' || src_ip || ''']' AS pattern, 'stix' AS pattern_type,
  CAST(floor(least(threat_score, 100)) AS INTEGER) AS confidence,
  list_append(coalesce(tags, CAST([] AS VARCHAR[])), classification) AS labels FROM marked)"""


@query("stix_indicators", sql("""
  SELECT * REPLACE (array_to_string(labels, ',') AS labels,
    array_to_string(indicator_types, ',') AS indicator_types) FROM stix""",
  *SCORE_CTES, _PICKED, _TAGS, _MARKED, _STIX))
def stix_indicators(spark, sf):
    rows = X.stix_indicators(picked(spark, sf))
    return rows.withColumns({c: F.array_join(c, ",") for c in ("labels", "indicator_types")})


@query("stix_bundle", sql(f"""
  SELECT 0 AS part, '{{"type":"bundle","id":"bundle--' || {_uuid5(f"'sensor ' || {_ZULU.format(AS_OF)}")}
    || '","objects":[' || to_json({{'type': 'identity', 'spec_version': '2.1',
      'id': 'identity--' || {_uuid5("'sensor'")}, 'created': {_ZULU.format(AS_OF)},
      'modified': {_ZULU.format(AS_OF)}, 'name': 'sensor: sensor', 'identity_class': 'system',
      'description': 'Addresses below were recorded by this sensor.'}}) AS value
  UNION ALL SELECT 1, ',' || to_json(stix) FROM stix
  UNION ALL SELECT 2, ']}}'""", *SCORE_CTES, _PICKED, _TAGS, _MARKED, _STIX))
def stix_bundle(spark, sf):
    return X.stix_bundle(picked(spark, sf), "sensor", as_of())


_MISP = """misp AS (SELECT 'ip-src' AS type, 'Network activity' AS category, src_ip AS value,
  threat_score >= 70 AS to_ids,
  classification || '; score ' || CAST(round_even(threat_score, 0) AS BIGINT) || '; '
    || event_count || ' events; services: ' || services AS comment,
  CAST(epoch_us(last_seen) // 1000000 AS VARCHAR) AS timestamp FROM picked)"""


@query("misp_attributes", sql("SELECT * FROM misp", *SCORE_CTES, _PICKED, _MISP))
def misp_attributes(spark, sf):
    return X.misp_attributes(picked(spark, sf))


@query("misp_event", sql(f"""
  SELECT 0 AS part, '{{"Event":{{"info":"Sources seen by sensor sensor, '
    || strftime({AS_OF}, '%Y-%m-%d') || '","date":"' || strftime({AS_OF}, '%Y-%m-%d')
    || '","threat_level_id":"2","analysis":"2","distribution":"0","Attribute":[' AS value
  UNION ALL SELECT CASE WHEN value = (SELECT min(value) FROM misp) THEN 1 ELSE 2 END,
    CASE WHEN value = (SELECT min(value) FROM misp) THEN '' ELSE ',' END || to_json(misp) FROM misp
  UNION ALL SELECT 3, ']}}}}'""", *SCORE_CTES, _PICKED, _MISP))
def misp_event(spark, sf):
    return X.misp_event(picked(spark, sf), "sensor", as_of())


@query("blocklist_file", sql(f"""
  SELECT 0 AS part, '# Addresses to block, listed ' || {_ISO.format(AS_OF)} || chr(10) || '# '
    || count(*) || ' addresses, all seen by a sensor' || chr(10)
    || '# Look before use: addresses that many share can be among them' || chr(10) || '#' AS value
    FROM picked
  UNION ALL SELECT 1, '# score=' || CAST(round_even(threat_score, 0) AS BIGINT) || ' class='
    || classification || ' events=' || event_count || ' last=' || strftime(last_seen, '%Y-%m-%d')
    || chr(10) || src_ip FROM picked""", *SCORE_CTES, _PICKED))
def blocklist_file(spark, sf):
    return X.blocklist_file(picked(spark, sf), as_of())


@query("event_csv", sql(f"""
  SELECT event_id, {_ISO.format("ts")} AS ts, sensor, service, event_type, severity, src_ip, src_port,
    CAST(NULL AS VARCHAR) AS dst_port, username, password, command, http_method, path, user_agent,
    CAST(NULL AS VARCHAR) AS status_code, country, country_name, CAST(NULL AS VARCHAR) AS city, asn,
    as_org, threat_score, session_id FROM ev"""))
def event_csv(spark, sf):
    return X.event_csv_rows(events(spark, sf)).withColumns(
        {c: F.col(c).cast("string") for c in ("dst_port", "status_code", "city")})


_JSON_FIELDS = ("event_id", "session_id", "sensor", "service", "event_type", "src_ip", "src_port",
                "username", "password", "command", "http_method", "path", "user_agent",
                "payload_sha256", "country", "asn", "as_org", "severity")


@query("event_json", sql(f"""
  SELECT {_ISO.format("ts")} AS ts, array_to_string(threat_tags, ',') AS threat_tags, tag AS tags,
    {", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in _JSON_FIELDS)} FROM ev"""))
def event_json(spark, sf):
    """The lines, read back as a user of the file would read them."""
    kinds = ", ".join(f"{c} string" for c in (*_JSON_FIELDS, "ts"))
    row = F.from_json("value", f"{kinds}, threat_tags array<string>, tags array<string>")
    rows = X.event_json_rows(events(spark, sf)).select(row.alias("r")).select("r.*")
    return rows.withColumns({c: F.array_join(c, ",") for c in ("threat_tags", "tags")})


@query("alert_csv", sql("""
  SELECT rule_id, rule_name, severity, src_ip, service, hit_count, 'new' AS status
  FROM alerts""", *ALERT_CTES))
def alert_csv(spark, sf):
    return X.alert_csv_rows(fixture_alerts(spark, sf)).select(
        "rule_id", "rule_name", "severity", "src_ip", "service", "hit_count", "status")


# --------------------------------------------------------------------------- #
# Reports
# --------------------------------------------------------------------------- #


_WIN = f"win AS (SELECT * FROM ev WHERE ts >= {AS_OF} - INTERVAL 168 HOUR)"


def _rows(section, key, tail, second="NULL", label="NULL", value="count(*)", sources="NULL", sort=None, tie=None):
    return (f"SELECT '{section}' AS section, CAST({key} AS VARCHAR) AS key, CAST({second} AS VARCHAR) AS second, "
            f"CAST({label} AS VARCHAR) AS label, CAST({value} AS DOUBLE) AS value, CAST({sources} AS BIGINT) AS sources, "
            f"CAST({sort or value} AS DOUBLE) AS sort, CAST({tie or key} AS VARCHAR) AS tie {tail}")


_SEEN = "count(DISTINCT src_ip)"
_RECENT = f"alerts WHERE last_us >= epoch_us({AS_OF} - INTERVAL 168 HOUR)"
_BEST = f"final WHERE last_seen >= {AS_OF} - INTERVAL 168 HOUR"
_COUNTS = {
    "total_events": "(SELECT count(*) FROM win)", "unique_sources": "(SELECT count(DISTINCT src_ip) FROM win)",
    "auth_attempts": "(SELECT count(*) FROM win WHERE event_type = 'auth_attempt')",
    "commands_run": "(SELECT count(*) FROM win WHERE event_type = 'command')",
    "unique_countries": "(SELECT count(DISTINCT country) FROM win)",
    "unique_credential_pairs": "(SELECT count(DISTINCT coalesce(username, '') || ':' || coalesce(password, '')) FROM win "
                               "WHERE event_type = 'auth_attempt')",
    "sessions": f"(SELECT count(*) FROM (SELECT min(ts) AS m FROM ev GROUP BY session_id) WHERE m >= {AS_OF} - INTERVAL 168 HOUR)",
    "open_alerts": "(SELECT count(*) FROM alerts)",
    "critical_alerts": "(SELECT count(*) FROM alerts WHERE severity IN ('high', 'critical'))",
}
_URLS = """(SELECT ts, event_id, unnest(regexp_extract_all(command, '(?:https?|ftp|tftp)://[^\\s;''"|&)]+')) AS url
    FROM win WHERE command ILIKE '%http://%' OR command ILIKE '%https://%' OR command ILIKE '%tftp%')"""
_SUMMARY_CTE = "listed AS (" + "\n  UNION ALL ".join([
    *[_rows("stats", f"'{k}'", "", value=v, sort="0") for k, v in _COUNTS.items()],
    _rows("services", "service", "FROM win GROUP BY service", sources=_SEEN),
    _rows("top_countries", "country", "FROM win WHERE country IS NOT NULL GROUP BY country", label="max(country_name)", sources=_SEEN),
    _rows("top_asns", "asn", "FROM win WHERE asn IS NOT NULL GROUP BY asn", label="max(as_org)", sources=_SEEN),
    *[_rows(f"top_{c}s", c, f"FROM win WHERE {c} <> '' GROUP BY {c}") for c in ("username", "password", "path", "command")],
    _rows("credential_pairs", "username", "FROM win WHERE event_type = 'auth_attempt' AND username IS NOT NULL "
          "GROUP BY username, password", second="password"),
    _rows("payload_urls", "url", f"FROM {_URLS} GROUP BY url", sort="-epoch_us(min(ts))",
          tie="arg_min(event_id, (ts, event_id)) || ' 000000'"),
    _rows("alerts_by_severity", "s", f"FROM (VALUES ('info', 0), ('low', 1), ('medium', 2), ('high', 3), ('critical', 4)) l(s, r) "
          f"LEFT JOIN (SELECT severity, count(*) AS n FROM {_RECENT} GROUP BY 1) ON s = severity", value="coalesce(n, 0)", sort="r"),
    _rows("alerts_by_rule", "rule_id", f"FROM {_RECENT} GROUP BY rule_id", value="sum(hit_count)", label="max(rule_name)"),
    _rows("notable_alerts", "dedupe_key", f"FROM {_RECENT} AND severity IN ('critical', 'high')", value="hit_count", sort="last_us"),
    _rows("top_sources", "src_ip", f"FROM {_BEST}", value="round(threat_score, 1)", sort="threat_score"),
    _rows("new_sources", "src_ip", f"FROM (SELECT * FROM {_BEST} ORDER BY threat_score DESC, src_ip LIMIT 10) "
          f"WHERE first_seen >= {AS_OF} - INTERVAL 168 HOUR", value="round(threat_score, 1)", sort="threat_score"),
]) + """),
  summary AS (SELECT section, CAST(row_number() OVER (PARTITION BY section
      ORDER BY sort DESC, tie NULLS FIRST, second NULLS FIRST) AS INTEGER) AS position,
    key, second, label, value, sources, count(*) OVER (PARTITION BY section) AS total FROM listed
  QUALIFY position <= 10 OR section IN ('stats', 'services', 'alerts_by_severity', 'alerts_by_rule'))"""


def _summary(spark, sf):
    ev = events(spark, sf)
    return R.daily_summary(ev, build_sessions(ev), fixture_alerts(spark, sf), sources(spark, sf),
                           as_of(), hours=168)


@query("daily_summary", sql("SELECT * FROM summary", _WIN, *ALERT_CTES, *SCORE_CTES, _SUMMARY_CTE))
def daily_summary(spark, sf):
    """All 15 sections; titles of notable alerts are checked by alert_titles."""
    scored = F.col("section").isin("top_sources", "new_sources")
    return _summary(spark, sf).withColumns({
        "value": F.when(scored, F.round("value", 1)).otherwise(F.col("value")),
        "label": F.when(F.col("section") != "notable_alerts", F.col("label"))})


@query("digest", sql("""
  SELECT section, position, CASE WHEN section = 'payload_urls' THEN
      replace(replace(replace(key, 'https://', 'hxxps://'), 'http://', 'hxxp://'), '.', '[.]') ELSE key END AS line
  FROM summary WHERE position <= 5
    AND section IN ('notable_alerts', 'top_sources', 'top_usernames', 'top_passwords', 'payload_urls')
  UNION ALL SELECT section, 6, '+' || (total - 5) || ' more' FROM summary WHERE position = 1 AND total > 5
    AND section IN ('notable_alerts', 'top_sources', 'top_usernames', 'top_passwords', 'payload_urls')""",
  _WIN, *ALERT_CTES, *SCORE_CTES, _SUMMARY_CTE))
def digest(spark, sf):
    return R.digest(_summary(spark, sf)).select("section", "position", "line")


@query("new_arrivals", sql(f"""
  SELECT src_ip FROM (SELECT * FROM final WHERE last_seen >= {AS_OF} - INTERVAL 735 HOUR
    ORDER BY threat_score DESC, src_ip LIMIT 500)
  WHERE first_seen >= {AS_OF} - INTERVAL 735 HOUR""", *SCORE_CTES))
def new_arrivals(spark, sf):
    top = R.top_sources(sources(spark, sf), 735, as_of(), 500)
    return R.new_arrivals(top, 735, as_of()).select("src_ip")


@query("map_feed", sql("""
  SELECT src_ip, country, latitude AS lat, event_count AS events,
    (SELECT count(*) FROM top WHERE latitude IS NULL) AS without_geo
  FROM top WHERE latitude IS NOT NULL""", *SCORE_CTES,
  "top AS (SELECT * FROM final ORDER BY threat_score DESC, src_ip LIMIT 500)"))
def map_feed(spark, sf):
    feed = P.map_feed(sources(spark, sf), events(spark, sf), 500)
    return feed["points"].select(
        "src_ip", "country", "lat", "events",
        feed["counts"].select("points_without_geo").scalar().alias("without_geo"))


_ONE = "src_ip = '45.1.1.8'"


@query("source_profile", sql(f"""
  SELECT 'source' AS part, src_ip AS key, CAST(event_count AS DOUBLE) AS value FROM final WHERE {_ONE}
  UNION ALL (SELECT 'session', session_id, count(*) FROM ev WHERE {_ONE} GROUP BY session_id
    ORDER BY min(ts) DESC, session_id LIMIT 50)
  UNION ALL (SELECT 'event', event_id, src_port FROM ev WHERE {_ONE} ORDER BY ts DESC, event_id DESC LIMIT 100)
  UNION ALL (SELECT 'payload', payload_sha256, max(epoch_us(ts)) FROM ev WHERE {_ONE} AND payload_sha256 IS NOT NULL
    GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 20)
  UNION ALL SELECT 'explanation', 'score', round(threat_score, 1) FROM final WHERE {_ONE}
  """ + "\n".join(f"UNION ALL SELECT 'explanation', '{n}', round({n}, 1) FROM final WHERE {_ONE}" for n in _RAW),
  *SCORE_CTES))
def source_profile(spark, sf):
    """Every part as rows: the source, its sessions, events, payloads, and its score explained."""
    ev = events(spark, sf)
    payloads = ev.filter(F.col("payload_sha256").isNotNull()).select(
        F.col("payload_sha256").alias("sha256")).distinct()
    parts = P.source_profile("45.1.1.8", sources(spark, sf), build_sessions(ev), ev, payloads, as_of())
    row = lambda part, name, key, value: parts[part].select(
        F.lit(name).alias("part"), F.col(key).alias("key"), F.col(value).cast("double").alias("value"))
    why = parts["explanation"].select(F.explode(F.array(
        F.struct(F.lit("score").alias("key"), F.round("score", 1).alias("value")),
        *[F.struct(F.lit(n).alias("key"), F.round(f"components.{n}", 1).alias("value")) for n in _RAW])).alias("e"))
    carried = parts["payloads"].withColumn("us", micros("carried_at"))
    return (row("source", "source", "src_ip", "event_count").unionByName(row("sessions", "session", "session_id", "event_count"))
            .unionByName(row("recent_events", "event", "event_id", "src_port"))
            .unionByName(carried.select(F.lit("payload").alias("part"), F.col("sha256").alias("key"), F.col("us").cast("double").alias("value")))
            .unionByName(why.select(F.lit("explanation").alias("part"), "e.key", F.col("e.value").cast("double").alias("value"))))


@query("source_seek", sql("""
  SELECT src_ip, event_count, count(*) OVER () AS total FROM facts
  ORDER BY event_count DESC, src_ip LIMIT 40 OFFSET 10""", FACTS))
def source_seek(spark, sf):
    """A page by offset and the page behind its last row, from a stored listing."""
    from sablewatch.operators.listing import store_listing
    from sablewatch.session import shared_folder

    stored = store_listing(sources(spark, sf), shared_folder(spark, "listing"), "event_count", "src_ip", zone_rows=25)
    page = stored.page(20, 10)
    last = page.collect()[-1]
    return page.unionByName(stored.after(last.event_count, last.src_ip, 20)).select("src_ip", "event_count", "total")


@query("payloads_of_source", sql("""
  SELECT payload_sha256 AS sha256, max(epoch_us(ts)) AS carried_us FROM ev
  WHERE src_ip = '45.1.1.8' AND payload_sha256 IS NOT NULL GROUP BY 1
  ORDER BY 2 DESC, 1 LIMIT 20"""))
def payloads_for_source(spark, sf):
    ev = events(spark, sf)
    payloads = ev.filter(F.col("payload_sha256").isNotNull()).select(
        F.col("payload_sha256").alias("sha256")).distinct()
    return payloads_of_source(payloads, ev, "45.1.1.8").select(
        "sha256", micros("carried_at").alias("carried_us"))


_CUT = "TIMESTAMP '2024-01-18 06:30:00'"


@query("retention", sql(f"""
  SELECT 'events' AS name, event_id AS key, 1 AS n FROM ev WHERE ts >= {_CUT}
  UNION ALL SELECT 'sessions', session_id, count(*) FROM ev GROUP BY session_id HAVING min(ts) >= {_CUT}
  UNION ALL SELECT 'alerts', src_ip, count(*) FROM ev WHERE tag = 'payload-fetch' GROUP BY src_ip HAVING max(ts) >= {_CUT}
  UNION ALL SELECT 'sources', src_ip, count(*) FROM ev WHERE ts >= {_CUT} GROUP BY src_ip"""))
def retention(spark, sf):
    """Four tables after everything before a cutoff went, the sources rolled up from what is left."""
    import datetime as dt

    from sablewatch.catalog.detection import MATCH
    from sablewatch.operators.retention import apply_retention, write_by_day
    from sablewatch.operators.rules import evaluate_rules
    from sablewatch.session import shared_folder

    folder, ev = shared_folder(spark, "retention"), events(spark, sf)
    tables = {"events": (ev, "ts", "event_id"), "sessions": (build_sessions(ev), "started_at", "session_id"),
              "alerts": (evaluate_rules(ev, [MATCH]), "last_seen", "dedupe_key")}
    for name, (rows, ts, key) in tables.items():
        write_by_day(rows, f"{folder}/{name}", ts, key)
    left = apply_retention(spark, {n: (f"{folder}/{n}", ts) for n, (_, ts, _) in tables.items()},
                           dt.datetime(2024, 1, 18, 6, 30), sources(spark, sf), as_of())
    kept = lambda name, key, n: spark.read.parquet(f"{folder}/{name}").select(
        F.lit(name).alias("name"), F.col(key).alias("key"), n.cast("long").alias("n"))
    return (kept("events", "event_id", F.lit(1)).unionByName(kept("sessions", "session_id", F.col("event_count")))
            .unionByName(kept("alerts", "src_ip", F.col("hit_count")))
            .unionByName(left.select(F.lit("sources").alias("name"), F.col("src_ip").alias("key"), F.col("event_count").cast("long").alias("n"))))
