"""Tagging, enrichment and log-scan queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sablewatch.catalog.adapter import events, sql, texts
from sablewatch.catalog.registry import query
from sablewatch.constants import (
    GENERIC_USERNAMES,
    HTTP_PATTERNS,
    MALWARE_AGENTS,
    OPERATOR_WORDS,
    SCANNER_AGENTS,
    SEVERITY_RANK,
)
from sablewatch.functions import net, text
from sablewatch.functions.columns import micros
from sablewatch.operators import enrichment as E
from sablewatch.operators import tagging as T
from sablewatch.sources import dimensions as D
from sablewatch.sources import logs as L


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(*pairs: tuple[str, str]) -> str:
    """SQL list of the tags whose condition holds."""
    items = ", ".join(f"CASE WHEN {cond} THEN {q(tag)} END" for cond, tag in pairs)
    return f"[x FOR x IN [{items}] IF x IS NOT NULL]"


def _joined(name="tags"):
    return F.array_join(name, ",").alias("tags")


# --------------------------------------------------------------------------- #
# HTTP
# --------------------------------------------------------------------------- #

# "$" may stand before a final newline; SQL's may not, so that newline goes.
_HAY = "regexp_replace(url_decode(coalesce(path, '')) || chr(10) || coalesce(body, ''), '\\n$', '')"
_HTTP_TAGS = _list(*[(f"regexp_matches(hay, {q(p)})", t) for t, _, p in HTTP_PATTERNS],
                   ("http_method NOT IN ('GET','POST','HEAD','PUT','OPTIONS','DELETE','PATCH')",
                    "unusual-method"))
_RANK = "greatest(0, " + ", ".join(
    f"CASE WHEN list_contains(tags, {q(t)}) THEN {SEVERITY_RANK[s]} ELSE 0 END"
    for t, s, _ in (*HTTP_PATTERNS, ("unusual-method", "medium", ""))) + ")"


@query("http_tags", sql(f"""
  SELECT event_id, array_to_string(tags, ',') AS tags,
    ['info','low','medium','high','critical'][{_RANK} + 1] AS severity
  FROM (SELECT *, {_HTTP_TAGS} AS tags FROM (SELECT *, {_HAY} AS hay FROM ev
    WHERE service = 'http'))"""))
def http_tags(spark, sf):
    rows = events(spark, sf).filter(F.col("service") == "http")
    return T.tag_http(rows).select("event_id", _joined(), "severity")


@query("page_tags", f"""
  SELECT page_id, array_to_string({_list(*[(f"regexp_matches(hay, {q(p)})", t)
                                           for t, _, p in HTTP_PATTERNS])}, ',') AS tags
  FROM (SELECT page_id, url_decode(url) || chr(10) || html AS hay FROM pages)""")
def page_tags(spark, sf):
    pages = texts(spark, sf, "pages", "page_id").select("page_id", F.col("url").alias("path"),
                                            F.col("html").alias("body"),
                                            F.lit("GET").alias("http_method"))
    return T.tag_http(pages).select("page_id", _joined())


@query("document_tags", f"""
  SELECT doc_id, array_to_string({_list(*[(f"regexp_matches(chr(10) || text, {q(p)})", t)
                                          for t, _, p in HTTP_PATTERNS])}, ',') AS tags
  FROM documents""")
def document_tags(spark, sf):
    docs = texts(spark, sf, "documents", "doc_id").withColumn(
        "tags", T.pattern_tags(F.concat(F.lit("\n"), "text")))
    return docs.select("doc_id", _joined())


@query("login_credentials", sql("""
  SELECT event_id, CASE WHEN service = 'http' THEN 'admin' ELSE nullif(username, '') END
      AS username,
    CASE WHEN service = 'http' THEN 'pw' || k ELSE nullif(password, '') END AS password
  FROM ev WHERE (service = 'http' AND body IS NOT NULL)
    OR (username IS NOT NULL AND password IS NOT NULL)"""))
def login_credentials(spark, sf):
    rows = events(spark, sf).filter(
        ((F.col("service") == "http") & F.col("body").isNotNull())
        | (F.col("username").isNotNull() & F.col("password").isNotNull()))
    pair = F.concat("username", F.lit(":"), "password")
    header = F.concat(F.lit("Basic "), F.base64(F.encode(pair, "UTF-8")))
    rows = rows.withColumn("headers", F.when(
        F.col("username").isNotNull(), F.create_map(F.lit("authorization"), header)))
    return T.extract_credentials(rows).select("event_id", "username", "password")


# --------------------------------------------------------------------------- #
# Shell, logins, other protocols
# --------------------------------------------------------------------------- #


@query("shell_tags", sql("""
  SELECT event_id, CASE WHEN regexp_matches(c, 'wget|curl|tftp|busybox|chmod \\+x') THEN 'critical'
      WHEN regexp_matches(c, '/etc/shadow|passwd|authorized_keys') THEN 'high' ELSE 'medium' END
      AS severity,
    concat_ws(',', CASE WHEN c LIKE '%busybox%' THEN 'mirai-signature' END,
      CASE WHEN regexp_matches(c, 'wget|curl|tftp') THEN 'payload-fetch' END,
      CASE WHEN max(has_url) OVER (PARTITION BY session_id ORDER BY ts, event_id
        ROWS UNBOUNDED PRECEDING) = 1 THEN 'second-stage-url' END) AS tags
  FROM (SELECT *, lower(command) AS c, CAST(command LIKE 'wget http%' AS INT) AS has_url
        FROM ev WHERE service = 'telnet' AND command IS NOT NULL)"""))
def shell_tags(spark, sf):
    rows = events(spark, sf).filter((F.col("service") == "telnet") & F.col("command").isNotNull())
    return T.tag_shell(rows).select("event_id", "severity", _joined())


@query("default_logins", sql("""
  SELECT event_id, known, CASE WHEN known THEN 'high' ELSE 'medium' END AS severity FROM (
    SELECT event_id, coalesce((username, password) IN (('root','xc3511'),('root','admin'),
      ('admin','admin'),('root','888888'),('root','123456'),('support','support'),('root',''),
      ('admin','password'),('root','root'),('guest','guest'),('admin','')), FALSE)
      AND username IS NOT NULL AND password IS NOT NULL AS known
    FROM ev WHERE service IN ('ssh', 'telnet') AND event_type = 'auth_attempt')"""))
def default_logins(spark, sf):
    rows = events(spark, sf).filter(
        F.col("service").isin("ssh", "telnet") & (F.col("event_type") == "auth_attempt"))
    return T.tag_logins(rows).select(
        "event_id", (F.size("tags") == 1).alias("known"), "severity")


@query("redis_tags", sql("""
  SELECT event_id, CASE k % 6 WHEN 0 THEN 'redis-command,redis-config-abuse,redis-dangerous'
      WHEN 1 THEN 'redis-command,redis-rce-payload'
      WHEN 3 THEN 'redis-command,redis-replication-hijack,redis-dangerous'
      WHEN 4 THEN 'redis-auth' ELSE 'redis-command' END AS tags,
    CASE WHEN k % 6 IN (0, 1, 3) THEN 'critical' WHEN k % 6 = 4 THEN 'medium' ELSE 'low' END
      AS severity,
    CASE WHEN k % 6 = 4 THEN 'auth_attempt' ELSE 'command' END AS event_type
  FROM ev WHERE service = 'redis'"""))
def redis_tags(spark, sf):
    rows = events(spark, sf).filter(F.col("service") == "redis")
    return T.tag_redis(rows).select("event_id", _joined(), "severity", "event_type")


@query("docker_tags", sql("""
  SELECT event_id, ['containers-create','version','containers-start','images-create','other']
      [k % 5 + 1] AS route,
    CASE k % 5
      WHEN 0 THEN 'docker-api,docker-container-create,docker-abuse'
        || CASE k % 4 WHEN 0 THEN ',docker-host-mount,docker-host-takeover,docker-privileged'
           WHEN 1 THEN ',docker-cryptominer' WHEN 2 THEN ',docker-privileged' ELSE '' END
      WHEN 1 THEN 'docker-api,docker-recon' WHEN 2 THEN 'docker-api,docker-execute,docker-abuse'
      WHEN 3 THEN 'docker-api,docker-image-pull,docker-abuse'
        || CASE WHEN k % 4 = 1 THEN ',docker-cryptominer' ELSE '' END
      ELSE 'docker-api,docker-probe' END AS tags,
    CASE k % 5 WHEN 0 THEN CASE WHEN k % 4 < 3 THEN 'critical' ELSE 'high' END
      WHEN 1 THEN 'medium' WHEN 2 THEN 'critical'
      WHEN 3 THEN CASE WHEN k % 4 = 1 THEN 'critical' ELSE 'high' END ELSE 'low' END AS severity
  FROM ev WHERE service = 'docker'"""))
def docker_tags(spark, sf):
    rows = events(spark, sf).filter(F.col("service") == "docker")
    return T.tag_docker(rows).select("event_id", "route", _joined(), "severity")


@query("ftp_tags", sql("""
  SELECT event_id, ['ftp-anonymous','ftp-upload-attempt','ftp-bounce-attempt','ftp-list',
      'ftp-download-attempt'][k % 6 + 1] AS tags,
    ['auth_attempt','file_upload','command','command','command'][k % 6 + 1] AS event_type,
    ['medium','critical','high','low','medium'][k % 6 + 1] AS severity
  FROM ev WHERE service = 'ftp' AND k % 6 < 5"""))
def ftp_tags(spark, sf):
    rows = events(spark, sf).filter(F.col("service") == "ftp")
    return T.tag_ftp(rows).select("event_id", _joined(), "event_type", "severity")


@query("mysql_tags", sql("""
  SELECT event_id, CASE WHEN k % 8 < 4 THEN 'mysql-login' ELSE 'mysql-malformed-login' END AS tags,
    CASE WHEN k % 8 < 4 THEN 'auth_attempt' ELSE 'error' END AS event_type,
    CASE WHEN k % 8 < 4 THEN 'medium' ELSE 'low' END AS severity
  FROM ev WHERE service = 'mysql'"""))
def mysql_tags(spark, sf):
    rows = events(spark, sf).filter(F.col("service") == "mysql").withColumn(
        "username", F.when(F.col("k") % 8 < 4, F.col("username")))
    return T.tag_mysql(rows).select("event_id", _joined(), "event_type", "severity")


@query("tag_census", sql("""
  SELECT service, count(*) AS events, count(*) FILTER (tag <> '') AS kept FROM ev
  WHERE NOT coalesce(command = 'QUIT', FALSE) GROUP BY 1"""))
def tag_census(spark, sf):
    """The whole mixed table tagged at once; tags already on the event stay first."""
    ev = events(spark, sf).withColumn("_was", F.get("tags", F.lit(0)))
    tagged = T.tag_events(ev)
    return tagged.groupBy("service").agg(
        F.count("*").alias("events"),
        F.count_if(F.get("tags", F.lit(0)) == F.col("_was")).alias("kept"))


_BANNERS = ["SSH-2.0-OpenSSH_9.0", "SSH-2.0-libssh_0.9", "SSH-2.0-Go", "SSH-1.5-PuTTY", "junk"]


@query("banner_tags", sql("""
  SELECT event_id, ['', 'client:libssh', 'client:go', 'client:putty,ssh1-protocol',
    'malformed-banner'][k % 5 + 1] AS tags FROM ev WHERE service = 'ssh'"""))
def banner_tags(spark, sf):
    rows = events(spark, sf).filter(F.col("service") == "ssh")
    banner = F.element_at(F.array(*[F.lit(b) for b in _BANNERS]), (F.col("k") % 5 + 1).cast("int"))
    return rows.select("event_id", T.banner_tags(banner).alias("tags")).select(
        "event_id", _joined())


@query("hassh_census", sql("""
  SELECT md5('kex-' || k % 3 || ',curve;aes' || k % 2 || ';hmac;none') AS hassh,
    count(*) AS clients, count(DISTINCT src_ip) AS sources
  FROM ev WHERE service = 'ssh' GROUP BY 1"""))
def hassh_census(spark, sf):
    rows = events(spark, sf).filter(F.col("service") == "ssh")
    rows = rows.select(
        "src_ip",
        F.array(F.concat(F.lit("kex-"), F.col("k") % 3), F.lit("curve")).alias("kex"),
        F.array(F.concat(F.lit("aes"), F.col("k") % 2)).alias("ciphers"),
        F.array(F.lit("hmac")).alias("macs"), F.array(F.lit("none")).alias("compressions"))
    return T.hassh_census(rows).drop("algorithms")


@query("second_stage_urls", sql("""
  SELECT url, min(epoch_us(ts)) AS first_us FROM (
    SELECT ts, unnest(regexp_extract_all(command, '(?:https?|ftp|tftp)://[^\\s;''"|&)]+')) AS url
    FROM ev WHERE command ILIKE '%http://%' OR command ILIKE '%https://%' OR command ILIKE '%tftp%')
  GROUP BY 1"""))
def second_stage_urls(spark, sf):
    return T.second_stage_urls(events(spark, sf)).select(
        "url", micros("first_seen").alias("first_us"))


@query("defang_urls", """
  SELECT page_id, replace(CASE WHEN instr(url, 'http') > 0 THEN
    left(url, instr(url, 'http') - 1) || 'hxxp' || substr(url, instr(url, 'http') + 4)
    ELSE url END, '.', '[.]') AS url FROM pages""")
def defang_urls(spark, sf):
    return texts(spark, sf, "pages", "page_id").select("page_id", text.defang(F.col("url")).alias("url"))


# --------------------------------------------------------------------------- #
# Enrichment
# --------------------------------------------------------------------------- #

_ODD_IP = "(eid % 256) || '.' || (k + 100) || '.' || (uid % 256) || '.' || (eid // 256) % 256"
_N = "((eid % 256) * 16777216 + (k + 100) * 65536 + (uid % 256) * 256 + (eid // 256) % 256)"
_LONG = ("(CAST(split_part(ip,'.',1) AS BIGINT) * 16777216 + CAST(split_part(ip,'.',2) AS BIGINT)"
         " * 65536 + CAST(split_part(ip,'.',3) AS BIGINT) * 256"
         " + CAST(split_part(ip,'.',4) AS BIGINT))")
PREFIXES = [
    ("45.0.0.0/8", 64510, "Some Carrier"),
    ("45.1.0.0/16", 64500, "Hetzner Online"),
    ("45.1.1.0/24", 64501, "Deutsche Telecom Mobile"),
    ("45.1.1.128/25", 64502, ""),
    ("45.1.1.200/32", 64503, "Mullvad Relay University"),
    ("2001:db8::/32", 64999, "Documentation"),
]
INDICATORS = [
    ("ip", "45.1.1.5", "ti:alpha"), ("ip", "45.1.1.5", "ti:beta"), ("ip", "45.1.1.9", "ti:alpha"),
    ("cidr", "45.1.1.0/28", "ti:alpha"), ("cidr", "45.1.1.4/30", "ti:gamma"),
    ("cidr", "45.1.1.64/26", "ti:beta"), ("cidr", "45.1.0.0/16", "ti:wide"),
]


def _lo(cidr: str) -> tuple[int, int]:
    import ipaddress

    block = ipaddress.ip_network(cidr)
    return int(block.network_address), block.prefixlen


PREFIX_CTE = "prefixes AS (SELECT * FROM (VALUES " + ", ".join(
    f"({_lo(p)[0]}, {_lo(p)[1]}, {a}, {q(o)})" for p, a, o in PREFIXES if ":" not in p
) + ") t(lo, plen, asn, org))"
IP_CTE = f"ips AS (SELECT DISTINCT src_ip AS ip FROM ev), nums AS (SELECT ip, {_LONG} AS n FROM ips)"
_COVERS = "n >> (32 - plen) = lo >> (32 - plen)"
LPM_CTE = f"""lpm AS (SELECT ip, arg_max(asn, plen) AS asn, arg_max(org, plen) AS as_org
  FROM nums JOIN prefixes ON {_COVERS} GROUP BY ip)"""


def prefixes(spark):
    return spark.createDataFrame(PREFIXES, "prefix string, asn bigint, as_org string")


def indicators(spark):
    return spark.createDataFrame(INDICATORS, "kind string, value string, source string")


@query("address_scope", sql(f"""
  SELECT ip, CASE WHEN n >> 24 = 127 THEN 'loopback'
    WHEN n >> 24 IN (0, 10) OR n >> 20 = (172 * 256 + 16) >> 4 OR n >> 16 IN (49320, 43518)
      OR n >> 8 IN (12582912, 12582914) OR n >> 17 = (198 * 256 + 18) >> 1 OR n >> 8 = 12989284
      OR n >> 8 = 13303921 OR n >> 28 = 15 THEN 'private'
    WHEN n >> 28 = 14 THEN 'multicast' ELSE 'public' END AS scope
  FROM (SELECT DISTINCT {_ODD_IP} AS ip, {_N} AS n FROM ev)"""))
def address_scope(spark, sf):
    eid = F.col("event_id").cast("bigint")
    ip = F.concat_ws(".", eid % 256, F.col("k") + 100, F.col("uid") % 256,
                     F.floor(eid / 256) % 256)
    ips = events(spark, sf).select(ip.alias("ip")).distinct()
    return ips.select("ip", net.address_scope(F.col("ip")).alias("scope"))


@query("prefix_match", sql("""
  SELECT ip, asn, nullif(as_org, '') AS as_org,
    CASE WHEN asn IS NULL THEN 'unavailable' ELSE 'prefix-table' END AS asn_source
  FROM nums LEFT JOIN lpm USING (ip)""", PREFIX_CTE, IP_CTE, LPM_CTE))
def prefix_match(spark, sf):
    found = E.asn_lookup(E.distinct_addresses(events(spark, sf)), prefixes(spark))
    return found.select("ip", "asn", "as_org", "asn_source")


_ORG_TAGS = _list(*[
    ("regexp_matches(lower(as_org), " + q("|".join(words)) + ")", tag)
    for tag, words in OPERATOR_WORDS])


@query("operator_tags", sql(
    f"SELECT as_org, array_to_string({_ORG_TAGS}, ',') AS tags, count(*) AS events FROM ev "
    "WHERE as_org IS NOT NULL GROUP BY 1, 2"))
def operator_tags(spark, sf):
    rows = events(spark, sf).filter(F.col("as_org").isNotNull())
    return rows.select("as_org", F.array_join(E.operator_tags(F.col("as_org")), ",").alias(
        "tags")).groupBy("as_org", "tags").agg(F.count("*").alias("events"))


@query("geo_prefix_match", sql("""
  SELECT ip, CASE WHEN asn IS NOT NULL THEN 'C' || asn % 10 END AS country,
    CASE WHEN asn IS NULL THEN 'not-found' ELSE 'geolite2' END AS geo_source
  FROM nums LEFT JOIN lpm USING (ip)""", PREFIX_CTE, IP_CTE, LPM_CTE))
def geo_prefix_match(spark, sf):
    geo = prefixes(spark).select(
        F.col("prefix").alias("network"), F.concat(F.lit("C"), F.col("asn") % 10).alias("country"))
    return E.geo_lookup(E.distinct_addresses(events(spark, sf)), geo).select(
        "ip", "country", "geo_source")


_RANGES = [
    ("45.1.1.0", "45.1.1.100", "east"), ("45.1.1.144", "45.2.0.255", "west"), ("45.1.1.30", "45.1.1.61", "inner"),
    ("2600:0:13::", "2600:0:5a::7", "six"), ("2600:0:20::3", "2600:0:20::9", "six inner"),
    ("2600:0:70::", "45.9.9.9", "no range"), ("2600:0:99::", "2600:0:98::", "no range"),
]


@query("geo_range_match", sql("""
  SELECT ip, CASE WHEN n BETWEEN 755040542 AND 755040573 THEN 'inner' WHEN n BETWEEN 755040512 AND 755040612 THEN 'east'
      WHEN n BETWEEN 755040656 AND 755106047 THEN 'west' END AS place FROM nums
  UNION ALL SELECT DISTINCT '2600:0:' || format('{:x}', uid % 256) || '::' || format('{:x}', k),
    CASE WHEN uid % 256 = 32 AND k BETWEEN 3 AND 9 THEN 'six inner'
      WHEN uid % 256 BETWEEN 19 AND 89 OR (uid % 256 = 90 AND k <= 7) THEN 'six' END FROM ev""", IP_CTE))
def geo_range_match(spark, sf):
    """Ranges of both families; ends that make no range give nothing."""
    ranges = spark.createDataFrame(_RANGES, "lo string, hi string, place string")
    small = lambda c: F.lower(F.hex(c))
    v6 = F.concat(F.lit("2600:0:"), small(F.col("uid") % 256), F.lit("::"), small("k"))
    ev = events(spark, sf)
    both = ev.select("src_ip").unionByName(ev.select(v6.alias("src_ip")))
    return E.geo_range_lookup(E.distinct_addresses(both), ranges).select("ip", "place")


_IND = "indicators AS (SELECT * FROM (VALUES " + ", ".join(
    f"({q(k)}, {q(v)}, {q(s)}, {_lo(v)[0]}, {_lo(v)[1]})" for k, v, s in INDICATORS
) + ") t(kind, value, source, lo, plen))"
_LISTED = """exact AS (SELECT ip, list(source ORDER BY source) AS tags FROM nums
    JOIN indicators ON kind = 'ip' AND value = ip GROUP BY ip),
  net AS (SELECT ip, arg_max(source, plen) AS source FROM nums JOIN indicators
    ON kind = 'cidr' AND n >> (32 - plen) = lo >> (32 - plen) GROUP BY ip),
  listed AS (SELECT ip, 40.0 * coalesce(len(e.tags), 0)
      + CASE WHEN n.source IS NOT NULL AND NOT coalesce(list_contains(e.tags, n.source), FALSE)
        THEN 25.0 ELSE 0.0 END AS ti_score,
    list_concat(coalesce(e.tags, []), CASE WHEN n.source IS NOT NULL
      AND NOT coalesce(list_contains(e.tags, n.source), FALSE) THEN [n.source] ELSE [] END) AS tags
    FROM exact e FULL OUTER JOIN net n USING (ip))"""


@query("indicator_match", sql(
    "SELECT ip, ti_score, array_to_string(tags, ',') AS tags FROM listed", IP_CTE, _IND, _LISTED))
def indicator_match(spark, sf):
    found = E.indicator_lookup(E.distinct_addresses(events(spark, sf)), indicators(spark))
    return found.select("ip", "ti_score", F.array_join("ti_tags", ",").alias("tags"))


def _needle(needle: str) -> str:
    import re

    left = "(^|[^a-z0-9])" if needle[0].isalnum() else ""
    right = "([^a-z0-9]|$)" if needle[-1].isalnum() else ""
    return q(left + re.escape(needle).replace("\\ ", " ").replace("\\-", "-") + right)


_AGENT_PAIRS = [(f"regexp_matches(lower(user_agent), {_needle(n)})", t, s)
                for group, s in ((MALWARE_AGENTS, 30.0), (SCANNER_AGENTS, 15.0)) for n, t in group]
_AGENT_SCORE = " + ".join(f"CASE WHEN {c} THEN {s} ELSE 0 END" for c, _, s in _AGENT_PAIRS) + \
    " + CASE WHEN length(user_agent) < 8 THEN 5 ELSE 0 END"
_AGENT_TAGS = _list(*[(c, t) for c, t, _ in _AGENT_PAIRS],
                    ("length(user_agent) < 8", "ua:suspiciously-short"))
_AGENTS_CTE = f"""agents AS (SELECT DISTINCT user_agent, {_AGENT_SCORE} AS score,
  {_AGENT_TAGS} AS tags FROM ev WHERE user_agent <> '')"""


@query("agent_class", sql(
    "SELECT user_agent, CAST(score AS DOUBLE) AS score, array_to_string(tags, ',') AS tags "
    "FROM agents", _AGENTS_CTE))
def agent_class(spark, sf):
    return E.classify_agents(events(spark, sf)).select(
        "user_agent", F.col("agent.ti_score").alias("score"),
        F.array_join("agent.ti_tags", ",").alias("tags"))


_GENERIC = "lower(username) IN (" + ", ".join(map(q, GENERIC_USERNAMES)) + ")"


@query("username_class", sql(f"""
  SELECT username, CASE WHEN {_GENERIC} THEN 2.0 ELSE 0.0 END AS score,
    CASE WHEN {_GENERIC} THEN 'cred:generic-username' ELSE 'cred:specific-username' END AS tag,
    count(*) AS events FROM ev WHERE username <> '' GROUP BY 1, 2, 3"""))
def username_class(spark, sf):
    rows = events(spark, sf).filter(F.col("username") != "")
    sig = rows.select("username", E.username_signals(F.col("username")).alias("s"))
    return sig.groupBy("username", F.col("s.ti_score").alias("score"),
                       F.col("s.ti_tags")[0].alias("tag")).agg(F.count("*").alias("events"))


@query("enrich_events", sql(f"""
  SELECT event_id, p.asn, CASE WHEN p.asn IS NULL THEN 'not-found' ELSE 'geolite2' END AS geo_source,
    coalesce(l.ti_score, 0) + coalesce(a.score, 0)
      + CASE WHEN username <> '' AND {_GENERIC} THEN 2.0 ELSE 0.0 END AS threat_score,
    array_to_string(list_concat(coalesce(l.tags, []), coalesce(a.tags, []),
      CASE WHEN username <> '' THEN [CASE WHEN {_GENERIC} THEN 'cred:generic-username'
        ELSE 'cred:specific-username' END] ELSE [] END,
      CASE WHEN p.as_org <> '' THEN {_ORG_TAGS.replace("as_org", "p.as_org")} ELSE [] END), ',')
      AS tags
  FROM ev LEFT JOIN lpm p ON p.ip = src_ip LEFT JOIN listed l ON l.ip = src_ip
  LEFT JOIN agents a ON a.user_agent = ev.user_agent""",
  PREFIX_CTE, IP_CTE, LPM_CTE, _IND, _LISTED, _AGENTS_CTE))
def enrich_events(spark, sf):
    geo = prefixes(spark).select(F.col("prefix").alias("network"),
                                 F.lit("XX").alias("country"))
    rows = E.enrich_events(events(spark, sf), geo, prefixes(spark), indicators(spark))
    return rows.select("event_id", "asn", "geo_source", "threat_score",
                       F.array_join("threat_tags", ",").alias("tags"))


@query("address_report", sql("""
  SELECT ip AS src_ip, 4 AS version, 'public' AS scope, FALSE AS is_bogon, p.asn,
    coalesce(l.ti_score, 0.0) AS threat_score
  FROM nums LEFT JOIN lpm p USING (ip) LEFT JOIN listed l USING (ip)""",
  PREFIX_CTE, IP_CTE, LPM_CTE, _IND, _LISTED))
def address_report(spark, sf):
    ips = events(spark, sf).select("src_ip")
    facts = E.describe_addresses(ips, None, prefixes(spark), indicators(spark))
    return facts.select("src_ip", "version", "scope", "is_bogon", "asn", "threat_score")


@query("indicator_upsert", sql("""
  SELECT source, count(*) AS rows, sum(CASE WHEN kind = 'ip' THEN 40.0 ELSE 25.0 END) AS score
  FROM (SELECT kind, value, source FROM indicators
        UNION SELECT DISTINCT 'ip', src_ip, 'ti:alpha' FROM ev WHERE tag = 'log4shell')
  GROUP BY source""", _IND))
def indicator_upsert(spark, sf):
    stored = indicators(spark).withColumn("category", F.lit("generic")).withColumn(
        "score", F.when(F.col("kind") == "ip", 40.0).otherwise(25.0)).withColumn(
        "enabled", F.lit(True))
    seen = events(spark, sf).filter(F.array_contains("tags", "log4shell")).select(
        F.lit("ip").alias("kind"), F.col("src_ip").alias("value"), F.lit("ti:alpha").alias("source"))
    return E.add_indicators(stored, seen).groupBy("source").agg(
        F.count("*").alias("rows"), F.sum("score").alias("score"))


@query("indicator_stats", sql("""
  SELECT count(DISTINCT src_ip) AS ip_indicators, 0 AS cidr_indicators,
    count(DISTINCT country) AS sources FROM ev WHERE country IS NOT NULL"""))
def indicator_stats(spark, sf):
    rows = events(spark, sf).filter(F.col("country").isNotNull()).select(
        F.lit("ip").alias("kind"), F.col("src_ip").alias("value"),
        F.col("country").alias("source")).distinct()
    return E.indicator_stats(rows)


# --------------------------------------------------------------------------- #
# Log scans, over lines written from the events
# --------------------------------------------------------------------------- #


@query("jsonl_scan", sql("""
  SELECT event_id, epoch_us(ts) // 1000 AS ts_ms, service, username, tag, 'note' AS folded,
    'day.jsonl' AS imported_from FROM ev WHERE kind <> 9"""))
def jsonl_scan(spark, sf):
    ev = events(spark, sf)
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    record = F.struct("event_id", stamp.alias("ts"), "service", "username", "tags",
                      F.lit("note").alias("remark"))
    line = F.when(F.col("kind") == 9, F.lit('{"event_id": "torn')).otherwise(F.to_json(record))
    lines = ev.select(line.alias("line"), F.lit("day.jsonl").alias("_file"))
    parsed = L.parse_event_json(lines, fold_unknown=True)
    return parsed.select(
        "event_id", F.floor(micros("ts") / 1000).alias("ts_ms"), "service", "username",
        F.coalesce(F.get("tags", F.lit(0)), F.lit("")).alias("tag"),
        F.col("extra")["remark"].alias("folded"), F.col("extra")["imported_from"].alias(
            "imported_from"))


@query("cowrie_scan", sql("""
  SELECT session_id, event_type, severity, service, username, command, count(*) AS events,
    count(*) FILTER (fetched) AS fetches
  FROM (SELECT session_id, CASE WHEN event_type = 'auth_attempt' THEN 'auth_attempt'
      WHEN event_type = 'auth_success' THEN 'auth_success' ELSE 'command' END AS event_type,
    CASE WHEN event_type = 'auth_attempt' THEN 'medium' ELSE 'high' END AS severity,
    CASE WHEN kind = 4 THEN 'telnet' ELSE 'ssh' END AS service, username, command,
    coalesce(regexp_matches(lower(command), 'wget|curl|tftp'), FALSE) AS fetched
    FROM ev WHERE kind IN (0, 4, 11)) GROUP BY ALL"""))
def cowrie_scan(spark, sf):
    ev = events(spark, sf).filter(F.col("kind").isin(0, 4, 11, 5))
    eventid = (
        F.when(F.col("kind") == 0, "cowrie.login.failed")
        .when(F.col("kind") == 11, "cowrie.login.success")
        .when(F.col("kind") == 4, "cowrie.command.input")
        .otherwise("cowrie.log.closed"))
    record = F.struct(
        eventid.alias("eventid"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias(
            "timestamp"),
        F.col("session_id").alias("session"), "src_ip", "src_port", "username", "password",
        F.when(F.col("kind") == 4, "telnet").alias("protocol"), F.col("command").alias("input"))
    lines = ev.select(F.to_json(record).alias("line"), F.lit("c.json").alias("_file"))
    rows = L.parse_cowrie(lines, "sensor-9")
    return rows.groupBy("session_id", "event_type", "severity", "service", "username",
                        "command").agg(
        F.count("*").alias("events"),
        F.count_if(F.array_contains("tags", "payload-fetch")).alias("fetches"))


@query("auth_log_scan", sql("""
  SELECT src_ip, event_type, CASE event_type WHEN 'auth_success' THEN 'high' ELSE 'medium' END
    AS severity, username, src_port, epoch_us(date_trunc('second', ts)) AS us
  FROM ev WHERE kind IN (0, 1, 11) AND username IS NOT NULL"""))
def auth_log_scan(spark, sf):
    ev = events(spark, sf).filter(F.col("kind").isin(0, 1, 2, 11))
    ok, bad = F.col("kind") == 11, F.col("kind") == 0
    what = F.when(ok, "Accepted password for ").when(
        bad, "Failed password for invalid user ").when(
        F.col("kind") == 1, "Failed password for ").otherwise("Connection closed by ")
    line = F.concat(F.date_format("ts", "MMM d HH:mm:ss"), F.lit(" box sshd[7]: "), what,
                    "username", F.lit(" from "), "src_ip", F.lit(" port "), "src_port",
                    F.lit(" ssh2"))
    lines = ev.select(line.alias("line"), F.lit("auth.log").alias("_file"),
                      F.lit("2024-06-01").cast("timestamp").alias("_mtime"))
    rows = L.parse_auth_log(lines, "sensor-2", as_of=F.lit("2024-06-01").cast("timestamp"))
    return rows.select("src_ip", "event_type", "severity", "username", "src_port",
                       micros("ts").alias("us"))


@query("feed_clean", sql("""
  SELECT CASE WHEN uid % 3 = 0 THEN src_ip || '/24' ELSE src_ip END AS value,
    CASE WHEN uid % 3 = 0 THEN 'cidr' ELSE 'ip' END AS kind, count(*) AS n
  FROM ev WHERE kind <> 5 GROUP BY 1, 2"""))
def feed_clean(spark, sf):
    ev = events(spark, sf)
    token = F.when(F.col("uid") % 3 == 0, F.concat("src_ip", F.lit("/24"))).otherwise(
        F.col("src_ip"))
    line = F.when(F.col("kind") == 5, F.concat(token, F.lit("/99 bad"))).when(
        F.col("kind") == 6, F.concat(token, F.lit(" ; note"))).otherwise(
        F.concat(F.lit("  "), token, F.lit("\t7 # note")))
    return D.clean_feed(ev.select(line.alias("value")), "ti:feed").groupBy("value", "kind").agg(
        F.count("*").alias("n"))


@query("prefix_scan", sql("""
  SELECT src_ip || '/' || (8 + uid % 25) AS prefix, 64500 + uid AS asn, 'Org ' || uid AS as_org
  FROM ev WHERE kind < 9 GROUP BY ALL"""))
def prefix_scan(spark, sf):
    ev = events(spark, sf).filter(F.col("kind") < 10)
    prefix = F.concat("src_ip", F.lit("/"), F.lit(8) + F.col("uid") % 25)
    asn, org = F.lit(64500) + F.col("uid"), F.concat(F.lit("Org "), "uid")
    line = F.when(F.col("kind") == 9, F.lit("# comment")).when(
        F.col("kind") % 3 == 0, F.concat_ws("\t", prefix, F.concat(F.lit("AS"), asn), org)).when(
        F.col("kind") % 3 == 1, F.concat_ws("  ", prefix, asn, org)).otherwise(
        F.concat_ws(",", prefix, asn, org))
    return D.parse_prefixes(ev.select(line.alias("value"))).distinct()
