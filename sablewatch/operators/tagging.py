"""Attack-pattern tags and severities over event columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sablewatch.constants import (
    COMMAND_WRAPPERS,
    DEFAULT_LOGINS,
    DOCKER_EXEC_ROUTES,
    DOCKER_HOST_BIND,
    DOCKER_MINER_IMAGE,
    DOCKER_RECON_ROUTES,
    DOCKER_ROUTES,
    FETCH_TOOLS,
    FTP_ANONYMOUS,
    FTP_SILENT_VERBS,
    FTP_VERBS,
    HTTP_PATTERNS,
    LOGIN_FORM_FIELDS,
    REDIS_CRITICAL_VERBS,
    REDIS_PAYLOAD_MARKS,
    REDIS_VERB_TAGS,
    SECOND_STAGE_URL,
    SEVERITY_RANK,
    SHELL_CRITICAL,
    SHELL_HIGH,
    SSH_BANNER_NEEDLES,
    USUAL_HTTP_METHODS,
)
from sablewatch.functions.columns import (
    contains_any,
    empty_strings,
    has_text,
    literal_map,
    severity_name,
    strings_or_empty,
    tag_list,
)
from sablewatch.functions.net import let
from sablewatch.functions.skew import join_facts
from sablewatch.functions.text import percent_decode
from sablewatch.schemas import column_or_null



def _labels(tags: Column, severity: Column, event_type: Column | None = None) -> Column:
    """What a protocol says about an event: ``event_type`` null means unchanged."""
    kind = event_type if event_type is not None else F.lit(None).cast("string")
    return F.struct(
        kind.alias("event_type"), severity.alias("severity"), tags.alias("tags")
    )


def _apply(df: DataFrame, labels: Column) -> DataFrame:
    out = df.withColumn("_labels", labels)
    kept = column_or_null(df, "event_type")
    return (
        out.withColumn("event_type", F.coalesce("_labels.event_type", kept))
        .withColumn("severity", F.col("_labels.severity"))
        .withColumn("tags", F.col("_labels.tags"))
        .drop("_labels")
    )


# --------------------------------------------------------------------------- #
# HTTP
# --------------------------------------------------------------------------- #


def http_haystack(path: Column, body: Column, headers: Column) -> Column:
    """Decoded path, body and header lines as the one text patterns run on."""
    lines = F.transform(
        F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"])
    )
    return F.concat_ws(
        "\n",
        F.coalesce(percent_decode(path), F.lit("")),
        F.coalesce(body, F.lit("")),
        strings_or_empty(lines),
    )


def pattern_tags(haystack: Column) -> Column:
    # (?d): only a newline ends a line, so "$" also matches before a last one.
    return tag_list(*[(haystack.rlike("(?d)" + p), tag) for tag, _, p in HTTP_PATTERNS])


def severity_of_tags(tags: Column, ranks: dict[str, int]) -> Column:
    """Highest rank among the tags, 0 (info) when none is ranked."""
    table = literal_map(ranks)
    return F.coalesce(
        F.array_max(F.transform(tags, lambda t: F.try_element_at(table, t))), F.lit(0)
    )


_HTTP_RANKS = {tag: SEVERITY_RANK[s] for tag, s, _ in HTTP_PATTERNS} | {
    "unusual-method": SEVERITY_RANK["medium"]
}


def http_labels(df: DataFrame, body: str = "body") -> Column:
    headers = column_or_null(df, "headers", "map<string,string>")
    text = http_haystack(column_or_null(df, "path"), column_or_null(df, body), headers)
    unusual = F.coalesce(~column_or_null(df, "http_method").isin(*USUAL_HTTP_METHODS), F.lit(False))
    # The text is decoded once for all ten patterns.
    tags = F.concat(let(text, pattern_tags), tag_list((unusual, "unusual-method")))
    return let(
        tags,
        lambda t: _labels(t, severity_name(severity_of_tags(t, _HTTP_RANKS))),
    )


def tag_http(df: DataFrame, body: str = "body") -> DataFrame:
    """Add ``tags`` and ``severity`` from path, body, headers and method."""
    return _apply(df, http_labels(df, body))


def basic_credentials(authorization: Column) -> Column:
    """Struct ``(username, password)`` of a Basic header, null when there is none."""
    encoded = F.trim(F.substring(authorization, F.lit(7), F.length(authorization)))
    decoded = F.try_to_binary(encoded, F.lit("base64"))
    text = F.decode(decoded, "UTF-8")
    pair = let(
        text,
        lambda t: F.when(
            t.contains(":"),
            F.struct(
                F.substring_index(t, ":", 1).alias("username"),
                F.substring(t, F.locate(":", t) + 1, F.length(t)).alias("password"),
            ),
        ),
    )
    return F.when(F.lower(authorization).startswith("basic "), pair)


def form_credentials(body: Column) -> Column:
    """Struct ``(username, password)`` from the login fields of a form body.

    When several user fields are present the last one wins, and a repeated
    field counts with its first value.
    """
    fields = F.transform(
        F.filter(F.split(body, "&"), lambda p: p.contains("=")),
        lambda p: F.struct(
            percent_decode(F.substring_index(p, "=", 1)).alias("k"),
            percent_decode(F.substring(p, F.locate("=", p) + 1, F.length(p))).alias("v"),
        ),
    )

    def pick(items: Column, is_password: bool) -> Column:
        secret = lambda k: F.lower(k).contains("pass") | (F.lower(k) == "pwd")
        wanted = F.filter(
            items,
            lambda f: F.lower(f["k"]).isin(*LOGIN_FORM_FIELDS)
            & (secret(f["k"]) if is_password else ~secret(f["k"])),
        )
        last_name = F.get(F.array_distinct(F.transform(wanted, lambda f: f["k"])), F.size(
            F.array_distinct(F.transform(wanted, lambda f: f["k"]))) - 1)
        return F.get(F.filter(wanted, lambda f: f["k"] == last_name), F.lit(0))["v"]

    return F.when(
        body.contains("="),
        let(
            fields,
            lambda f: F.struct(
                pick(f, False).alias("username"),
                pick(f, True).alias("password"),
            ),
        ),
    )


def extract_credentials(df: DataFrame, body: str = "body", limit: int | None = None) -> DataFrame:
    """Add ``username`` and ``password``: Basic header first, else form fields.

    ``limit`` keeps their first characters only; then long values may become one.
    """
    headers = column_or_null(df, "headers", "map<string,string>")
    basic = basic_credentials(F.try_element_at(headers, F.lit("authorization")))
    out = df.withColumn("_basic", basic).withColumn(
        "_form", form_credentials(column_or_null(df, body))
    )
    cut = lambda c: c if limit is None else F.left(c, F.lit(limit))
    keep = lambda c: F.when(has_text(c), cut(c))
    from_header = F.col("_basic").isNotNull()
    return (
        out.withColumn(
            "username",
            keep(F.when(from_header, F.col("_basic.username")).otherwise(F.col("_form.username"))),
        )
        .withColumn(
            "password",
            keep(F.when(from_header, F.col("_basic.password")).otherwise(F.col("_form.password"))),
        )
        .drop("_basic", "_form")
    )


# --------------------------------------------------------------------------- #
# Shell
# --------------------------------------------------------------------------- #


def shell_severity(command: Column) -> Column:
    lowered = F.lower(command)
    return (
        F.when(contains_any(lowered, SHELL_CRITICAL), "critical")
        .when(contains_any(lowered, SHELL_HIGH), "high")
        .otherwise("medium")
    )


def requests_url(command: Column) -> Column:
    """Does the first command of the line hand wget or curl a URL?"""
    head = F.trim(F.get(F.split(F.trim(command), r"[;&|]{1,2}"), F.lit(0)))
    wrappers = "|".join(COMMAND_WRAPPERS)
    tool = r"(?:\S*/)?(?:wget|curl)"
    return head.rlike(rf"^(?:(?:{wrappers})\s+)*{tool}\s(?:.*\s)?(?:http|https|ftp)://")


def with_first_url(events: DataFrame) -> DataFrame:
    """Add ``_later``: has the session asked for a URL by this event?

    A minimum per session joined back, not a running window, so a long session
    is not gathered in one task.
    """
    position = F.struct("ts", "event_id")
    first = (
        events.filter(requests_url(F.col("command")))
        .groupBy("session_id")
        .agg(F.min(position).alias("_first_url"))
    )
    # Only commands can come later than a URL; the rest keeps out of its session's task.
    asks = F.col("command").isNotNull()
    return (
        join_facts(events, first, "session_id", asks, F.col("event_id"))
        .withColumn("_later", F.coalesce(position >= F.col("_first_url"), F.lit(False)))
        .drop("_first_url")
    )


def shell_labels() -> Column:
    lowered = F.lower("command")
    tags = tag_list(
        (lowered.contains("busybox"), "mirai-signature"),
        (contains_any(lowered, FETCH_TOOLS), "payload-fetch"),
        (F.col("_later"), "second-stage-url"),
    )
    return _labels(tags, shell_severity(F.col("command")))


def tag_shell(events: DataFrame) -> DataFrame:
    """Add ``tags`` and ``severity`` to shell commands."""
    return _apply(with_first_url(events), shell_labels()).drop("_later")


def second_stage_urls(events: DataFrame, limit: int | None = None) -> DataFrame:
    """URLs named in commands, in order of first sighting."""
    command = F.col("command")
    mentions = command.ilike("%http://%") | command.ilike("%https://%") | command.ilike("%tftp%")
    found = (
        events.filter(mentions)
        .select(
            "ts", "event_id",
            F.posexplode(F.regexp_extract_all(command, F.lit(SECOND_STAGE_URL), F.lit(0))).alias(
                "pos", "url"
            ),
        )
        .groupBy("url")
        .agg(F.min(F.struct("ts", "event_id", "pos")).alias("first"))
        .orderBy("first")
    )
    kept = found if limit is None else found.limit(limit)
    return kept.select("url", F.col("first.ts").alias("first_seen"))


# --------------------------------------------------------------------------- #
# Logins
# --------------------------------------------------------------------------- #


def is_default_login(username: Column, password: Column) -> Column:
    pair = F.concat(username, F.lit("\0"), password)
    return F.coalesce(pair.isin([f"{u}\0{p}" for u, p in DEFAULT_LOGINS]), F.lit(False))


def login_labels() -> Column:
    known = is_default_login(F.col("username"), F.col("password"))
    return _labels(
        tag_list((known, "iot-default-credential")), F.when(known, "high").otherwise("medium")
    )


def tag_logins(events: DataFrame) -> DataFrame:
    return _apply(events, login_labels())


def mysql_labels() -> Column:
    """A login with a readable user name, else a malformed one."""
    ok = F.col("username").isNotNull()
    return _labels(
        F.array(F.when(ok, "mysql-login").otherwise("mysql-malformed-login")),
        F.when(ok, "medium").otherwise("low"),
        F.when(ok, "auth_attempt").otherwise("error"),
    )


def tag_mysql(events: DataFrame) -> DataFrame:
    return _apply(events, mysql_labels())


# --------------------------------------------------------------------------- #
# Redis, Docker, FTP
# --------------------------------------------------------------------------- #


def redis_labels() -> Column:
    verb = F.lower(F.get(F.split(F.col("command"), r"\s+"), F.lit(0)))
    danger = F.try_element_at(literal_map(REDIS_VERB_TAGS), verb)
    auth = F.coalesce(verb == "auth", F.lit(False))
    payload = (verb == "set") & contains_any(F.col("command"), REDIS_PAYLOAD_MARKS)
    tags = F.when(auth, F.array(F.lit("redis-auth"))).otherwise(
        tag_list(
            (F.lit(True), "redis-command"),
            (danger.isNotNull(), danger),
            (danger.isNotNull(), "redis-dangerous"),
            (payload, "redis-rce-payload"),
        )
    )
    severity = (
        F.when(auth, "medium")
        .when(payload | verb.isin(*REDIS_CRITICAL_VERBS), "critical")
        .when(danger.isNotNull(), "high")
        .otherwise("low")
    )
    return _labels(tags, severity, F.when(auth, "auth_attempt").otherwise("command"))


def tag_redis(events: DataFrame) -> DataFrame:
    """Add ``event_type, tags, severity`` from the command's verb and text."""
    return _apply(events, redis_labels())


def docker_route(path: Column) -> Column:
    route = F.lit("other")
    for label, pattern in reversed(DOCKER_ROUTES):
        route = F.when(path.rlike(pattern), label).otherwise(route)
    return route


def docker_privileged(body: Column) -> Column:
    """Privileged or host-PID request; unreadable JSON is judged on its text."""
    parsed = F.try_parse_json(body)
    is_object = F.trim(body).startswith("{")
    flag = F.lower(F.get_json_object(body, "$.HostConfig.Privileged"))
    truthy = flag.isNotNull() & ~flag.isin("false", "0", "", "null", "{}", "[]")
    host_pid = F.get_json_object(body, "$.HostConfig.PidMode") == "host"
    raw = body.contains('"Privileged": true') | body.contains('"Privileged":true')
    return F.coalesce(
        F.when(is_object & parsed.isNotNull(), truthy | F.coalesce(host_pid, F.lit(False))).when(
            is_object, raw
        ),
        F.lit(False),
    )


def docker_labels(df: DataFrame, body: str = "body") -> Column:
    text = F.coalesce(column_or_null(df, body), F.lit(""))

    def judge(route: Column) -> Column:
        create, pull = route == "containers-create", route == "images-create"
        recon, execute = route.isin(*DOCKER_RECON_ROUTES), route.isin(*DOCKER_EXEC_ROUTES)
        bind = create & text.rlike(DOCKER_HOST_BIND)
        privileged = create & docker_privileged(text)
        miner = (create | pull) & text.rlike(DOCKER_MINER_IMAGE)
        tags = tag_list(
            (F.lit(True), "docker-api"),
            (recon, "docker-recon"),
            (create, "docker-container-create"),
            (pull, "docker-image-pull"),
            (execute, "docker-execute"),
            (create | pull | execute, "docker-abuse"),
            (bind, "docker-host-mount"),
            (bind, "docker-host-takeover"),
            (privileged, "docker-privileged"),
            (miner, "docker-cryptominer"),
            (route == "other", "docker-probe"),
        )
        severity = (
            F.when(execute | bind | privileged | miner, "critical")
            .when(create | pull, "high")
            .when(recon, "medium")
            .otherwise("low")
        )
        return _labels(tags, severity)

    return let(docker_route(F.col("path")), judge)


def tag_docker(events: DataFrame, body: str = "body") -> DataFrame:
    """Add ``route, tags, severity`` of a container-daemon call."""
    return _apply(events, docker_labels(events, body)).withColumn(
        "route", docker_route(F.col("path"))
    )


def ftp_verb() -> Column:
    return F.upper(F.substring_index(F.trim("command"), " ", 1))


def ftp_labels() -> Column:
    argument = F.trim(F.regexp_replace(F.trim("command"), r"^\S+", ""))
    table = literal_map({v: f"{t}|{s}|{g}" for v, t, s, g in FTP_VERBS})
    user_tag = F.when(F.lower(argument).isin(*FTP_ANONYMOUS), "ftp-anonymous").otherwise(
        "ftp-user"
    )
    entry = F.when(
        ftp_verb() == "USER", F.concat(F.lit("auth_attempt|medium|"), user_tag)
    ).otherwise(F.coalesce(F.try_element_at(table, ftp_verb()), F.lit("command|low|ftp-unknown")))
    return let(F.split(entry, r"\|"), lambda p: _labels(F.array(p[2]), p[1], p[0]))


def ftp_recorded() -> Column:
    """Commands that leave an event."""
    return F.col("command").isNotNull() & ~ftp_verb().isin(*FTP_SILENT_VERBS)


def tag_ftp(events: DataFrame) -> DataFrame:
    """Add ``event_type, tags, severity``; verbs that leave no event are dropped."""
    return _apply(events.filter(ftp_recorded()), ftp_labels())


# --------------------------------------------------------------------------- #
# SSH
# --------------------------------------------------------------------------- #


def banner_tags(banner: Column) -> Column:
    lowered = F.lower(banner)
    ssh1 = banner.startswith("SSH-1.")
    return tag_list(
        *[(lowered.contains(n), f"client:{n}") for n in SSH_BANNER_NEEDLES],
        (~banner.startswith("SSH-2.0-") & ~ssh1, "malformed-banner"),
        (ssh1, "ssh1-protocol"),
    )


def hassh(kex: Column, ciphers: Column, macs: Column, compressions: Column) -> Column:
    """Client fingerprint: MD5 over the four offered algorithm lists."""
    return F.md5(hassh_algorithms(kex, ciphers, macs, compressions))


def hassh_algorithms(*lists: Column) -> Column:
    joined = [F.array_join(strings_or_empty(c), ",") for c in lists]
    return F.concat_ws(";", *joined)


def hassh_census(clients: DataFrame) -> DataFrame:
    """``hassh, algorithms, clients, sources`` over ``kex, ciphers, macs, compressions``."""
    lists = [F.col(c) for c in ("kex", "ciphers", "macs", "compressions")]
    return (
        clients.withColumn("hassh", hassh(*lists))
        .groupBy("hassh")
        .agg(
            F.min(hassh_algorithms(*lists)).alias("algorithms"),
            F.count("*").alias("clients"),
            F.count_distinct("src_ip").alias("sources"),
        )
    )


# --------------------------------------------------------------------------- #
# Any event
# --------------------------------------------------------------------------- #

def tag_events(events: DataFrame, body: str = "body") -> DataFrame:
    """Tag a mixed event table in one projection, each protocol by its own rule.

    Tags a live exchange put on the event stay; derived ones follow them.
    """
    service, kind = F.col("service"), F.col("event_type")
    given = strings_or_empty(column_or_null(events, "tags", "array<string>"))
    shell = has_text("command") & service.isin("ssh", "telnet")
    unchanged = _labels(empty_strings(), column_or_null(events, "severity"))
    labels = (
        F.when(service == "http", http_labels(events, body))
        .when(service == "redis", redis_labels())
        .when(service == "docker", docker_labels(events, body))
        .when(service == "ftp", ftp_labels())
        .when(service == "mysql", mysql_labels())
        .when(shell, shell_labels())
        .when(kind == "auth_attempt", login_labels())
        .otherwise(unchanged)
    )
    rows = events.withColumn("_given", given)
    rows = with_first_url(rows).filter(
        F.coalesce(service != "ftp", F.lit(True)) | ftp_recorded()
    )
    return (
        _apply(rows, labels)
        .withColumn("tags", F.array_distinct(F.concat("_given", "tags")))
        .select(*dict.fromkeys([*events.columns, "tags", "severity"]))
    )
