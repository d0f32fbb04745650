"""The daily summary and the short digest cut from it.

The event sections come from one pass: each event gives its cells (section, key), one
aggregation with map-side combine counts them, and every top list, row count and
counter is read from that table of distinct values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sablewatch.constants import SECOND_STAGE_URL, SEVERITY_RANK
from sablewatch.functions.columns import has_text, micros, since
from sablewatch.functions.text import defang
from sablewatch.functions.topk import by_key, first_k
from sablewatch.operators.aggregates import credential_pair
from sablewatch.schemas import column_or_null
from sablewatch.session import cut_lineage

SECTIONS = ("stats", "services", "top_countries", "top_asns", "top_usernames", "top_passwords", "top_paths",
            "top_commands", "credential_pairs", "payload_urls", "alerts_by_severity", "alerts_by_rule",
            "notable_alerts", "top_sources", "new_sources")
DIGEST_SECTIONS = ("notable_alerts", "top_sources", "top_usernames", "top_passwords", "payload_urls")
_COUNTED = ("services", "top_countries", "top_asns")
_ROW = ("section", "key", "second", "label", "value", "sources", "sort", "tie")


def top_sources(sources: DataFrame, hours: float, as_of: Column, n: int) -> DataFrame:
    return (
        since(sources, hours, as_of, "last_seen")
        .orderBy(F.desc("threat_score"), "src_ip")
        .limit(n)
    )


def new_arrivals(top: DataFrame, hours: float, as_of: Column) -> DataFrame:
    """Of the top sources, those never seen before the window."""
    return since(top, hours, as_of, "first_seen")


# --------------------------------------------------------------------------- #
# Events: one pass
# --------------------------------------------------------------------------- #


def event_cells(events: DataFrame) -> DataFrame:
    """``section, key, second, label, n, sources, first`` of every distinct value.

    ``sources`` counts distinct sources where a section shows them. Besides the
    sections that are shown, ``sources`` and ``pairs`` hold what only counters need,
    and ``totals`` the plain counts.
    """
    none = F.lit(None).cast("string")

    def cell(when: Column, section: str, key: Column, second: Column = none, label: Column = none) -> Column:
        own = F.col("src_ip") if section in _COUNTED else none
        return F.when(when, F.struct(
            F.lit(section).alias("section"), key.cast("string").alias("key"), second.alias("second"),
            label.alias("label"), own.alias("src"), F.lit(None).cast("int").alias("pos")))

    c = lambda name: column_or_null(events, name)
    login = F.col("event_type") == "auth_attempt"
    always = F.lit(True)
    cells = F.array_compact(F.array(
        cell(always, "totals", F.lit("total_events")),
        cell(login, "totals", F.lit("auth_attempts")),
        cell(F.col("event_type") == "command", "totals", F.lit("commands_run")),
        cell(F.col("src_ip").isNotNull(), "sources", F.col("src_ip")),
        cell(login, "pairs", credential_pair()),
        cell(always, "services", c("service")),
        cell(c("country").isNotNull(), "top_countries", c("country"), label=c("country_name")),
        cell(c("asn").isNotNull(), "top_asns", c("asn"), label=c("as_org")),
        *[cell(has_text(c(name)), f"top_{name}s", c(name)) for name in ("username", "password", "path", "command")],
        cell(login & c("username").isNotNull(), "credential_pairs", c("username"), c("password")),
    ))
    mentions = c("command").ilike("%http://%") | c("command").ilike("%https://%") | c("command").ilike("%tftp%")
    found = F.when(mentions, F.regexp_extract_all(c("command"), F.lit(SECOND_STAGE_URL), F.lit(0)))
    urls = F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda u, i: F.struct(
        F.lit("payload_urls").alias("section"), u.alias("key"), none.alias("second"), none.alias("label"),
        none.alias("src"), i.alias("pos")))
    spread = events.select("ts", "event_id", F.explode(F.concat(cells, urls)).alias("c")).select("ts", "event_id", "c.*")
    first = F.when(F.col("pos").isNotNull(), F.struct("ts", F.col("event_id").cast("string").alias("event_id"), "pos"))
    by_source = spread.groupBy("section", "key", "second", "src").agg(
        F.count("*").alias("n"), F.max("label").alias("label"), F.min(first).alias("first"))
    return by_source.groupBy("section", "key", "second").agg(
        F.sum("n").alias("n"), F.max("label").alias("label"), F.count("src").alias("sources"), F.min("first").alias("first"))


def _event_rows(cells: DataFrame) -> DataFrame:
    url = F.col("section") == "payload_urls"
    sort = F.when(url, -micros(F.col("first.ts"))).otherwise(F.col("n"))
    tie = F.when(url, F.concat_ws(" ", "first.event_id", F.lpad(F.col("first.pos").cast("string"), 6, "0"))).otherwise(F.col("key"))
    return cells.filter(~F.col("section").isin("totals", "sources", "pairs")).select(
        "section", "key", "second", "label", F.col("n").cast("double").alias("value"),
        F.when(F.col("section").isin(*_COUNTED), F.col("sources")).alias("sources"),
        sort.cast("double").alias("sort"), tie.alias("tie"))


def _counters(cells: DataFrame) -> DataFrame:
    """Counters of the events: zeros for an empty window."""
    of = lambda section: F.count_if(F.col("section") == section)
    total = lambda key: F.coalesce(
        F.sum(F.when((F.col("section") == "totals") & (F.col("key") == key), F.col("n"))), F.lit(0))
    return cells.agg(
        *[total(k).alias(k) for k in ("total_events", "auth_attempts", "commands_run")],
        of("sources").alias("unique_sources"), of("top_countries").alias("unique_countries"),
        of("pairs").alias("unique_credential_pairs"))


# --------------------------------------------------------------------------- #
# The whole report
# --------------------------------------------------------------------------- #


def _plain_rows(rows: DataFrame, section: str, key: Column, value: Column, sort: Column,
                label: Column | None = None, tie: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.select(
        F.lit(section).alias("section"), key.cast("string").alias("key"), none.alias("second"),
        (label if label is not None else none).alias("label"), value.cast("double").alias("value"),
        F.lit(None).cast("long").alias("sources"), sort.cast("double").alias("sort"),
        (tie if tie is not None else key).cast("string").alias("tie"))


def _alert_rows(recent: DataFrame) -> list[DataFrame]:
    """Alerts by severity (all five levels), by rule, and the critical and high ones."""
    levels = recent.sparkSession.createDataFrame(list(SEVERITY_RANK.items()), "level string, rank int")
    counts = recent.groupBy(F.col("severity").alias("level")).agg(F.count("*").alias("n"))
    by_level = levels.join(counts, "level", "left")
    rules = recent.groupBy("rule_id").agg(
        F.max("rule_name").alias("name"), F.coalesce(F.sum("hit_count"), F.lit(0)).alias("n"))
    notable = recent.filter(F.col("severity").isin("critical", "high"))
    return [
        _plain_rows(by_level, "alerts_by_severity", F.col("level"), F.coalesce("n", F.lit(0)), F.col("rank")),
        _plain_rows(rules, "alerts_by_rule", F.col("rule_id"), F.col("n"), F.col("n"), F.col("name")),
        _plain_rows(notable, "notable_alerts", F.col("dedupe_key"), F.col("hit_count"), micros("last_seen"), F.col("title")),
    ]


def daily_summary(
    events: DataFrame,
    sessions: DataFrame,
    alerts: DataFrame,
    sources: DataFrame,
    as_of: Column,
    hours: float = 24,
    top_n: int = 10,
) -> DataFrame:
    """``section, position, key, second, label, value, sources, total``: the 15 sections.

    Lists show their first ``top_n`` rows; ``total`` is how many there are. Events are
    read once, when called.
    """
    cells = cut_lineage(event_cells(since(events, hours, as_of)))
    recent = since(alerts, hours, as_of, "last_seen")
    is_open = F.col("status") == "new"
    stats = _counters(cells).select(
        "*",
        since(sessions, hours, as_of, "started_at").agg(F.count("*")).scalar().alias("sessions"),
        alerts.agg(F.count_if(is_open)).scalar().alias("open_alerts"),
        alerts.agg(F.count_if(is_open & F.col("severity").isin("high", "critical"))).scalar().alias("critical_alerts"))
    pairs = F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("double").alias("v")) for c in stats.columns])
    counters = stats.select(F.explode(pairs).alias("p"))
    best = since(sources, hours, as_of, "last_seen")
    top = top_sources(sources, hours, as_of, top_n)
    score = F.col("threat_score")
    parts = [
        _plain_rows(counters, "stats", F.col("p.k"), F.col("p.v"), F.lit(0)),
        _event_rows(cells),
        *_alert_rows(recent),
        _plain_rows(best, "top_sources", F.col("src_ip"), score, score),
        _plain_rows(new_arrivals(top, hours, as_of), "new_sources", F.col("src_ip"), score, score),
    ]
    rows = reduce(DataFrame.unionByName, [p.select(*_ROW) for p in parts])
    totals = rows.groupBy("section").agg(F.count("*").alias("total"))  # 15 rows
    order = [F.desc("sort"), F.col("tie").asc_nulls_first(), F.col("second").asc_nulls_first()]
    whole = F.col("section").isin("stats", "services", "alerts_by_severity", "alerts_by_rule")
    # Sections that are shown whole have a closed vocabulary.
    every = rows.filter(whole).withColumn("position", F.row_number().over(by_key(["section"]).orderBy(*order)))
    ranked = first_k(rows.filter(~whole), ["section"], order, top_n, rank="position").unionByName(every)
    return ranked.join(F.broadcast(totals), "section").select(
        "section", "position", "key", "second", "label", "value", "sources", "total")


def digest(summary: DataFrame, top_n: int = 5) -> DataFrame:
    """First ``top_n`` rows of each digest section and how many were left out.

    ``summary`` is :func:`daily_summary`. A section with rows to spare gets one
    ``+N more`` row; a day with no events gets a single quiet row. URLs are
    defanged.
    """
    rows = summary.filter(F.col("section").isin(*DIGEST_SECTIONS))
    shown = rows.filter(F.col("position") <= top_n).select(
        "section",
        "position",
        F.when(F.col("section") == "payload_urls", defang(F.col("key")))
        .otherwise(F.col("key"))
        .alias("line"),
        "value",
    )
    more = F.col("total") - top_n
    tail = rows.filter((F.col("position") == 1) & (more > 0)).select(
        "section",
        F.lit(top_n + 1).alias("position"),
        F.concat(F.lit("+"), more, F.lit(" more")).alias("line"),
        more.cast("double").alias("value"),
    )
    total = summary.filter((F.col("section") == "stats") & (F.col("key") == "total_events"))
    quiet = total.filter(F.col("value") == 0).select(
        F.lit("quiet").alias("section"),
        F.lit(1).alias("position"),
        F.lit("no events in this window").alias("line"),
        F.lit(0.0).alias("value"),
    )
    return shown.unionByName(tail).unionByName(quiet)
