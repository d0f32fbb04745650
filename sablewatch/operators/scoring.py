"""Source roll-up, additive score, behavioural class and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sablewatch.constants import CARRIED_TAG_PREFIXES, EXPLOIT_TAGS, SCORE_CEILINGS, SCORE_MAX
from sablewatch.functions.columns import (
    empty_strings,
    has_text,
    micros,
    severity_rank,
    strings_or_empty,
    tag_list,
)
from sablewatch.functions.topk import first_k, ranked_list
from sablewatch.operators.search import page
from sablewatch.schemas import column_or_null

TOP_PER_SOURCE = 10
SOURCE_SORTS = ("threat_score", "event_count", "last_seen", "first_seen", "auth_attempts")
COMPONENTS = tuple(SCORE_CEILINGS)
_FACETS = ("session_id", "username", "password", "path", "service")
_TOP = {"username": "top_usernames", "password": "top_passwords", "path": "top_paths"}
_GEO = ("country", "country_name", "latitude", "longitude")


def facet_counts(events: DataFrame) -> DataFrame:
    """``src_ip, facet, value, n``: every distinct count and list of a source comes from this.

    One explode and one combining aggregate replace a multi-distinct expand
    and a window per field; the shuffle key includes the value, so a hot
    source is spread out. Enrichment tags worth showing are the facet ``carried``.
    """
    cell = lambda facet, value: F.struct(F.lit(facet).alias("facet"), value.cast("string").alias("value"))
    own = [F.when(has_text(column_or_null(events, f)), cell(f, column_or_null(events, f))) for f in _FACETS]
    tags = strings_or_empty(column_or_null(events, "threat_tags", "array<string>"))

    def wanted(tag: Column) -> Column:
        out = F.lit(False)
        for prefix in CARRIED_TAG_PREFIXES:
            out = out | tag.startswith(prefix)
        return F.coalesce(out, F.lit(False))

    carried = F.transform(F.filter(F.array_distinct(tags), wanted), lambda t: cell("carried", t))
    return (
        events.select("src_ip", F.explode(F.concat(F.array_compact(F.array(*own)), carried)).alias("c"))
        .groupBy("src_ip", F.col("c.facet").alias("facet"), F.col("c.value").alias("value"))
        .agg(F.count("*").alias("n"))
    )


def merge_facets(rows: DataFrame) -> DataFrame:
    return rows.groupBy("src_ip", "facet", "value").agg(F.sum("n").alias("n"))


def _tag_flags(events: DataFrame) -> list[Column]:
    """Per-source facts about a fixed tag vocabulary, as mergeable flags."""
    tags = strings_or_empty(column_or_null(events, "tags", "array<string>"))
    intel = strings_or_empty(column_or_null(events, "threat_tags", "array<string>"))
    has = lambda column, tag: F.array_contains(column, tag)
    fetch = has(tags, "payload-fetch") | has(tags, "second-stage-url")
    return [
        F.count_if(fetch).alias("payload_fetches"),
        F.bool_or(has(tags, "mirai-signature") | has(tags, "iot-default-credential")).alias(
            "is_iot"
        ),
        F.bool_or(has(intel, "hosting-provider")).alias("is_hosting"),
        F.bool_or(has(intel, "vpn-or-tor")).alias("is_vpn"),
        *[F.bool_or(has(tags, t)).alias(f"exploit_{i}") for i, t in enumerate(EXPLOIT_TAGS)],
    ]


_SUMS = ("event_count", "auth_attempts", "auth_successes", "commands_run", "uploads", "high_events",
         "payload_fetches")
_LARGEST = ("last_seen", "worst_rank", "max_intel")
_LEAST = ("first_seen", "geo_at", "network_at")


def base_facts(events: DataFrame) -> DataFrame:
    """Counts, spans and flags of every source, all of which more events can be added to."""
    order = (F.col("ts"), F.col("event_id"))
    rank = severity_rank(column_or_null(events, "severity"))
    col = lambda n, t="string": column_or_null(events, n, t)
    geo = F.struct(
        col("country").alias("country"),
        col("country_name").alias("country_name"),
        col("latitude", "double").alias("latitude"),
        col("longitude", "double").alias("longitude"),
    ).alias("geo")
    network = F.struct(col("asn", "bigint").alias("asn"), col("as_org").alias("as_org")).alias("network")
    is_type = lambda t: F.count_if(F.col("event_type") == t)
    return events.groupBy("src_ip").agg(
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        F.count("*").alias("event_count"),
        is_type("auth_attempt").alias("auth_attempts"),
        is_type("auth_success").alias("auth_successes"),
        is_type("command").alias("commands_run"),
        is_type("file_upload").alias("uploads"),
        F.coalesce(F.max(rank), F.lit(0)).alias("worst_rank"),
        F.count_if(rank >= 3).alias("high_events"),
        F.coalesce(F.max(col("threat_score", "double")), F.lit(0.0)).alias("max_intel"),
        # The earliest event that knows a place or network decides it.
        F.min(F.when(has_text(col("country")), F.struct(*order, geo))).alias("geo_at"),
        F.min(F.when(col("asn", "bigint") != 0, F.struct(*order, network))).alias("network_at"),
        *_tag_flags(events),
    )


def merge_facts(rows: DataFrame) -> DataFrame:
    """Facts of equal sources as one row."""
    flags = [c for c in rows.columns if c not in ("src_ip", *_SUMS, *_LARGEST, *_LEAST)]
    return rows.groupBy("src_ip").agg(
        *[F.sum(c).alias(c) for c in _SUMS], *[F.max(c).alias(c) for c in _LARGEST],
        *[F.min(c).alias(c) for c in _LEAST], *[F.bool_or(c).alias(c) for c in flags],
    ).select(*rows.columns)


def finish_facts(base: DataFrame, facets: DataFrame) -> DataFrame:
    """Everything the roll-up, score and class need, one row per source."""
    counts = facets.groupBy("src_ip").agg(
        *[F.count_if(F.col("facet") == f).alias(f"n_{f}") for f in _FACETS],
        F.coalesce(
            F.bool_or((F.col("facet") == "service") & (F.col("value") == "http")), F.lit(False)
        ).alias("has_http"),
        # Protocol names, and enrichment tags: closed vocabularies, so these sets stay small.
        F.array_sort(
            F.collect_set(F.when(F.col("facet") == "service", F.col("value")))
        ).alias("services"),
        F.array_sort(
            F.collect_set(F.when(F.col("facet") == "carried", F.col("value")))
        ).alias("carried_tags"),
    )
    tops = first_k(
        facets.filter(F.col("facet").isin(*_TOP)),
        ["src_ip", "facet"],
        [F.desc("n"), F.col("value")],
        TOP_PER_SOURCE,
    )
    tops = (
        tops.groupBy("src_ip", "facet")
        .agg(ranked_list(F.col("value")).alias("vs"))
        .groupBy("src_ip")
        .agg(
            *[
                F.coalesce(F.max(F.when(F.col("facet") == f, F.col("vs"))), empty_strings()).alias(out)
                for f, out in _TOP.items()
            ]
        )
    )
    return (
        base.withColumns({"geo": F.col("geo_at.geo"), "network": F.col("network_at.network")})
        .drop("geo_at", "network_at")
        .join(counts, "src_ip", "left")
        .join(tops, "src_ip", "left")
        .na.fill(0, [f"n_{f}" for f in _FACETS])
        .na.fill(False, ["has_http"])
    )


def source_facts(events: DataFrame) -> DataFrame:
    """:func:`finish_facts` of some events."""
    return finish_facts(base_facts(events), facet_counts(events))


# --------------------------------------------------------------------------- #
# Score
# --------------------------------------------------------------------------- #


def score_components() -> dict[str, Column]:
    """Unrounded, unclamped contributions over :func:`source_facts` columns."""
    c = F.col
    hours = (micros("last_seen") - micros("first_seen")) / 3_600_000_000
    return {
        "volume": F.log10(c("event_count") + 1) * 5,
        "persistence": F.log1p(hours) * 3 + F.log1p(c("n_session_id")) * 2,
        "credential_breadth": F.log1p(c("n_username")) * 4 + F.log1p(c("n_password")) * 2.5,
        "service_breadth": (c("n_service") - 1) * 3,
        "severity": c("worst_rank") * 5 + F.log1p(c("high_events")) * 3,
        "post_exploitation": c("auth_successes") * 8
        + F.log1p(c("commands_run")) * 6
        + c("payload_fetches") * 10
        + c("uploads") * 6,
        "threat_intel": c("max_intel") * 0.4,
    }


def clamped_components() -> dict[str, Column]:
    return {
        name: F.bround(
            F.greatest(F.lit(0.0), F.least(value.cast("double"), F.lit(SCORE_CEILINGS[name]))), 2
        )
        for name, value in score_components().items()
    }


def age_days(as_of: Column) -> Column:
    return F.greatest((micros(as_of) - micros("last_seen")) / 86_400_000_000, F.lit(0.0))


def recency_decay(as_of: Column) -> Column:
    return F.greatest(F.lit(0.4), F.exp(-age_days(as_of) / 30))


def severity_band(score: str | Column) -> Column:
    score = F.col(score) if isinstance(score, str) else score
    return (
        F.when(score >= 80, "critical")
        .when(score >= 60, "high")
        .when(score >= 35, "medium")
        .when(score >= 15, "low")
        .otherwise("info")
    )


# --------------------------------------------------------------------------- #
# Class and labels
# --------------------------------------------------------------------------- #


def _any_exploit() -> Column:
    cond = F.lit(False)
    for i in range(len(EXPLOIT_TAGS)):
        cond = cond | F.coalesce(F.col(f"exploit_{i}"), F.lit(False))
    return cond


def classification() -> Column:
    """First matching class, most serious first."""
    c = F.col
    return (
        F.when(c("is_iot"), "botnet-loader")
        .when((c("commands_run") >= 3) & (c("auth_successes") > 0), "targeted-intrusion")
        .when(_any_exploit(), "exploit-attempt")
        .when((c("auth_attempts") >= 10) | (c("n_password") >= 8), "credential-bruteforce")
        .when(c("has_http") & (c("n_path") >= 15), "web-scanner")
        .when(c("n_service") >= 3, "recon-scanner")
        .when((c("event_count") >= 5) | (c("auth_attempts") >= 1), "opportunistic-probe")
        .otherwise("low-signal")
    )


def source_tags(kind: Column) -> Column:
    """Carried tags, network flags, exploit tags, then the class's own label."""
    order = sorted(range(len(EXPLOIT_TAGS)), key=lambda i: EXPLOIT_TAGS[i])
    network = tag_list(
        (F.col("is_hosting"), "from-hosting-provider"), (F.col("is_vpn"), "from-vpn-or-tor")
    )
    exploits = tag_list(*[(F.col(f"exploit_{i}"), EXPLOIT_TAGS[i]) for i in order])
    listed = F.col("n_username") >= 8
    label = tag_list(
        (kind == "botnet-loader", "iot-botnet"),
        (kind == "targeted-intrusion", "hands-on-keyboard"),
        ((kind == "credential-bruteforce") & listed, "username-list-driven"),
        ((kind == "credential-bruteforce") & ~listed, "single-account-focus"),
        (kind == "web-scanner", "path-enumeration"),
        (kind == "recon-scanner", "multi-protocol"),
    )
    return F.array_distinct(F.concat(strings_or_empty("carried_tags"), network, exploits, label))


# --------------------------------------------------------------------------- #
# Source table
# --------------------------------------------------------------------------- #


def scored_facts(facts: DataFrame, as_of: Column) -> DataFrame:
    """Facts plus components, raw and final score, class, tags and band."""
    out = facts.withColumns(clamped_components())
    total = sum((F.col(c) for c in COMPONENTS[1:]), F.col(COMPONENTS[0]))
    out = out.withColumn("classification", classification()).withColumn(
        "raw_score", F.bround(total, 2)
    )
    return (
        out.withColumn("recency_decay", recency_decay(as_of))
        .withColumn("age_days", age_days(as_of))
        .withColumn(
            "threat_score",
            F.bround(F.least(total, F.lit(SCORE_MAX)) * F.col("recency_decay"), 2),
        )
        .withColumn("tags", source_tags(F.col("classification")))
        .withColumn("band", severity_band("threat_score"))
    )


def rebuild_sources(
    events: DataFrame, as_of: Column, only: DataFrame | None = None
) -> DataFrame:
    """The source table; ``only(src_ip)`` limits it to changed sources."""
    if only is not None:
        events = events.join(only.select("src_ip").distinct(), "src_ip", "left_semi")
    return source_rows(source_facts(events), as_of)


def source_rows(facts: DataFrame, as_of: Column) -> DataFrame:
    """The rows of the source table."""
    scored = scored_facts(facts, as_of)
    return scored.select(
        "src_ip",
        "first_seen",
        "last_seen",
        "event_count",
        F.col("n_session_id").alias("session_count"),
        "auth_attempts",
        F.col("n_username").alias("distinct_usernames"),
        F.col("n_password").alias("distinct_passwords"),
        "commands_run",
        strings_or_empty("services").alias("services"),
        *[strings_or_empty(c).alias(c) for c in _TOP.values()],
        "geo.country",
        "geo.country_name",
        "geo.latitude",
        "geo.longitude",
        "network.asn",
        "network.as_org",
        "threat_score",
        "classification",
        "tags",
    )


def refresh_sources(stored: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Replace rebuilt rows; geography and network survive when no event has any."""
    kept = stored.join(rebuilt.select("src_ip"), "src_ip", "left_anti")
    old = stored.select("src_ip", *[F.col(c).alias(f"_{c}") for c in (*_GEO, "asn", "as_org")])
    merged = rebuilt.join(old, "src_ip", "left")
    for group, probe in ((_GEO, "country"), (("asn", "as_org"), "asn")):
        known = F.col(probe).isNotNull()
        merged = merged.withColumns(
            {c: F.when(known, F.col(c)).otherwise(F.col(f"_{c}")) for c in group}
        )
    return kept.select(*rebuilt.columns).unionByName(merged.select(*rebuilt.columns))


def explain_sources(events: DataFrame, as_of: Column) -> DataFrame:
    """The arithmetic behind each score."""
    return scored_facts(source_facts(events), as_of).select(
        "src_ip",
        F.col("threat_score").alias("score"),
        "raw_score",
        "classification",
        "tags",
        F.struct(*COMPONENTS).alias("components"),
        F.struct(*[F.lit(v).alias(k) for k, v in SCORE_CEILINGS.items()]).alias("weights"),
        F.bround("recency_decay", 3).alias("recency_decay"),
        F.bround("age_days", 2).alias("age_days"),
        F.col("event_count").alias("events_considered"),
    )


def list_sources(
    sources: DataFrame,
    *,
    country: str | None = None,
    classification: str | None = None,
    min_score: float | None = None,
    sort: str = "threat_score",
    limit: int = 50,
    offset: int = 0,
) -> DataFrame:
    if sort not in SOURCE_SORTS:
        raise ValueError(f"cannot sort by {sort!r}; use one of {SOURCE_SORTS}")
    out = sources
    if country:
        out = out.filter(F.col("country") == country.upper())
    if classification:
        out = out.filter(F.col("classification") == classification)
    if min_score is not None:
        out = out.filter(F.col("threat_score") >= min_score)
    return page(out, [F.desc(sort), F.asc("src_ip")], limit, offset)
