"""Views that put several tables next to one source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sablewatch.operators.aggregates import top_countries
from sablewatch.operators.payloads import payloads_of_source
from sablewatch.operators.scoring import explain_sources
from sablewatch.operators.search import lookup, search_events
from sablewatch.operators.sessions import sessions_of_source


def source_profile(
    src_ip: str,
    sources: DataFrame,
    sessions: DataFrame,
    events: DataFrame,
    payloads: DataFrame,
    as_of,
    event_limit: int = 100,
) -> dict[str, DataFrame]:
    """Everything known about one source; each part filters on the key first."""
    own = search_events(events, src_ip=src_ip)
    return {
        "source": lookup(sources, "src_ip", src_ip),
        "sessions": sessions_of_source(sessions, src_ip),
        "recent_events": own.orderBy(F.desc("ts"), F.desc("event_id")).limit(event_limit),
        "payloads": payloads_of_source(payloads, events, src_ip),
        "explanation": explain_sources(own, as_of),
    }


def map_feed(sources: DataFrame, events: DataFrame, limit: int = 500) -> dict[str, DataFrame]:
    """Top sources with coordinates, country totals, and how many lack coordinates."""
    top = sources.orderBy(F.desc("threat_score"), "src_ip").limit(limit)
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    points = top.filter(located).select(
        "src_ip",
        F.col("latitude").alias("lat"),
        F.col("longitude").alias("lon"),
        "country",
        "country_name",
        F.col("threat_score").alias("score"),
        "classification",
        F.col("event_count").alias("events"),
        "as_org",
    )
    counts = top.agg(
        F.count_if(located).alias("points_total"),
        F.count_if(~located).alias("points_without_geo"),
    )
    return {"points": points, "countries": top_countries(events, 250), "counts": counts}
