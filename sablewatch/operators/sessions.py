"""Sessions: build from events, list, locate, replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sablewatch.constants import REPLAY_IDLE_MS, REPLAY_MAX_STEP_MS, REPLAY_MIN_STEP_MS
from sablewatch.functions.columns import has_text, micros, since
from sablewatch.functions.skew import chunked_lag
from sablewatch.operators.search import page
from sablewatch.schemas import column_or_null

SESSION_SORTS = ("started_at", "event_count", "commands_run", "auth_attempts", "duration_ms")
_FIRST_ROW = ("sensor", "service", "src_ip", "src_port", "dst_port", "country", "asn")


_COUNTERS = ("event_count", "auth_attempts", "commands_run")


def session_facts(events: DataFrame) -> DataFrame:
    """What events say of their sessions, so that more events can be added later.

    The first event decides a session's fields: the earliest, then the least id.
    """
    first = [column_or_null(events, c).alias(c) for c in _FIRST_ROW]
    return events.filter(has_text("session_id")).groupBy("session_id").agg(
        F.min(F.struct("ts", "event_id", *first)).alias("first_event"),
        F.max("ts").alias("ended_at"),
        F.count("*").alias("event_count"),
        F.count_if(F.col("event_type") == "auth_attempt").alias("auth_attempts"),
        F.count_if(F.col("event_type") == "command").alias("commands_run"),
    )


def merge_sessions(facts: DataFrame) -> DataFrame:
    """Facts of equal sessions as one row: spans widen, counters add."""
    return facts.groupBy("session_id").agg(
        F.min("first_event").alias("first_event"), F.max("ended_at").alias("ended_at"),
        *[F.sum(c).alias(c) for c in _COUNTERS])


def finish_sessions(facts: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    span_us = micros(F.col("ended_at")) - micros(F.col("first_event.ts"))
    return facts.select(
        "session_id", *[f"first_event.{c}" for c in _FIRST_ROW], F.col("first_event.ts").alias("started_at"),
        "ended_at", F.floor(span_us / 1000).alias("duration_ms"), *_COUNTERS, *keep)


def build_sessions(events: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One row per session id; ids already in ``existing`` are skipped."""
    if existing is not None:
        events = events.filter(has_text("session_id")).join(
            existing.select("session_id"), "session_id", "left_anti")
    return finish_sessions(session_facts(events))


def list_sessions(
    sessions: DataFrame,
    *,
    service: str | None = None,
    src_ip: str | None = None,
    min_events: int | None = None,
    has_commands: bool = False,
    hours: float | None = None,
    as_of: Column | None = None,
    sort: str = "started_at",
    limit: int = 50,
    offset: int = 0,
) -> DataFrame:
    if sort not in SESSION_SORTS:
        raise ValueError(f"cannot sort by {sort!r}; use one of {SESSION_SORTS}")
    out = since(sessions, hours, as_of, "started_at")
    if service:
        out = out.filter(F.col("service") == service)
    if src_ip:
        out = out.filter(F.col("src_ip") == src_ip)
    if min_events is not None:
        out = out.filter(F.col("event_count") >= min_events)
    if has_commands:
        out = out.filter(F.col("commands_run") > 0)
    return page(out, [F.desc(sort), F.desc("started_at"), F.asc("session_id")], limit, offset)


def sessions_of_source(sessions: DataFrame, src_ip: str, limit: int = 50) -> DataFrame:
    return (
        sessions.filter(F.col("src_ip") == src_ip)
        .orderBy(F.desc("started_at"), "session_id")
        .limit(limit)
    )


def with_event_geo(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """Fill session geography from its events, which carry the enrichment."""
    names = ("country", "country_name", "asn", "as_org")
    geo = events.groupBy("session_id").agg(
        *[F.max(column_or_null(events, n)).alias(f"_{n}") for n in names]
    )
    out = sessions.join(geo, "session_id", "left")
    for n in names:
        own = column_or_null(sessions, n) if n in ("country", "asn") else F.lit(None)
        # asn 0 and the empty string mean "not known" on the event side.
        seen = F.col(f"_{n}")
        known = (seen != 0) if n == "asn" else (seen != "")
        out = out.withColumn(n, F.coalesce(F.when(known, seen), own))
    return out.drop(*[f"_{n}" for n in names])


def replay_timeline(events: DataFrame, chunk_seconds: int = 3600) -> DataFrame:
    """Pacing of every session: gap to the previous event, shown step, idle mark.

    The lag runs per (session, hour), so one endless session is still split.
    """
    rows = events.filter(has_text("session_id")).withColumn("_us", micros("ts"))
    starts = rows.groupBy("session_id").agg(F.min("_us").alias("_start"))
    chunk = F.floor(F.col("_us") / F.lit(chunk_seconds * 1_000_000))
    paced = chunked_lag(rows, ["session_id"], ["_us", "event_id"], chunk, "_us", "_prev")
    gap = F.coalesce(F.floor((F.col("_us") - F.col("_prev")) / 1000), F.lit(0))
    return (
        paced.join(starts, "session_id")
        .withColumn("gap_ms", gap)
        .withColumn(
            "step_ms",
            F.least(F.greatest("gap_ms", F.lit(REPLAY_MIN_STEP_MS)), F.lit(REPLAY_MAX_STEP_MS)),
        )
        .withColumn("idle", F.col("gap_ms") > REPLAY_IDLE_MS)
        .withColumn("elapsed_ms", F.floor((F.col("_us") - F.col("_start")) / 1000))
        .drop("_us", "_prev", "_start")
    )


def transcript(events: DataFrame, session_id: str, limit: int = 1000) -> DataFrame:
    """One session in order, the page the transcript view shows."""
    return (
        events.filter(F.col("session_id") == session_id)
        .orderBy("ts", F.desc("event_id"))
        .limit(limit)
    )
