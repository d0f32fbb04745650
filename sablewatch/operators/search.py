"""Event search, paging, lookups, redaction, retention and intake filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sablewatch.functions.columns import severities_from, since
from sablewatch.functions.text import hash_password, redact_password
from sablewatch.functions.topk import first_k
from sablewatch.schemas import column_or_null

TEXT_COLUMNS = ("command", "path", "username", "user_agent")


def text_match(df: DataFrame, needle: str, columns=TEXT_COLUMNS) -> Column:
    """Case-insensitive search over several columns; ``%`` and ``_`` are wildcards."""
    cond = F.lit(False)
    for name in columns:
        cond = cond | F.coalesce(column_or_null(df, name).ilike(f"%{needle}%"), F.lit(False))
    return cond


def search_events(
    events: DataFrame,
    *,
    service: str | None = None,
    event_type: str | None = None,
    src_ip: str | None = None,
    country: str | None = None,
    username: str | None = None,
    session_id: str | None = None,
    min_severity: str | None = None,
    search: str | None = None,
    hours: float | None = None,
    as_of: Column | None = None,
) -> DataFrame:
    """All matching events; plain comparisons, so they reach the scan."""
    equal = {
        "service": service,
        "event_type": event_type,
        "src_ip": src_ip,
        "country": country.upper() if country else None,
        "username": username,
        "session_id": session_id,
    }
    out = since(events, hours, as_of)
    for name, wanted in equal.items():
        if wanted:
            out = out.filter(F.col(name) == wanted)
    if min_severity:
        out = out.filter(F.col("severity").isin(severities_from(min_severity)))
    if search:
        out = out.filter(text_match(out, search))
    return out


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page plus ``total``, the number of rows before paging.

    The order plus limit is a top-k per partition, not a full sort; the total
    is a separate scalar aggregate, so no row travels to be counted.
    """
    total = df.agg(F.count("*")).scalar()
    return df.orderBy(*order).offset(offset).limit(limit).withColumn("total", total)


def event_page(events: DataFrame, limit: int = 100, offset: int = 0, newest_first=True):
    ts = F.desc("ts") if newest_first else F.asc("ts")
    return page(events, [ts, F.desc("event_id")], limit, offset)


def events_after(
    events: DataFrame, cursor_id: str | None, limit: int = 50, min_severity: str | None = None
) -> DataFrame:
    """Newest events later than the cursor event; everything if it is unknown.

    The cursor is looked up in the whole table, not only in the newest page.
    """
    out = search_events(events, min_severity=min_severity)
    if cursor_id is not None:
        seen = events.filter(F.col("event_id") == cursor_id).agg(
            F.max(F.struct("ts", "event_id"))
        ).scalar()
        out = out.filter(seen.isNull() | (F.struct("ts", "event_id") > seen))
    return out.orderBy(F.desc("ts"), F.desc("event_id")).limit(limit)


def lookup(table: DataFrame, key: str, value: str) -> DataFrame:
    """One row by its unique key."""
    return table.filter(F.col(key) == value).limit(1)


def lookup_payload(payloads: DataFrame, sha256: str) -> DataFrame:
    if len(sha256) != 64 or any(c not in "0123456789abcdef" for c in sha256.lower()):
        raise ValueError("a SHA-256 is 64 hex digits")
    return lookup(payloads, "sha256", sha256.lower())


def redact(events: DataFrame) -> DataFrame:
    return events.withColumn("password", redact_password(F.col("password")))


def hash_passwords(events: DataFrame) -> DataFrame:
    return events.withColumn("password", hash_password(F.col("password")))


def drop_ignored(events: DataFrame, ignored: DataFrame) -> DataFrame:
    """Drop events of allow-listed sources (``ignored(src_ip)``)."""
    return events.join(ignored.select("src_ip").distinct(), "src_ip", "left_anti")


def first_events_per_session(events: DataFrame, n: int) -> DataFrame:
    """The first ``n`` events of each session; later ones are not recorded."""
    kept = first_k(events, ["session_id"], [F.col("ts"), F.col("event_id")], n)
    return kept.drop("_rank")


def retention_split(table: DataFrame, days: float, as_of: Column, ts: str = "ts"):
    """``(kept, expired)`` around ``as_of - days``."""
    cutoff = as_of - F.make_dt_interval(secs=F.lit(days * 86400.0).cast("decimal(18,6)"))
    return table.filter(F.col(ts) >= cutoff), table.filter(F.col(ts) < cutoff)


def truncate_headers(headers: Column, count=64, key_chars=64, value_chars=1024) -> Column:
    cut = F.transform(
        F.slice(F.map_entries(headers), 1, count),
        lambda e: F.struct(F.left(e["key"], F.lit(key_chars)), F.left(e["value"], F.lit(value_chars))),
    )
    # Two long names can share their first characters; the later one wins.
    return F.aggregate(
        cut,
        F.create_map().cast("map<string,string>"),
        lambda acc, e: F.map_concat(
            F.map_filter(acc, lambda k, _: k != e["col1"]), F.create_map(e["col1"], e["col2"])
        ),
    )
