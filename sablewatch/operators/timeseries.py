"""Bucketed, zero-filled counts and the weekday-by-hour heatmap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sablewatch.constants import BUCKET_SECONDS, MAX_SERIES_POINTS
from sablewatch.functions.columns import last_instant, micros, since

SERIES_COLUMNS = ("service", "severity", "event_type", "none")


def check_request(bucket: str, by: str, hours: float | None) -> int:
    """Bucket width in seconds; refuses unknown names and oversized requests."""
    if bucket not in BUCKET_SECONDS:
        raise ValueError(f"unknown bucket {bucket!r}; use one of {sorted(BUCKET_SECONDS)}")
    if by not in SERIES_COLUMNS:
        raise ValueError(f"cannot split by {by!r}; use one of {SERIES_COLUMNS}")
    width = BUCKET_SECONDS[bucket]
    if hours is not None and hours * 3600 / width > MAX_SERIES_POINTS:
        raise ValueError(f"more than {MAX_SERIES_POINTS} points; use a wider bucket")
    return width


def bucket_start(width: int, ts: str = "ts") -> Column:
    return F.timestamp_seconds(F.floor(micros(ts) / (width * 1_000_000)) * width)


def bucket_counts(events: DataFrame, width: int, by: str) -> DataFrame:
    series = F.lit("events") if by == "none" else F.col(by)
    named = F.when(series.isNull() | (series == ""), "unknown").otherwise(series)
    return events.groupBy(bucket_start(width).alias("bucket"), named.alias("series")).agg(
        F.count("*").alias("n")
    )


def timeseries(
    events: DataFrame,
    *,
    bucket: str = "1h",
    by: str = "service",
    hours: float | None = None,
    as_of: Column | None = None,
) -> DataFrame:
    """``bucket, series, n`` with a row for every bucket of every series.

    Events collapse to bucket counts first; the spine is then built from one
    row per series and joined by key, so filling costs series x buckets.
    """
    width = check_request(bucket, by, hours)
    anchor = as_of if as_of is not None else last_instant(events)
    counts = bucket_counts(since(events, hours, anchor), width, by)
    floor = lambda c: F.floor(micros(c) / (width * 1_000_000)) * width
    first = counts.agg(F.min("bucket")).scalar()
    if hours is not None:
        first = anchor - F.make_dt_interval(secs=F.lit(hours * 3600.0).cast("decimal(18,6)"))
    steps = F.sequence(floor(first), floor(anchor), F.lit(width).cast("bigint"))
    spine = counts.select("series").distinct().select(
        "series", F.explode(steps).alias("second")
    ).select("series", F.timestamp_seconds("second").alias("bucket"))
    return spine.join(counts, ["bucket", "series"], "left").select(
        "bucket", "series", F.coalesce("n", F.lit(0)).alias("n")
    )


def timeseries_wide(filled: DataFrame, series: list[str]) -> DataFrame:
    """One column per named series plus ``total``."""
    return filled.groupBy("bucket").agg(
        *[F.sum(F.when(F.col("series") == s, F.col("n")).otherwise(0)).alias(s) for s in series],
        F.sum("n").alias("total"),
    )


def heatmap(events: DataFrame, ts: str = "ts") -> DataFrame:
    """``weekday (Monday 0), hour, n, total, max_cell`` over the full 7 x 24 grid."""
    counts = events.groupBy(F.weekday(ts).alias("weekday"), F.hour(ts).alias("hour")).agg(
        F.count("*").alias("n")
    )
    grid = events.sparkSession.range(168).select(
        F.floor(F.col("id") / 24).cast("int").alias("weekday"),
        (F.col("id") % 24).cast("int").alias("hour"),
    )
    return grid.join(F.broadcast(counts), ["weekday", "hour"], "left").select(
        "weekday",
        "hour",
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce(counts.agg(F.sum("n")).scalar(), F.lit(0)).alias("total"),
        F.coalesce(counts.agg(F.max("n")).scalar(), F.lit(0)).alias("max_cell"),
    )
