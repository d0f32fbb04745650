"""Small Column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sablewatch.constants import SEVERITIES, SEVERITY_RANK


def micros(ts: str | Column) -> Column:
    """Microseconds since the epoch; the integer clock all windows run on."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(ts.cast("timestamp"))


def rounded(value: str | Column, digits: int) -> Column:
    """``round`` of a double, without a decimal for each row.

    Only where the scaled value lies at a tie, is negative or large are decimals needed:
    elsewhere the nearest integer is plain, and its quotient is the nearest double.
    """
    value = F.col(value) if isinstance(value, str) else value
    scale = float(10**digits)
    scaled = value * scale
    plain = (scaled >= 0) & (scaled < 1e9) & (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-6)
    return F.when(plain, F.floor(scaled + 0.5) / scale).otherwise(F.round(value, digits))


def severity_rank(severity: str | Column) -> Column:
    severity = F.col(severity) if isinstance(severity, str) else severity
    rank = F.lit(None).cast("int")
    for name, value in SEVERITY_RANK.items():
        rank = F.when(severity == name, value).otherwise(rank)
    return rank


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), rank + 1)


def severities_from(minimum: str) -> list[str]:
    """Names at or above ``minimum``; an IN list, so it reaches the scan."""
    if minimum not in SEVERITY_RANK:
        raise ValueError(f"unknown severity {minimum!r}")
    return [s for s in SEVERITIES if SEVERITY_RANK[s] >= SEVERITY_RANK[minimum]]


def has_text(column: str | Column) -> Column:
    """Neither null nor empty."""
    column = F.col(column) if isinstance(column, str) else column
    return column.isNotNull() & (column != "")


def tag_list(*pairs: tuple[Column, str | Column]) -> Column:
    """The tags whose condition holds, in the order given."""
    return F.array_compact(
        F.array(
            *[F.when(cond, F.lit(tag) if isinstance(tag, str) else tag) for cond, tag in pairs]
        )
    )


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def strings_or_empty(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column, empty_strings())


def contains_any(haystack: Column, needles: Iterable[str]) -> Column:
    cond = F.lit(False)
    for needle in needles:
        cond = cond | haystack.contains(needle)
    return cond


def literal_map(mapping: dict) -> Column:
    parts = []
    for key, value in mapping.items():
        parts += [F.lit(key), F.lit(value)]
    return F.create_map(*parts)


def last_instant(events: DataFrame, ts: str = "ts") -> Column:
    """``max(ts)`` as a one-row scalar subquery, so no action runs here."""
    return events.agg(F.max(ts)).scalar()


def since(events: DataFrame, hours: float | None, as_of: Column | None, ts: str = "ts"):
    """Rows of the last ``hours`` before ``as_of``; everything when ``None``.

    ``as_of`` defaults to the newest row rather than the wall clock, so a
    report over old data is not empty and a rerun gives the same rows.
    """
    if hours is None:
        return events
    anchor = as_of if as_of is not None else last_instant(events, ts)
    cutoff = anchor - F.make_dt_interval(secs=F.lit(float(hours) * 3600).cast("decimal(18,6)"))
    return events.filter(F.col(ts) >= cutoff)
