"""String expressions: defanging, redaction, URL and form decoding, UUIDs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from sablewatch.functions.columns import has_text

REDACTED = "[redacted]"
# The DNS namespace of RFC 4122, as hex.
_DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def defang(value: Column) -> Column:
    """``http`` -> ``hxxp`` once, every dot bracketed, so no client links it."""
    once = F.regexp_replace(value, r"(?s)\A(.*?)http", "$1hxxp")
    return F.replace(once, F.lit("."), F.lit("[.]"))


def defang_all(values: Column) -> Column:
    return F.transform(values, defang)


def redact_password(password: Column) -> Column:
    return F.when(has_text(password), F.lit(REDACTED)).otherwise(password)


def hash_password(password: Column) -> Column:
    """At-rest form: a tagged, shortened SHA-256; empty and null stay."""
    digest = F.concat(F.lit("sha256:"), F.left(F.sha2(password, 256), F.lit(32)))
    return F.when(has_text(password), digest).otherwise(password)


def percent_decode(value: Column) -> Column:
    """``%xx`` and ``+`` decoded; malformed escapes leave the text unchanged."""
    return F.coalesce(F.try_url_decode(value), F.replace(value, F.lit("+"), F.lit(" ")))


def latin1(content: Column) -> Column:
    """Bytes as text, one character per byte, so byte regexes work on it."""
    return F.decode(content, "ISO-8859-1")


def name_uuid(name: Column) -> Column:
    """RFC 4122 version-5 UUID of ``name`` in the DNS namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(_DNS_NAMESPACE)), F.encode(name, "UTF-8")))
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3)
    variant = F.lower(F.hex(nibble.bitwiseOR(8).cast("bigint")))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def iso_utc(ts: Column, zone: str = "+00:00") -> Column:
    """ISO-8601 with microseconds only when there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fine = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    exact = F.unix_micros(ts.cast("timestamp")) % 1_000_000 == 0
    return F.concat(F.when(exact, whole).otherwise(fine), F.lit(zone))


def flexible_timestamp(value: Column) -> Column:
    """Epoch seconds or ISO text (``Z`` or naive = UTC) to a timestamp, else null."""
    text = F.trim(value.cast("string"))
    epoch = F.when(text.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), text.cast("double"))
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text)
    return F.coalesce(
        F.timestamp_micros(F.round(epoch * 1_000_000).cast("bigint")),
        F.try_to_timestamp(iso),
    )


_EDGE = "\u0001"


def marked_words(text: Column) -> Column:
    """The text in lower case with a mark at both ends of every run of letters and digits.

    A name marked alike (:func:`marked_name`) is a plain substring of it exactly where the
    text holds the name and no longer word around its edges. One pass over the text
    serves any number of names.
    """
    return F.regexp_replace(F.lower(text), "([a-z0-9]+)", f"{_EDGE}$1{_EDGE}")


def marked_name(name: str) -> str:
    return re.sub("([a-z0-9]+)", rf"{_EDGE}\1{_EDGE}", name.lower())
