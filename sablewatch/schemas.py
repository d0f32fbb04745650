"""Declared schemas of the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L, _D = T.StringType(), T.LongType(), T.DoubleType()

EVENT = T.StructType(
    [
        T.StructField("event_id", _S),
        T.StructField("ts", T.TimestampType()),
        T.StructField("session_id", _S),
        T.StructField("sensor", _S),
        T.StructField("service", _S),
        T.StructField("event_type", _S),
        T.StructField("src_ip", _S),
        T.StructField("src_port", _L),
        T.StructField("dst_port", _L),
        T.StructField("transport", _S),
        T.StructField("username", _S),
        T.StructField("password", _S),
        T.StructField("command", _S),
        T.StructField("http_method", _S),
        T.StructField("path", _S),
        T.StructField("user_agent", _S),
        T.StructField("status_code", _L),
        T.StructField("headers", T.MapType(_S, _S)),
        T.StructField("payload_size", _L),
        T.StructField("payload_sha256", _S),
        T.StructField("country", _S),
        T.StructField("country_name", _S),
        T.StructField("city", _S),
        T.StructField("latitude", _D),
        T.StructField("longitude", _D),
        T.StructField("asn", _L),
        T.StructField("as_org", _S),
        T.StructField("geo_source", _S),
        T.StructField("threat_score", _D),
        T.StructField("threat_tags", T.ArrayType(_S)),
        T.StructField("severity", _S),
        T.StructField("tags", T.ArrayType(_S)),
        T.StructField("extra", T.MapType(_S, _S)),
    ]
)

# The table's own default for a value a source did not give.
EVENT_DEFAULTS = {
    "sensor": "default",
    "transport": "tcp",
    "severity": "info",
    "threat_score": 0.0,
    "payload_size": 0,
}

INDICATOR = T.StructType(
    [
        T.StructField("kind", _S),
        T.StructField("value", _S),
        T.StructField("source", _S),
        T.StructField("category", _S),
        T.StructField("score", _D),
        T.StructField("enabled", T.BooleanType()),
    ]
)


def column_or_null(df: DataFrame, name: str, dtype: str = "string") -> Column:
    """``df[name]``, or a typed null when the table has no such column."""
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def conform_events(df: DataFrame) -> DataFrame:
    """Project any event-shaped table onto :data:`EVENT`, filling defaults."""
    out = []
    for field in EVENT.fields:
        value = column_or_null(df, field.name, field.dataType.simpleString()).cast(field.dataType)
        if field.name in EVENT_DEFAULTS:
            value = F.coalesce(value, F.lit(EVENT_DEFAULTS[field.name]).cast(field.dataType))
        out.append(value.alias(field.name))
    return df.select(*out)
