"""Ordered work that stays parallel when one key holds most of the rows.

A window partitioned by the key alone puts a hot key in one task. Here the key
is cut into chunks of the order column; the window runs inside a chunk, and
what must cross a chunk edge travels as one row per chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def chunked_lag(
    df: DataFrame, keys: list[str], order: list[str], chunk: Column, value: str, out: str
) -> DataFrame:
    """``lag(value)`` per ``keys`` in ``order``, windowed per (keys, chunk).

    ``chunk`` must not decrease along ``order`` (``floor(ts / width)`` does).
    """
    df = df.withColumn("_chunk", chunk)
    inside = W.partitionBy(*keys, "_chunk").orderBy(*order)
    row = F.struct(*[F.col(c) for c in order], F.col(value).alias("_v"))
    # One row per (key, chunk): combined map-side, so a hot key shrinks first.
    tails = df.groupBy(*keys, "_chunk").agg(F.max(row)["_v"].alias("_tail"))
    carried = tails.select(
        *keys,
        "_chunk",
        F.lag("_tail").over(W.partitionBy(*keys).orderBy("_chunk")).alias("_carry"),
    )
    return (
        df.withColumn("_lag", F.lag(value).over(inside))
        .withColumn("_first", F.row_number().over(inside) == 1)
        .join(carried, [*keys, "_chunk"], "left")
        .withColumn(out, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_lag")))
        .drop("_chunk", "_lag", "_first", "_carry")
    )


def join_facts(rows: DataFrame, facts: DataFrame, on: str, when: Column, spread: Column) -> DataFrame:
    """Left join of ``facts`` on the text column ``on``, for the rows where ``when`` holds.

    The other rows get nulls and are dealt out by ``spread``; under one null key
    they would all meet in one task. ``_asks`` is part of the key, so that no
    spreading value can match a fact.
    """
    asks = F.coalesce(when & F.col(on).isNotNull(), F.lit(False))
    keyed = rows.withColumn("_asks", asks).withColumn(
        "_key", F.when(F.col("_asks"), F.col(on)).otherwise(spread.cast("string"))
    )
    right = facts.withColumnRenamed(on, "_key").withColumn("_asks", F.lit(True))
    return keyed.join(right, ["_key", "_asks"], "left").drop("_key", "_asks")
