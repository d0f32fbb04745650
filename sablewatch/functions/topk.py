"""Bounded per-group lists that never hold an unbounded group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "_rank"):
    """First ``k`` rows per key.

    A ``row_number() <= k`` filter lets Spark cut each partition to ``k`` rows
    per key before the shuffle, so a hot key sends ``k`` rows per task.
    """
    return df.withColumn(rank, F.row_number().over(by_key(keys).orderBy(*order))).filter(
        F.col(rank) <= k
    )


def by_key(keys: list[str]):
    """Window partition on ``keys`` whose sort compares one number first.

    Spark's sorter keeps an 8-byte prefix of the first sort column; a hash tells
    text keys apart there, where their own first bytes are mostly equal.
    """
    return W.partitionBy(F.xxhash64(*keys), *keys)


def ranked_list(value: Column, rank: str = "_rank") -> Column:
    """Aggregate: the values of a ``first_k`` group in rank order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), value.alias("v"))))
    return F.transform(rows, lambda x: x["v"])
