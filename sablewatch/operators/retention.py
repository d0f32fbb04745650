"""Retention: old rows of day-partitioned tables go, and what was derived from them.

Whole days before the cutoff are dropped as folders; only the day that the cutoff falls
into is read and written again. Sources whose events went are rolled up anew from what
is left, and those without any event are dropped.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sablewatch.operators.scoring import rebuild_sources
from sablewatch.session import cut_lineage, drop_folder, use_utc


def write_by_day(rows: DataFrame, folder: str, ts: str, key: str) -> None:
    """A table with a folder per day of ``ts``; a day is spread by the hash of ``key``."""
    use_utc(rows.sparkSession)
    (rows.withColumn("day", F.to_date(ts)).repartition("day", F.pmod(F.xxhash64(key), F.lit(16)))
     .write.mode("overwrite").partitionBy("day").parquet(folder))


def expired(rows: DataFrame, cutoff: dt.datetime, ts: str) -> DataFrame:
    """Rows of a table by day that are older than the cutoff; later days are not read."""
    edge = F.lit(cutoff.date())
    return rows.filter((F.col("day") <= edge) & (F.col(ts) < F.lit(cutoff)))


def retire_rows(spark: SparkSession, folder: str, cutoff: dt.datetime, ts: str) -> None:
    """Drop the rows of a day-partitioned table that are older than ``cutoff`` (UTC).

    The day of the cutoff is written again first, then older days are dropped; a run
    that was cut off is finished by the next one. Rows without a time stay.
    """
    rows = spark.read.parquet(folder)
    # One row per day folder.
    days = [r.day for r in rows.select("day").distinct().collect() if r.day is not None]
    if cutoff.date() in days:
        kept = cut_lineage(rows.filter((F.col("day") == F.lit(cutoff.date())) & (F.col(ts) >= F.lit(cutoff))))
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(folder)
        if kept.isEmpty():
            drop_folder(spark, f"{folder}/day={cutoff.date()}")
    for day in days:
        if day < cutoff.date():
            drop_folder(spark, f"{folder}/day={day}")


def retire_sources(sources: DataFrame, touched: DataFrame, left: DataFrame, as_of: Column) -> DataFrame:
    """The source table once the events of ``touched(src_ip)`` before the cutoff are gone.

    ``left`` are the remaining events. Other sources keep their rows.
    """
    kept = sources.join(touched, "src_ip", "left_anti")
    rebuilt = rebuild_sources(left, as_of, only=touched)
    return kept.unionByName(rebuilt.select(*kept.columns))


def apply_retention(spark: SparkSession, tables: dict[str, tuple[str, str]], cutoff: dt.datetime,
                    sources: DataFrame, as_of: Column) -> DataFrame:
    """Retire all ``tables`` (name to folder and time column; one is ``events``).

    Returns the source table that belongs to the remaining events.
    """
    folder, ts = tables["events"]
    touched = cut_lineage(expired(spark.read.parquet(folder), cutoff, ts).select("src_ip").distinct())
    for path, column in tables.values():
        retire_rows(spark, path, cutoff, column)
    return retire_sources(sources, touched, spark.read.parquet(folder).drop("day"), as_of)
