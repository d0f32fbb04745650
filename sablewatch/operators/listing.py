"""Stored listings: pages by sort key without sorting or counting the table again.

``store_listing`` writes a table in zones of neighbouring sort keys, with one row per zone
(rows, first and last key). A page by offset or behind a cursor reads only the zones
that hold it; the total is a sum over zones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sablewatch.session import use_utc

ZONE_ROWS = 100_000


class Listing:
    """A stored table sorted by ``sort`` (descending, nulls last) and ``key`` (ascending)."""

    def __init__(self, spark: SparkSession, folder: str, sort: str, key: str):
        self.spark, self.sort, self.key = use_utc(spark), sort, key
        self.rows, self.zones = f"{folder}/rows", f"{folder}/zones"

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.rows).drop("zone")

    def total(self) -> int:
        return self._zones().agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def _zones(self) -> DataFrame:
        return self.spark.read.parquet(self.zones)

    def _order(self) -> list:
        return [F.col(self.sort).desc_nulls_last(), F.col(self.key).asc()]

    def _page(self, zones: list[int], limit: int, skip: int = 0, where=None) -> DataFrame:
        rows = self.spark.read.parquet(self.rows).filter(F.col("zone").isin(zones))
        rows = rows if where is None else rows.filter(where)
        out = rows.drop("zone").orderBy(*self._order())
        return (out.offset(skip) if skip else out).limit(limit).withColumn("total", F.lit(self.total()).cast("long"))

    def page(self, limit: int, offset: int = 0) -> DataFrame:
        """Rows ``offset`` to ``offset + limit`` with ``total``, the number of all rows."""
        # One row per zone.
        before, wanted, skip = 0, [], 0
        for zone in self._zones().orderBy("zone").collect():
            if before < offset + limit and before + zone.n > offset:
                skip = skip if wanted else offset - before
                wanted.append(zone.zone)
            before += zone.n
        return self._page(wanted, limit, max(skip, 0))

    def after(self, value, key, limit: int) -> DataFrame:
        """The ``limit`` rows that follow the row with this sort value and key."""
        sort, own = F.col(self.sort), F.col(self.key)
        if value is None:
            where = sort.isNull() & (own > F.lit(key))
        else:
            where = (sort < F.lit(value)) | sort.isNull() | ((sort == F.lit(value)) & (own > F.lit(key)))
        need, wanted = limit, []
        for zone in self._zones().orderBy("zone").collect():
            last = (zone.last is None, None if zone.last is None else -zone.last, zone.last_key)
            if not wanted and last <= (value is None, None if value is None else -value, key):
                continue
            wanted.append(zone.zone)
            # The first zone may hold rows before the cursor; the others count in full.
            need -= zone.n if len(wanted) > 1 else 0
            if need <= 0:
                break
        return self._page(wanted, limit, where=where)


def store_listing(rows: DataFrame, folder: str, sort: str, key: str, zone_rows: int = ZONE_ROWS) -> Listing:
    """Store ``rows`` for paging by a numeric ``sort`` column, then ``key``. ``rows`` is read once or twice."""
    spark = rows.sparkSession
    out = Listing(spark, folder, sort, key)
    stored = f"{folder}/all"
    rows.write.mode("overwrite").parquet(stored)
    rows = spark.read.parquet(stored)
    zones = max(1, -(-rows.count() // zone_rows))
    (rows.repartitionByRange(zones, *out._order()).sortWithinPartitions(*out._order())
     .withColumn("zone", F.spark_partition_id()).write.mode("overwrite").partitionBy("zone").parquet(out.rows))
    last = F.max(F.struct(F.col(sort).isNull().alias("missing"), (-F.col(sort)).alias("neg"), F.col(key).alias("own")))
    (spark.read.parquet(out.rows).groupBy("zone").agg(F.count("*").alias("n"), last.alias("l"))
     .select("zone", "n", (-F.col("l.neg")).alias("last"), F.col("l.own").alias("last_key"))
     .coalesce(1).write.mode("overwrite").parquet(out.zones))
    return out
