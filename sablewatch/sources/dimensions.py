"""Dimension and payload scans: indicators, feeds, prefixes, geography, files."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sablewatch.functions.columns import has_text
from sablewatch.functions.net import let, parse_network
from sablewatch.session import cut_lineage


def _indicator_rows(tokens: DataFrame, source: Column) -> DataFrame:
    """``kind, value, source`` of valid addresses and networks."""

    def row(token: Column) -> Column:
        kind = F.when(token.contains("/"), "cidr").otherwise("ip")
        valid = has_text(token) & parse_network(token).isNotNull()
        return F.when(valid, F.struct(kind.alias("kind"), token.alias("value")))

    rows = tokens.select(
        F.explode(F.array_compact(F.array(let(F.col("token"), row)))).alias("r"),
        source.alias("source"),
    )
    return rows.select("r.*", "source")


def read_indicators(spark: SparkSession, path: str) -> DataFrame:
    """``*.txt`` lists, one address or network per line; the file names the source."""
    lines = spark.read.option("pathGlobFilter", "*.txt").text(path).select(
        F.trim(F.substring_index("value", "#", 1)).alias("token"),
        F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", "").alias("_stem"),
    )
    return _indicator_rows(lines, F.concat(F.lit("ti:"), "_stem")).distinct()


def clean_feed(lines: DataFrame, source: str) -> DataFrame:
    """Valid addresses and networks of a landed feed (``value`` lines).

    Comments after ``#`` or ``;`` go; of several fields the first counts.
    """
    bare = F.trim(F.substring_index(F.substring_index("value", "#", 1), ";", 1))
    tokens = lines.select(F.get(F.split(bare, r"\s+"), F.lit(0)).alias("token"))
    return _indicator_rows(tokens, F.lit(source))


def parse_prefixes(lines: DataFrame) -> DataFrame:
    """``prefix, asn, as_org`` of tab lines (two spaces or commas as a fallback)."""

    def fields(p: Column) -> Column:
        asn = F.regexp_replace(F.upper(F.trim(F.get(p, F.lit(1)))), "^AS", "")
        row = F.struct(
            F.trim(F.get(p, F.lit(0))).alias("prefix"),
            F.when(asn.rlike(r"^\d{1,18}$"), asn).cast("bigint").alias("asn"),
            F.coalesce(F.trim(F.get(p, F.lit(2))), F.lit("")).alias("as_org"),
        )
        return let(
            F.when(F.size(p) >= 2, row),
            lambda r: F.when(
                r["asn"].isNotNull() & parse_network(r["prefix"]).isNotNull(), r
            ),
        )

    def record(line: Column) -> Column:
        parts = F.when(line.contains("\t"), F.split(line, "\t")).otherwise(
            F.split(line, r"\s{2,}|,")
        )
        return F.when((line != "") & ~line.startswith("#"), let(parts, fields))

    # One nested expression, exploded: a filter on it would compute it twice.
    rows = lines.select(F.explode(F.array_compact(F.array(let(F.trim("value"), record)))).alias("r"))
    return rows.select("r.*")


def read_prefixes(spark: SparkSession, path: str) -> DataFrame:
    return parse_prefixes(spark.read.text(path))


def read_geo(spark: SparkSession, path: str) -> DataFrame:
    """Geography by network from CSV: ``network, country, ..., longitude``."""
    return spark.read.schema(
        "network string, country string, country_name string, city string, "
        "latitude double, longitude double"
    ).csv(path, header=True)


def list_payload_files(spark: SparkSession, path: str, pattern: str = "*.bin") -> DataFrame:
    """``path, filename, modified, length`` of captured files; no content is read."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
        .load(path)
        .select("path", F.element_at(F.split("path", "/"), -1).alias("filename"),
                F.col("modificationTime").alias("modified"), "length")
    )


#: Bytes of files that one task reads, about.
TASK_BYTES = 64 << 20


def read_payload_files(listing: DataFrame, with_content: bool = True, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The listed files with ``sha256``, ``content`` and ``error``.

    A file that cannot be read, or whose bytes are not as many as listed, gives a row
    with an error instead of a content, and stops nothing. Only the listing is
    shuffled; tasks get about ``task_bytes`` of files each. Without contents, files are
    hashed in parts of a megabyte and never held whole.
    """
    total = listing.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first().n
    tasks = max(1, -(-total // task_bytes))

    def run(batches):
        from pyarrow import fs as pafs

        for batch in batches:
            columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                uri, length = columns["path"][i].as_py(), columns["length"][i].as_py()
                digest, parts, error = hashlib.sha256(), [], None
                try:
                    if uri.startswith("file:/"):
                        uri = "/" + uri.removeprefix("file:").lstrip("/")
                    store, name = pafs.FileSystem.from_uri(uri)
                    n = 0
                    with store.open_input_stream(name) as file:
                        while part := file.read(1 << 20):
                            n += len(part)
                            digest.update(part)
                            if with_content:
                                parts.append(part)
                    if n != length:
                        error = f"{n} of {length} bytes"
                except (OSError, pa.ArrowException) as problem:
                    error = f"{type(problem).__name__}: {problem}"
                row = {name: column.slice(i, 1) for name, column in columns.items()}
                ok = error is None
                row["sha256"] = pa.array([digest.hexdigest() if ok else None], pa.string())
                row["error"] = pa.array([error], pa.string())
                row["content"] = pa.array([b"".join(parts) if ok and with_content else None], pa.binary())
                yield pa.RecordBatch.from_pydict(row)

    return listing.select("path", "filename", "modified", "length").repartition(tasks, "path").mapInArrow(
        run, "path string, filename string, modified timestamp, length long, sha256 string, error string, content binary")


def new_payload_files(listing: DataFrame, known: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """``(files, counts)``: contents of the hashes that ``known(sha256)`` lacks, once each.

    Every file is hashed as a stream; of equal files the least path counts, and only
    that one's bytes are loaded, in the tasks that go on to work with them: no bytes
    are shuffled. ``counts`` is one row ``seen, new, known, errors``.
    """
    digests = cut_lineage(read_payload_files(listing, with_content=False).drop("content"))
    fresh = digests.filter("error IS NULL").groupBy("sha256").agg(F.min("path").alias("path"))
    if known is not None:
        fresh = fresh.join(known.select("sha256"), "sha256", "left_anti")
    fresh = cut_lineage(fresh)
    files = read_payload_files(listing.join(fresh.select("path"), "path", "left_semi"))
    new = fresh.agg(F.count("*")).scalar()
    counts = digests.agg(
        F.count("*").alias("seen"), F.count("error").alias("errors"), F.count_distinct("sha256").alias("hashes"),
    ).withColumn("new", new).select("seen", "new", (F.col("hashes") - F.col("new")).alias("known"), "errors")
    return files, counts


def newest_files(files: DataFrame, limit: int | None) -> DataFrame:
    ordered = files.orderBy(F.desc("modified"), "filename")
    return ordered.limit(limit) if limit else ordered
