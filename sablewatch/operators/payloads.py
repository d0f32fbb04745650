"""Payload corpus profiling over a bytes column, and payload reports.

Profiles run once per distinct content. Everything is a native expression
except entropy, which is a vectorised pandas UDF.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sablewatch.constants import (
    BEHAVIOUR_NEEDLES,
    ELF_MACHINES,
    ELF_OSABIS,
    ELF_TYPES,
    FILE_MAGICS,
    IOC_DOMAIN,
    IOC_IPV4,
    IOC_URL,
    MIN_STRING_CHARS,
    PACKABLE_TYPES,
    PACKED_ENTROPY,
    PE_MACHINES,
    SCRIPT_INTERPRETERS,
)
from sablewatch.functions.columns import literal_map, tag_list
from sablewatch.functions.net import let
from sablewatch.functions.text import defang_all, latin1
from sablewatch.operators.search import page

PAYLOAD_SORTS = ("last_seen", "first_seen", "size", "entropy", "event_count")

# --------------------------------------------------------------------------- #
# Identity
# --------------------------------------------------------------------------- #


def deduplicate(files: DataFrame, content: str = "content") -> DataFrame:
    """One row per distinct bytes; the digest, not the bytes, is compared."""
    return files.withColumn("sha256", F.sha2(F.col(content), 256)).dropDuplicates(["sha256"])


def file_kind(content: Column) -> Column:
    """Struct ``(file_type, mime)`` from magic bytes, shebang or printability."""
    head = F.hex(F.substring(content, 1, 8))
    text = latin1(F.substring(content, 1, 1024))
    first_line = F.lower(F.substring_index(F.left(text, F.lit(128)), "\n", 1))
    script = F.lit("script")
    for name in reversed(SCRIPT_INTERPRETERS):
        script = F.when(first_line.contains(name), f"script-{name}").otherwise(script)
    printable = F.length(F.regexp_replace(text, r"[^\x20-\x7e\t\n\r]", ""))
    kind = lambda name, mime: F.struct(
        (name if isinstance(name, Column) else F.lit(name)).alias("file_type"),
        F.lit(mime).alias("mime"),
    )
    out = F.when(F.length(content) == 0, kind("empty", "application/x-empty"))
    for magic, name, mime in FILE_MAGICS:
        out = out.when(head.startswith(magic), kind(name, mime))
    return (
        out.when(head.startswith("2321"), kind(script, "text/x-shellscript"))
        .when(printable / F.length(text) > 0.90, kind("text", "text/plain"))
        .otherwise(kind("unknown", "application/octet-stream"))
    )


# --------------------------------------------------------------------------- #
# Executable headers
# --------------------------------------------------------------------------- #


def _unsigned(content: Column, offset: Column, size: int, little: Column) -> Column:
    """Unsigned integer at a 0-based offset; null past the end of the bytes."""
    raw = F.hex(F.substring(content, (offset + 1).cast("int"), F.lit(size)))
    flipped = F.concat(*[F.substring(raw, 2 * i + 1, 2) for i in reversed(range(size))])
    digits = F.when(little, flipped).otherwise(raw)
    # Offsets above 2^31 cannot point into a byte array.
    inside = (offset >= 0) & (offset <= 2_147_483_000) & (offset + size <= F.length(content))
    return F.when(inside, F.conv(digits, 16, 10).cast("decimal(20,0)"))


def _named(table: dict[int, str], value: Column, hexadecimal: bool) -> Column:
    shown = F.lower(F.hex(value.cast("bigint"))) if hexadecimal else value.cast("string")
    unknown = F.concat(F.lit("unknown(0x" if hexadecimal else "unknown("), shown, F.lit(")"))
    return F.coalesce(F.try_element_at(literal_map(table), value.cast("int")), unknown)


def _table_scan(content: Column, base: dict, find: int, at: int, least: int) -> Column:
    """Walk a header table: 1 found, 0 absent, null when it cannot be told."""
    offset, size, count, little = base["offset"], base["size"], base["count"], base["little"]
    usable = (offset > 0) & (count > 0) & (size >= least)
    entry = lambda i: (offset + i * size).cast("bigint")
    fits = lambda i: entry(i) + at + 4 <= F.length(content)
    hit = lambda i: fits(i) & (_unsigned(content, entry(i) + at, 4, little) == find)
    # Counts are 16-bit fields.
    slots = F.sequence(F.lit(0), F.greatest(count.cast("int"), F.lit(1)) - 1)
    # The walk stops at the first hit or the first entry outside the file.
    first_hit = F.array_position(F.transform(slots, hit), True)
    whole = fits(count.cast("int") - 1)
    reached = fits(first_hit.cast("int") - 1)
    return F.when(
        usable,
        F.when((first_hit > 0) & reached, 1).when(whole, 0),
    )


def elf_header(content: Column) -> Column:
    """Struct of ELF facts; fields are null where the file is cut short."""

    def fields(ident: Column) -> Column:
        wide = ident["cls"] == 2
        little = ident["data"] == 1
        read = lambda off, size: _unsigned(content, off, size, little)
        either = lambda a, b, size_a, size_b: F.when(
            wide, read(F.lit(a), size_a)
        ).otherwise(read(F.lit(b), size_b))
        head = F.struct(
            read(F.lit(16), 2).alias("type"),
            read(F.lit(18), 2).alias("machine"),
            either(32, 28, 8, 4).alias("phoff"),
            either(54, 42, 2, 2).alias("phentsize"),
            either(56, 44, 2, 2).alias("phnum"),
            either(40, 32, 8, 4).alias("shoff"),
            either(58, 46, 2, 2).alias("shentsize"),
            either(60, 48, 2, 2).alias("shnum"),
            little.alias("little"),
        )

        def build(h: Column) -> Column:
            ph = {"offset": h["phoff"], "size": h["phentsize"], "count": h["phnum"],
                  "little": h["little"]}
            sh = {"offset": h["shoff"], "size": h["shentsize"], "count": h["shnum"],
                  "little": h["little"]}
            interp = _table_scan(content, ph, find=3, at=0, least=4)
            symtab = _table_scan(content, sh, find=2, at=4, least=8)
            return F.struct(
                F.when(wide, 64).when(ident["cls"] == 1, 32).alias("bits"),
                F.when(little, "little").when(ident["data"] == 2, "big").alias("endianness"),
                _named(ELF_OSABIS, ident["abi"], False).alias("osabi"),
                _named(ELF_TYPES, h["type"], False).alias("elf_type"),
                _named(ELF_MACHINES, h["machine"], True).alias("arch"),
                F.when(interp == 1, "dynamic").when(interp == 0, "static").alias("linkage"),
                F.when(symtab.isNotNull(), symtab == 0).alias("stripped"),
            )

        return let(head, build)

    byte = lambda i: _unsigned(content, F.lit(i), 1, F.lit(True)).cast("int")
    ident = F.struct(byte(4).alias("cls"), byte(5).alias("data"), byte(7).alias("abi"))
    is_elf = F.hex(F.substring(content, 1, 4)) == "7F454C46"
    return F.when(is_elf & (F.length(content) >= 20), let(ident, fields))


def pe_header(content: Column) -> Column:
    """Struct ``(arch, sections, timestamp)``; nulls for a bare DOS stub."""
    read = lambda off, size: _unsigned(content, off, size, F.lit(True))

    def build(start: Column) -> Column:
        signed = F.hex(F.substring(content, (start + 1).cast("int"), F.lit(4))) == "50450000"
        real = (start <= 2_147_483_000) & (start + 24 <= F.length(content)) & signed
        return F.struct(
            F.when(real, _named(PE_MACHINES, read(start + 4, 2), True)).alias("arch"),
            F.when(real, read(start + 6, 2).cast("bigint")).alias("sections"),
            F.when(real, read(start + 8, 4).cast("bigint")).alias("timestamp"),
        )

    is_pe = F.hex(F.substring(content, 1, 2)) == "4D5A"
    return F.when(
        is_pe & (F.length(content) >= 64), let(read(F.lit(60), 4).cast("bigint"), build)
    )


# --------------------------------------------------------------------------- #
# Contents
# --------------------------------------------------------------------------- #


def extract_strings(text: Column, least: int = MIN_STRING_CHARS) -> Column:
    """Printable runs, ASCII then UTF-16LE, whole, deduplicated in order."""
    narrow = F.regexp_extract_all(text, F.lit(rf"[\x20-\x7e]{{{least},}}"), F.lit(0))
    wide = F.regexp_extract_all(text, F.lit(rf"(?:[\x20-\x7e]\x00){{{least},}}"), F.lit(0))
    wide = F.transform(wide, lambda s: F.replace(s, F.lit("\0"), F.lit("")))
    return F.array_distinct(F.concat(narrow, wide))


def behaviour_tags(strings: Column) -> Column:
    haystack = F.lower(F.array_join(strings, "\n"))
    return let(
        haystack,
        lambda h: F.array_sort(
            F.array_distinct(tag_list(*[(h.contains(n), t) for n, t in BEHAVIOUR_NEEDLES]))
        ),
    )


def extract_iocs(text: Column, byte_text: bool = False) -> Column:
    """Struct of defanged ``urls, ipv4, domains`` in order of appearance.

    ``byte_text`` says that ``text`` holds one character per byte, so URLs are
    read back as UTF-8.
    """
    found = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0))
    octets_fit = lambda a: F.forall(
        F.split(a, r"\."), lambda o: o.cast("int") <= 255
    )
    readable = lambda a: (
        F.transform(a, lambda u: F.try_validate_utf8(F.decode(F.encode(u, "ISO-8859-1"), "UTF-8")))
        if byte_text
        else a
    )
    finish = lambda a: F.array_distinct(defang_all(a))
    return F.struct(
        finish(readable(found(IOC_URL))).alias("urls"),
        finish(F.filter(found(IOC_IPV4), octets_fit)).alias("ipv4"),
        F.array_distinct(
            defang_all(F.transform(found(IOC_DOMAIN), F.lower))
        ).alias("domains"),
    )


@F.pandas_udf(T.DoubleType())
def byte_entropy(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Shannon entropy in bits per byte, one histogram per value."""

    def bits(content) -> float:
        if not content:
            return 0.0
        counts = np.bincount(np.frombuffer(content, dtype=np.uint8), minlength=256)
        share = counts[counts > 0] / len(content)
        return float(-(share * np.log2(share)).sum()) + 0.0

    for batch in batches:
        yield batch.map(bits)


@F.pandas_udf(T.DoubleType())
def text_entropy(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Shannon entropy in bits per character, one histogram per text."""

    def bits(text) -> float:
        if not text:
            return 0.0
        points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        counts = np.unique(points, return_counts=True)[1]
        share = counts / len(points)
        return float(-(share * np.log2(share)).sum()) + 0.0

    for batch in batches:
        yield batch.map(bits)


# --------------------------------------------------------------------------- #
# Profiles
# --------------------------------------------------------------------------- #


def profile(files: DataFrame, content: str = "content") -> DataFrame:
    """Static profile of each row's bytes; hostile input yields nulls, never failure."""
    c = F.col(content)
    staged = (
        files.withColumn("sha256", F.sha2(c, 256))
        .withColumn("size", F.length(c).cast("bigint"))
        .withColumn("entropy", F.bround(byte_entropy(c), 3))
        .withColumn("_kind", file_kind(c))
        .withColumn("_text", latin1(c))
    )
    staged = staged.withColumn("_strings", extract_strings(F.col("_text"))).withColumn(
        "iocs", extract_iocs(F.col("_text"), byte_text=True)
    )
    kind = F.col("_kind.file_type")
    staged = staged.withColumn("elf", F.when(kind == "elf", elf_header(c))).withColumn(
        "pe", F.when(kind == "pe", pe_header(c))
    )
    return staged.select(
        *[x for x in files.columns if x not in (content, "sha256", "size")],
        "sha256",
        "size",
        "entropy",
        kind.alias("file_type"),
        F.col("_kind.mime").alias("mime"),
        F.coalesce("elf.arch", "pe.arch").alias("arch"),
        F.col("elf.linkage").alias("linkage"),
        F.col("elf.stripped").alias("stripped"),
        F.size("_strings").cast("bigint").alias("strings_count"),
        behaviour_tags(F.col("_strings")).alias("behaviour_tags"),
        "iocs",
        "elf",
        "pe",
        ((F.col("entropy") >= PACKED_ENTROPY) & kind.isin(*PACKABLE_TYPES)).alias(
            "likely_packed"
        ),
    )


def sightings(events: DataFrame) -> DataFrame:
    return (
        events.filter(F.col("payload_sha256").isNotNull())
        .groupBy(F.col("payload_sha256").alias("sha256"))
        .agg(
            F.min("ts").alias("first_seen"),
            F.max("ts").alias("last_seen"),
            F.count("*").alias("event_count"),
        )
    )


def with_sightings(payloads: DataFrame, events: DataFrame) -> DataFrame:
    """Add first and last sighting and count; a payload nobody sent gets 0."""
    bare = payloads.drop("first_seen", "last_seen", "event_count")
    return bare.join(sightings(events), "sha256", "left").withColumn(
        "event_count", F.coalesce("event_count", F.lit(0)).cast("bigint")
    )


def profile_new(
    files: DataFrame,
    stored: DataFrame | None,
    events: DataFrame,
    reanalyse: bool = False,
    content: str = "content",
) -> tuple[DataFrame, DataFrame]:
    """``(next payload table, counts)``; known hashes are not profiled again.

    ``counts`` is one row ``seen, analysed, skipped, errors``. A null content is
    an unreadable file.
    """
    readable = files.filter(F.col(content).isNotNull()).withColumn(
        "sha256", F.sha2(F.col(content), 256)
    )
    fresh = readable
    if stored is not None and not reanalyse:
        fresh = readable.join(stored.select("sha256"), "sha256", "left_anti")
    profiles = with_sightings(profile(fresh.dropDuplicates(["sha256"]), content), events)
    table = profiles
    if stored is not None:
        kept = stored.join(profiles.select("sha256"), "sha256", "left_anti")
        kept = with_sightings(kept, events)
        table = kept.select(*profiles.columns).unionByName(profiles)
    counts = files.agg(
        F.count("*").alias("seen"),
        F.count_if(F.col(content).isNull()).alias("errors"),
    ).withColumn("analysed", fresh.agg(F.count("*")).scalar())
    counts = counts.withColumn(
        "skipped", F.col("seen") - F.col("errors") - F.col("analysed")
    )
    return table, counts


def list_payloads(
    payloads: DataFrame,
    *,
    file_type: str | None = None,
    arch: str | None = None,
    behaviour_tag: str | None = None,
    packed_only: bool = False,
    sort: str = "last_seen",
    limit: int = 50,
    offset: int = 0,
) -> DataFrame:
    """One page; every filter, the tag included, applies before paging."""
    if sort not in PAYLOAD_SORTS:
        raise ValueError(f"cannot sort by {sort!r}; use one of {PAYLOAD_SORTS}")
    out = payloads
    if file_type:
        out = out.filter(F.col("file_type") == file_type)
    if arch:
        out = out.filter(F.col("arch") == arch)
    if packed_only:
        out = out.filter(F.col("likely_packed"))
    if behaviour_tag:
        out = out.filter(F.array_contains("behaviour_tags", behaviour_tag))
    return page(out, [F.desc(sort), F.asc("sha256")], limit, offset)


def payload_sources(events: DataFrame, sha256: str, limit: int = 50) -> DataFrame:
    """Sources that delivered one payload, newest first."""
    return (
        events.filter(F.col("payload_sha256") == sha256)
        .groupBy("src_ip")
        .agg(
            F.count("*").alias("events"),
            F.min("ts").alias("first_seen"),
            F.max("ts").alias("last_seen"),
        )
        .orderBy(F.desc("last_seen"), "src_ip")
        .limit(limit)
    )


def payloads_of_source(
    payloads: DataFrame, events: DataFrame, src_ip: str, limit: int = 20
) -> DataFrame:
    """Payloads one source carried, most recent first."""
    carried = (
        events.filter(F.col("src_ip") == src_ip)
        .groupBy(F.col("payload_sha256").alias("sha256"))
        .agg(F.max("ts").alias("carried_at"))
    )
    return (
        payloads.join(carried, "sha256").orderBy(F.desc("carried_at"), "sha256").limit(limit)
    )


def census(payloads: DataFrame, column: str = "arch") -> DataFrame:
    """Counts per architecture (or file type), unknown left out."""
    return (
        payloads.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), column)
    )
