"""Payload corpus and campaign queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sablewatch.catalog.adapter import events, sql, texts
from sablewatch.catalog.registry import query
from sablewatch.functions.columns import micros, rounded
from sablewatch.operators import campaigns as C
from sablewatch.operators import payloads as P
from sablewatch.session import shared_folder
from sablewatch.sources.sinks import read_events

# --------------------------------------------------------------------------- #
# Payloads
# --------------------------------------------------------------------------- #


def files(spark, sf):
    """Page bodies as captured files."""
    return texts(spark, sf, "pages", "page_id").select("page_id", F.encode("html", "UTF-8").alias("content"))


@query("payload_dedupe", """
  SELECT sha256(text) AS sha256, count(*) OVER () AS payloads
  FROM (SELECT DISTINCT text FROM documents)""")
def payload_dedupe(spark, sf):
    docs = texts(spark, sf, "documents", "doc_id").select(F.encode("text", "UTF-8").alias("content"))
    unique = P.deduplicate(docs)
    return unique.select("sha256", unique.agg(F.count("*")).scalar().alias("payloads"))


_TYPED = """WITH raw AS (
  SELECT page_id, CASE page_id % 5 WHEN 0 THEN '#!/usr/bin/python' || chr(10) || html
    WHEN 1 THEN 'MZ' || html WHEN 2 THEN '%PDF' || html WHEN 3 THEN 'BZh' || html ELSE html END
    AS body FROM pages)"""


def typed_files(spark, sf):
    n, html = F.col("page_id") % 5, F.col("html")
    body = (
        F.when(n == 0, F.concat(F.lit("#!/usr/bin/python\n"), html))
        .when(n == 1, F.concat(F.lit("MZ"), html))
        .when(n == 2, F.concat(F.lit("%PDF"), html))
        .when(n == 3, F.concat(F.lit("BZh"), html))
        .otherwise(html))
    return texts(spark, sf, "pages", "page_id").select("page_id", F.encode(body, "UTF-8").alias("content"))


@query("file_types", _TYPED + """
  SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'script-python' WHEN 1 THEN 'pe' WHEN 2 THEN 'pdf'
    WHEN 3 THEN 'bzip2' ELSE CASE WHEN good / total > 0.9 THEN 'text' ELSE 'unknown' END END
    AS file_type
  FROM (SELECT page_id, count(*) FILTER (b BETWEEN '20' AND '7E' OR b IN ('09', '0A', '0D')) AS good,
    count(*) AS total FROM (SELECT page_id, unnest(regexp_extract_all(left(hex(encode(body)), 2048),
      '..')) AS b FROM raw) GROUP BY page_id)""")
def file_types(spark, sf):
    return typed_files(spark, sf).select(
        "page_id", P.file_kind(F.col("content"))["file_type"].alias("file_type"))


_ELF = ["08", "28", "3E", "03", "99"]


def elf_files(spark, sf):
    """ELF headers whose fields follow the page id, followed by the page body."""
    n = F.col("page_id")
    wide = n % 2 == 1
    pick = lambda vs, i: F.element_at(F.array(*[F.lit(v) for v in vs]), (i + 1).cast("int"))
    zeros = lambda k: F.lit("00" * k)
    kind, machine = F.concat(F.lit("0"), n % 4 + 1, F.lit("00")), F.concat(pick(_ELF, n % 5), F.lit("00"))
    segment = F.concat(F.when(n % 3 == 0, "03").otherwise("01"), F.lit("000000"))
    count = F.when(n % 7 == 6, "00").otherwise("01")
    big = F.concat(F.lit("7F454C4602010100" + "00" * 8), kind, machine, zeros(4), zeros(8),
                   F.lit("40" + "00" * 7), zeros(8), zeros(4), zeros(2), F.lit("3800"), count,
                   F.lit("00"), zeros(6), segment, zeros(52))
    small = F.concat(F.lit("7F454C4601010100" + "00" * 8), kind, machine, zeros(4), zeros(4),
                     F.lit("34000000"), zeros(4), zeros(4), zeros(2), F.lit("2000"), count,
                     F.lit("00"), zeros(6), segment, zeros(28))
    raw = F.concat(F.unhex(F.when(wide, big).otherwise(small)), F.encode("html", "UTF-8"))
    return texts(spark, sf, "pages", "page_id").select("page_id", raw.alias("content"))


@query("elf_headers", """
  SELECT page_id, CASE WHEN page_id % 2 = 1 THEN 64 ELSE 32 END AS bits,
    ['relocatable','executable','shared-object','core'][page_id % 4 + 1] AS elf_type,
    ['mips','arm','x86-64','x86','unknown(0x99)'][page_id % 5 + 1] AS arch,
    CASE WHEN page_id % 7 = 6 THEN NULL WHEN page_id % 3 = 0 THEN 'dynamic' ELSE 'static' END
      AS linkage FROM pages""")
def elf_headers(spark, sf):
    rows = elf_files(spark, sf).withColumn("h", P.elf_header(F.col("content")))
    return rows.select("page_id", "h.bits", "h.elf_type", "h.arch", "h.linkage")


@query("pe_headers", """
  SELECT page_id, ['x86','x86-64','unknown(0x1234)'][page_id % 3 + 1] AS arch,
    page_id % 100 AS sections, length(html) % 60000 AS stamp FROM pages""")
def pe_headers(spark, sf):
    le = lambda v, size: F.concat(*[
        F.lpad(F.hex(F.floor(v / (256 ** i)).cast("bigint") % 256), 2, "0") for i in range(size)])
    n = F.col("page_id")
    machine = F.element_at(F.array(F.lit(0x14C), F.lit(0x8664), F.lit(0x1234)),
                           (n % 3 + 1).cast("int"))
    head = F.concat(F.lit("4D5A" + "00" * 58 + "40000000" + "50450000"), le(machine, 2),
                    le(n % 100, 2), le(F.length("html") % 60000, 4), F.lit("00" * 12))
    rows = texts(spark, sf, "pages", "page_id").select(
        "page_id", F.concat(F.unhex(head), F.encode("html", "UTF-8")).alias("content"))
    rows = rows.withColumn("h", P.pe_header(F.col("content")))
    return rows.select("page_id", "h.arch", "h.sections", F.col("h.timestamp").alias("stamp"))


@query("string_census", r"""
  SELECT page_id, CAST(count(DISTINCT s) AS BIGINT) AS strings FROM (
    SELECT page_id, unnest(regexp_extract_all(html, '[\x20-\x7e]{6,}')) AS s FROM pages)
  GROUP BY page_id""")
def string_census(spark, sf):
    from sablewatch.functions.text import latin1

    return files(spark, sf).select(
        "page_id",
        F.size(P.extract_strings(latin1(F.col("content")))).cast("bigint").alias("strings"))


_BYTES = """SELECT page_id, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 3) AS entropy FROM (
  SELECT page_id, b, count(*) AS n FROM (SELECT page_id,
    unnest(regexp_extract_all(hex(encode(html)), '..')) AS b FROM pages) GROUP BY 1, 2)
  GROUP BY page_id"""


@query("byte_entropy", _BYTES)
def byte_entropy(spark, sf):
    return files(spark, sf).select(
        "page_id", F.round(P.byte_entropy("content"), 3).alias("entropy"))


@query("char_entropy", """
  SELECT doc_id, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 4) AS entropy FROM (
    SELECT doc_id, c, count(*) AS n FROM (SELECT doc_id,
      unnest(regexp_extract_all(text, '(?s).')) AS c FROM documents) GROUP BY 1, 2)
  GROUP BY doc_id""")
def char_entropy(spark, sf):
    docs = texts(spark, sf, "documents", "doc_id")
    return docs.select("doc_id", F.round(P.text_entropy("text"), 4).alias("entropy"))


@query("behaviour_tags", sql("""
  SELECT event_id, CASE k % 6 WHEN 1 THEN 'family-string:mirai,iot:busybox' WHEN 2 THEN 'downloader:wget'
    WHEN 4 THEN 'downloader:curl' || ',dropper:tmp-staging' WHEN 5 THEN 'dropper:chmod'
    ELSE '' END AS tags
  FROM ev WHERE kind = 4"""))
def behaviour_tags(spark, sf):
    from sablewatch.functions.text import latin1

    rows = events(spark, sf).filter(F.col("kind") == 4)
    script = F.replace(F.replace("command", F.lit("curl -O"), F.lit("curl - O")),
                       F.lit("/tmp;"), F.lit("/tmp/;"))
    strings = P.extract_strings(latin1(F.encode(script, "UTF-8")))
    return rows.select("event_id", F.array_join(P.behaviour_tags(strings), ",").alias("tags"))


def _ioc_sql(table: str, key: str, column: str) -> str:
    fang = "replace(regexp_replace(v, 'http', 'hxxp'), '.', '[.]')"
    parts = []
    for kind, pattern, keep, shown in (
        ("url", r"""(?i)https?://[^\s"''<>\\)\x00]{4,}""", "TRUE", "v"),
        ("ipv4", r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
         "list_max([CAST(x AS INT) FOR x IN string_split(v, '.')]) <= 255", "v"),
        ("domain", r"(?i)\b(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+"
         r"(?:com|net|org|ru|cn|info|biz|top|xyz|io|cc|su|tk|pw|onion)\b", "TRUE", "lower(v)"),
    ):
        parts.append(f"""SELECT {key}, '{kind}' AS kind, {fang.replace("v,", shown + ",", 1)} AS value
          FROM (SELECT {key}, unnest((regexp_extract_all({column}, '{pattern}'))) AS v
                FROM {table}) WHERE {keep}""")
    return "SELECT DISTINCT * FROM (" + " UNION ALL ".join(parts) + ")"


def _iocs(df, key, column):
    return _ioc_rows(df.select(key, P.extract_iocs(F.col(column)).alias("i")), key, "i")


def _ioc_rows(found, key, column):
    def named(kind):
        return lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))

    rows = [F.transform(f"{column}.{f}", named(k))
            for f, k in (("urls", "url"), ("ipv4", "ipv4"), ("domains", "domain"))]
    return found.select(key, F.explode(F.concat(*rows)).alias("r")).select(key, "r.*")


@query("document_iocs", _ioc_sql("documents", "doc_id", "text"))
def document_iocs(spark, sf):
    return _iocs(texts(spark, sf, "documents", "doc_id"), "doc_id", "text")


@query("page_iocs", _ioc_sql("(SELECT page_id, url || ' ' || html AS body FROM pages)",
                             "page_id", "body"))
def page_iocs(spark, sf):
    pages = texts(spark, sf, "pages", "page_id").select("page_id", F.concat_ws(" ", "url", "html").alias("body"))
    return _iocs(pages, "page_id", "body")


# Kinds by page id: script, packed program (4 KB of digests), PDF, program with the URL
# as UTF-16, big-endian ELF with a symbol table (even ids) or without, plain page.
_ELF_BIG = "7F454C460102010300" + "00" * 7 + "0002" + "0008" + "00" * 4 + "00" * 8
_ELF_BIG += "00000034" + "00" * 6 + "0000" + "0000" + "0028" + "0001" + "0000" + "00000000" + "000000"
_PROFILED = rf"""raw AS (
  SELECT page_id, page_id % 6 AS n, html, url, CASE page_id % 6
    WHEN 0 THEN encode('#!/usr/bin/python' || chr(10) || html)
    WHEN 1 THEN encode('MZ') || unhex(array_to_string([sha256(html || i) FOR i IN range(128)], ''))
    WHEN 2 THEN encode('%PDF' || html)
    WHEN 3 THEN encode('MZ' || html) || unhex('00' || regexp_replace(hex(encode(url)), '(..)', '\100', 'g'))
    WHEN 4 THEN unhex('{_ELF_BIG}' || CASE WHEN page_id % 4 = 0 THEN '02' ELSE '01' END
      || '{"00" * 32}') || encode(html)
    ELSE encode(html) END AS body FROM pages),
  pairs AS (SELECT *, regexp_extract_all(hex(body), '..') AS bytes FROM raw),
  marks AS (SELECT page_id, array_to_string([CASE WHEN x BETWEEN '20' AND '7E' THEN chr(('0x' || x)::INT)
    WHEN x = '00' THEN chr(1) ELSE chr(2) END FOR x IN bytes], '') AS line FROM pairs),
  strings AS (SELECT page_id, count(DISTINCT s) AS n_strings FROM (
    SELECT page_id, unnest(regexp_extract_all(line, '[\x20-\x7e]{{6,}}') || [replace(w, chr(1), '')
      FOR w IN regexp_extract_all(line, '(?:[\x20-\x7e]\x01){{6,}}')]) AS s FROM marks) GROUP BY 1),
  counts AS (SELECT page_id, round_even(log2(sum(c)) - sum(c * log2(c)) / sum(c), 3) AS entropy FROM (
    SELECT page_id, b, count(*) AS c FROM (SELECT page_id, unnest(bytes) AS b FROM pairs) GROUP BY 1, 2)
    GROUP BY 1),
  heads AS (SELECT page_id, avg(CASE WHEN b BETWEEN '20' AND '7E' OR b IN ('09', '0A', '0D')
    THEN 1 ELSE 0 END) AS good FROM (SELECT page_id, unnest(bytes[1:1024]) AS b FROM pairs) GROUP BY 1),
  profiled AS (SELECT page_id, sha256(body) AS sha256, octet_length(body) AS size, entropy,
    coalesce(n_strings, 0) AS strings_count,
    CASE n WHEN 0 THEN 'script-python' WHEN 1 THEN 'pe' WHEN 2 THEN 'pdf' WHEN 3 THEN 'pe'
      WHEN 4 THEN 'elf' ELSE CASE WHEN good > 0.9 THEN 'text' ELSE 'unknown' END END AS file_type,
    CASE WHEN n = 4 THEN 'mips' END AS arch, CASE WHEN n = 4 THEN 'big' END AS endianness,
    CASE WHEN n = 4 THEN 'linux' END AS osabi, CASE WHEN n = 4 THEN 32 END AS bits,
    CASE WHEN n = 4 THEN page_id % 4 <> 0 END AS stripped
    FROM raw JOIN counts USING (page_id) JOIN heads USING (page_id) LEFT JOIN strings USING (page_id)),
  packed AS (SELECT *, entropy >= 7.2 AND file_type IN ('elf', 'pe', 'unknown') AS likely_packed FROM profiled)"""


def profiled_files(spark, sf):
    """The pages as six kinds of captured files; see ``_PROFILED``."""
    n, html = F.col("page_id") % 6, F.col("html")
    utf8 = lambda *parts: F.encode(F.concat(*parts), "UTF-8")
    noise = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(127)),
                                     lambda i: F.sha2(F.concat(html, i.cast("string")), 256)), "")
    section = F.when(F.col("page_id") % 4 == 0, "02").otherwise("01")
    elf = F.unhex(F.concat(F.lit(_ELF_BIG), section, F.lit("00" * 32)))
    content = (
        F.when(n == 0, utf8(F.lit("#!/usr/bin/python\n"), html))
        .when(n == 1, F.concat(utf8(F.lit("MZ")), F.unhex(noise)))
        .when(n == 2, utf8(F.lit("%PDF"), html))
        .when(n == 3, F.concat(utf8(F.lit("MZ"), html, F.lit("\0")), F.encode("url", "UTF-16LE")))
        .when(n == 4, F.concat(elf, utf8(html)))
        .otherwise(utf8(html)))
    return texts(spark, sf, "pages", "page_id").select("page_id", content.alias("content"))


@query("payload_profile", "WITH " + _PROFILED + " SELECT * FROM packed")
def payload_profile(spark, sf):
    return P.profile(profiled_files(spark, sf)).select(
        "page_id", "sha256", "size", "entropy", "strings_count", "file_type", "arch",
        "elf.endianness", "elf.osabi", "elf.bits", "stripped", "likely_packed")


@query("payload_profile_iocs", _ioc_sql("pages", "page_id", "html"))
def payload_profile_iocs(spark, sf):
    """Indicators as the profile of the raw bytes lists them."""
    found = P.profile(files(spark, sf)).select("page_id", "iocs")
    return _ioc_rows(found, "page_id", "iocs")


_NEXT = ("WITH " + _PROFILED + """, one AS (SELECT sha256, any_value(likely_packed) AS likely_packed,
    any_value(strings_count) AS strings_count, any_value(entropy) AS entropy,
    bool_or(page_id % 4 = 0) AS known FROM packed WHERE page_id % 7 <> 3 GROUP BY sha256),
  n AS (SELECT count(*) AS seen, count(*) FILTER (page_id % 7 = 3) AS errors,
    count(*) FILTER (page_id % 7 <> 3 AND sha256 NOT IN (SELECT sha256 FROM one WHERE known))
      AS analysed FROM packed)""")


@query("payload_profile_new", _NEXT + """
  SELECT seen, errors, analysed, seen - errors - analysed AS skipped FROM n""")
def payload_profile_new(spark, sf):
    return _profiled_anew(spark, sf)[1]


@query("payload_table_next", _NEXT + """
  SELECT sha256, likely_packed, strings_count, entropy, CAST(0 AS BIGINT) AS event_count FROM one""")
def payload_table_next(spark, sf):
    """The payload table after the run: what was stored and what is new."""
    return _profiled_anew(spark, sf)[0].select(
        "sha256", "likely_packed", "strings_count", "entropy", "event_count")


def _profiled_anew(spark, sf):
    """A seventh of the files cannot be read; every fourth readable one is stored already."""
    bad = F.col("page_id") % 7 == 3
    every = profiled_files(spark, sf).withColumn("content", F.when(~bad, F.col("content")))
    stored = P.profile(every.filter((F.col("page_id") % 4 == 0) & ~bad)).dropDuplicates(["sha256"])
    return P.profile_new(every, stored, events(spark, sf))


_SEEN = """seen AS (SELECT payload_sha256 AS sha256, min(epoch_us(ts)) AS first_us,
  max(epoch_us(ts)) AS last_us, count(*) AS event_count FROM ev
  WHERE payload_sha256 IS NOT NULL GROUP BY 1)"""
_PAYLOADS = """pays AS (SELECT DISTINCT sha256('payload-' || page_id % 25) AS sha256, page_id % 25 AS i
  FROM pages)"""


def payload_table(spark, sf):
    """Names by page number; five were never seen in an event."""
    i = (F.col("page_id") % 25).alias("i")
    names = texts(spark, sf, "pages", "page_id").select(i).distinct()
    return names.select("i", F.sha2(F.concat(F.lit("payload-"), "i"), 256).alias("sha256"),
                        F.array(F.concat(F.lit("tag-"), F.col("i") % 3)).alias("behaviour_tags"),
                        F.element_at(F.array(F.lit("mips"), F.lit("arm"), F.lit(None)),
                                     (F.col("i") % 3 + 1).cast("int")).alias("arch"))


@query("payload_sightings", sql("""
  SELECT sha256, first_us, last_us, coalesce(event_count, 0) AS event_count
  FROM pays LEFT JOIN seen USING (sha256)""", _SEEN, _PAYLOADS))
def payload_sightings(spark, sf):
    rows = P.with_sightings(payload_table(spark, sf), events(spark, sf))
    return rows.select("sha256", micros("first_seen").alias("first_us"),
                       micros("last_seen").alias("last_us"), "event_count")


@query("payload_listing", sql("""
  SELECT sha256, event_count, count(*) OVER () AS total FROM (
    SELECT p.sha256, coalesce(event_count, 0) AS event_count FROM pays p
    LEFT JOIN seen USING (sha256) WHERE i % 3 = 1)
  ORDER BY event_count DESC, sha256 LIMIT 4""", _SEEN, _PAYLOADS))
def payload_listing(spark, sf):
    rows = P.with_sightings(payload_table(spark, sf), events(spark, sf))
    return P.list_payloads(rows, behaviour_tag="tag-1", sort="event_count", limit=4).select(
        "sha256", "event_count", "total")


@query("payload_sources", sql("""
  SELECT src_ip, count(*) AS events, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us
  FROM ev WHERE payload_sha256 = sha256('payload-3') GROUP BY 1
  ORDER BY last_us DESC, src_ip LIMIT 50"""))
def payload_sources(spark, sf):
    import hashlib

    wanted = hashlib.sha256(b"payload-3").hexdigest()
    return P.payload_sources(events(spark, sf), wanted).select(
        "src_ip", "events", micros("first_seen").alias("first_us"),
        micros("last_seen").alias("last_us"))


@query("payload_census", """
  SELECT ['mips','arm','x86-64','x86','unknown(0x99)'][page_id % 5 + 1] AS arch, count(*) AS n
  FROM pages GROUP BY 1""")
def payload_census(spark, sf):
    return P.census(P.profile(elf_files(spark, sf)), "arch")


@query("payload_files", """
  WITH f AS (SELECT page_id, html, sha256(html) AS h, page_id % 50 = 0 AS cut FROM pages),
  good AS (SELECT h, min(octet_length(encode(html))) AS size, bool_or(page_id % 3 = 0) AS known FROM f WHERE NOT cut GROUP BY h),
  old AS (SELECT DISTINCT sha256(html) AS h FROM pages WHERE page_id % 3 = 0)
  SELECT 'file' AS kind, h AS name, CAST(size AS BIGINT) AS n FROM good WHERE h NOT IN (SELECT h FROM old)
  UNION ALL SELECT 'count', 'seen', count(*) + 1 FROM f
  UNION ALL SELECT 'count', 'errors', count(*) FILTER (cut) + 1 FROM f
  UNION ALL SELECT 'count', 'new', count(*) FROM good WHERE h NOT IN (SELECT h FROM old)
  UNION ALL SELECT 'count', 'known', count(*) FROM good WHERE h IN (SELECT h FROM old)""")
def payload_files(spark, sf):
    """Pages as captured files: some listed longer than they are, one gone, a third known."""
    from sablewatch.session import cut_lineage
    from sablewatch.sources import dimensions as D
    from sablewatch.sources.sinks import write_payload_files

    folder = f"{shared_folder(spark, 'files')}/captured"
    pages = files(spark, sf)
    write_payload_files(pages.select(F.concat(F.col("page_id"), F.lit(".bin")).alias("filename"), "content"), folder)
    listing = D.list_payload_files(spark, folder)
    number = F.split_part("filename", F.lit("."), F.lit(1)).cast("long")
    listing = listing.withColumn("length", F.when(number % 50 == 0, F.col("length") + 1).otherwise(F.col("length")))
    gone = listing.limit(1).withColumns({"path": F.lit(f"{folder}/gone.bin"), "filename": F.lit("gone.bin")})
    listing = cut_lineage(listing.unionByName(gone))
    known = pages.filter("page_id % 3 = 0").select(F.sha2("content", 256).alias("sha256")).distinct()
    new, counts = D.new_payload_files(listing, known)
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in counts.columns])
    told = counts.select(F.explode(pairs).alias("p")).select(F.lit("count").alias("kind"), "p.name", "p.n")
    return new.select(F.lit("file").alias("kind"), F.col("sha256").alias("name"), F.octet_length("content").cast("long").alias("n")).unionByName(told)


@query("indicator_files", """
  SELECT kind, value, 'ti:list' || n AS source FROM (
    SELECT DISTINCT 'ip' AS kind, '45.1.' || (user_id % 200) || '.' || (event_id % 250) AS value, event_id % 3 AS n FROM events
    UNION SELECT DISTINCT 'cidr', '45.' || (user_id % 200) || '.0.0/16', event_id % 3 FROM events)""")
def indicator_files(spark, sf):
    """Lists landed as files, with comments, blank and bad lines; the file names the list."""
    from sablewatch.catalog.adapter import load
    from sablewatch.sources import dimensions as D
    from sablewatch.sources.sinks import write_payload_files

    folder = f"{shared_folder(spark, 'files')}/lists"
    e, u = F.col("event_id"), F.col("user_id")
    lines = F.array(F.concat(F.lit("45.1."), u % 200, F.lit("."), e % 250, F.lit("  # seen")),
                    F.concat(F.lit("45."), u % 200, F.lit(".0.0/16")), F.lit("# none"), F.lit(""), F.lit("45.1.300.1"))
    rows = load(spark, sf, "events").select((e % 3).alias("n"), F.explode(lines).alias("line")).distinct()
    # Three lists of at most 50,000 addresses and 200 networks.
    whole = rows.groupBy("n").agg(F.concat_ws("\n", F.collect_list("line")).alias("text"))
    write_payload_files(whole.select(F.concat(F.lit("list"), "n", F.lit(".txt")).alias("filename"),
                                     F.encode("text", "UTF-8").alias("content")), folder)
    return D.read_indicators(spark, folder)


# --------------------------------------------------------------------------- #
# Campaigns
# --------------------------------------------------------------------------- #

TOKENS = """tokens AS (
  SELECT DISTINCT src_ip, facet, value FROM (
    SELECT src_ip, 'paths' AS facet, '/p' || k // 4 AS value FROM ev WHERE kind = 5
    UNION ALL SELECT src_ip, 'credentials', uid % 13 || ':' || k // 50 FROM ev WHERE kind = 0
    UNION ALL SELECT src_ip, 'usernames', 'u' || uid % 17 FROM ev WHERE kind = 1
    UNION ALL SELECT src_ip, 'services', service FROM ev
    UNION ALL SELECT src_ip, 'tags', tag FROM ev WHERE tag <> ''
    UNION ALL SELECT src_ip, 'payloads', payload_sha256 FROM ev WHERE kind = 10 AND k < 10))"""
_WEIGHTS = ("CASE facet WHEN 'payloads' THEN 3.0 WHEN 'credentials' THEN 2.5 WHEN 'paths' THEN 1.5 "
            "WHEN 'services' THEN 0.25 ELSE 1.0 END")
EDGES = f"""sizes AS (SELECT src_ip, facet, count(*) AS n FROM tokens GROUP BY 1, 2),
  ips AS (SELECT DISTINCT src_ip FROM tokens WHERE facet NOT IN ('services', 'tags')),
  common AS (SELECT a.src_ip AS a, b.src_ip AS b, a.facet, count(*) AS both FROM tokens a
    JOIN tokens b ON a.facet = b.facet AND a.value = b.value AND a.src_ip < b.src_ip
    GROUP BY 1, 2, 3),
  facets AS (SELECT DISTINCT facet, {_WEIGHTS} AS w FROM tokens),
  scores AS (SELECT x.src_ip AS a, y.src_ip AS b,
      sum(CASE WHEN c.both > 0 THEN w * c.both / (coalesce(s.n, 0) + coalesce(t.n, 0) - c.both)
        ELSE 0 END) / sum(CASE WHEN s.n > 0 OR t.n > 0 THEN w ELSE 0 END) AS score
    FROM ips x JOIN ips y ON x.src_ip < y.src_ip CROSS JOIN facets f
    LEFT JOIN sizes s ON s.src_ip = x.src_ip AND s.facet = f.facet
    LEFT JOIN sizes t ON t.src_ip = y.src_ip AND t.facet = f.facet
    LEFT JOIN common c ON c.a = x.src_ip AND c.b = y.src_ip AND c.facet = f.facet
    GROUP BY 1, 2),
  edges AS (SELECT * FROM scores WHERE score >= 0.35 - 1e-9)"""


def tokens(spark, sf):
    ev = events(spark, sf)
    kind, k = F.col("kind"), F.col("k")
    cell = lambda cond, facet, value: F.when(
        cond, F.struct(F.lit(facet).alias("facet"), value.alias("value")))
    cells = F.array_compact(F.array(
        cell(kind == 5, "paths", F.concat(F.lit("/p"), F.floor(k / 4))),
        cell(kind == 0, "credentials", F.concat_ws(":", F.col("uid") % 13, F.floor(k / 50))),
        cell(kind == 1, "usernames", F.concat(F.lit("u"), F.col("uid") % 17)),
        cell(F.lit(True), "services", F.col("service")),
        cell(F.size("tags") > 0, "tags", F.get("tags", 0)),
        cell((kind == 10) & (k < 10), "payloads", F.col("payload_sha256")),
    ))
    rows = ev.select("src_ip", F.explode(cells).alias("c")).select("src_ip", "c.*").distinct()
    return C.usable_tokens(rows)


@query("fingerprints", sql("SELECT facet, count(*) AS tokens, count(DISTINCT value) AS uniq "
                           "FROM tokens WHERE src_ip IN (SELECT src_ip FROM tokens "
                           "WHERE facet NOT IN ('services', 'tags')) GROUP BY 1", TOKENS))
def fingerprints(spark, sf):
    return tokens(spark, sf).groupBy("facet").agg(
        F.count("*").alias("tokens"), F.count_distinct("value").alias("uniq"))


@query("fingerprint_tokens", sql("""
  SELECT DISTINCT src_ip, facet, v AS value FROM (
    SELECT src_ip, 'credentials' AS facet, username || ':' || password AS v FROM ev
      WHERE username IS NOT NULL AND password IS NOT NULL
    UNION ALL SELECT src_ip, 'payloads', payload_sha256 FROM ev WHERE payload_sha256 IS NOT NULL
    UNION ALL SELECT src_ip, 'services', service FROM ev
    UNION ALL SELECT src_ip, facet, v FROM (
      SELECT src_ip, facet, v, row_number() OVER (PARTITION BY src_ip, facet ORDER BY count(*) DESC, v) AS rn
      FROM (SELECT src_ip, 'usernames' AS facet, username AS v FROM ev WHERE username <> ''
        UNION ALL SELECT src_ip, 'paths', path FROM ev WHERE path <> '') GROUP BY 1, 2, 3) WHERE rn <= 10)"""))
def fingerprint_tokens(spark, sf):
    """Five facets as values; the tags, which the score derives, are checked by source_tags."""
    from sablewatch.catalog.sources_view import sources

    rows = C.fingerprint_tokens(sources(spark, sf), events(spark, sf))
    return rows.filter(F.col("facet") != "tags")


@query("similarity_edges", sql("SELECT a, b, round(score, 6) AS score FROM edges", TOKENS, EDGES))
def similarity_edges(spark, sf):
    return C.similarity_edges(tokens(spark, sf)).select(
        "a", "b", rounded("score", 6).alias("score"))


_REACH = """links AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
  reach AS (SELECT a AS node, a AS seen FROM links UNION
    SELECT r.node, l.b FROM reach r JOIN links l ON r.seen = l.a),
  comps AS (SELECT node AS src_ip, min(seen) AS campaign FROM reach GROUP BY node),
  cohesion AS (SELECT campaign, avg(score) AS cohesion FROM edges JOIN comps ON src_ip = a
    GROUP BY 1)"""


def _recursive(body, *ctes):
    return sql(body, *ctes).replace("WITH ", "WITH RECURSIVE ", 1)


@query("campaigns", _recursive("""
  SELECT campaign, size, CAST(events AS BIGINT) AS event_count, round(cohesion, 5) AS cohesion
  FROM (SELECT campaign, count(*) AS size, sum(n) AS events FROM comps
    JOIN (SELECT src_ip, count(*) AS n FROM ev GROUP BY 1) USING (src_ip) GROUP BY 1)
  JOIN cohesion USING (campaign) WHERE size >= 2""", TOKENS, EDGES, _REACH))
def campaigns(spark, sf):
    found, _ = _campaigns(spark, sf)
    return found.select("campaign", "size", "event_count", F.round("cohesion", 5).alias("cohesion"))


def _campaigns(spark, sf, threshold=C.CAMPAIGN_THRESHOLD):
    ev = events(spark, sf)
    table = ev.groupBy("src_ip").agg(
        F.count("*").alias("event_count"), F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"), F.max("asn").alias("asn"),
        F.max("country").alias("country"), F.lit("probe").alias("classification"))
    return C.find_campaigns(tokens(spark, sf), table, threshold)


@query("campaign_facts", _recursive("""
  SELECT DISTINCT campaign, 'member' AS kind, src_ip AS value FROM comps
  UNION SELECT DISTINCT campaign, 'country', country FROM comps JOIN ev USING (src_ip)
    WHERE country IS NOT NULL
  UNION SELECT DISTINCT campaign, 'asn', CAST(asn AS VARCHAR) FROM comps JOIN ev USING (src_ip)
    WHERE asn IS NOT NULL
  UNION SELECT DISTINCT campaign, 'classification', 'probe' FROM comps""", TOKENS, EDGES, _REACH))
def campaign_facts(spark, sf):
    return _campaigns(spark, sf)[1]


@query("campaign_shared_values", _recursive("""
  SELECT campaign, facet, string_agg(value, ',' ORDER BY value) AS shared
  FROM (SELECT campaign, facet, value, count(*) AS n FROM comps JOIN tokens USING (src_ip)
    WHERE facet IN ('credentials', 'payloads', 'paths') GROUP BY 1, 2, 3)
  JOIN (SELECT campaign, count(*) AS size FROM comps GROUP BY 1) USING (campaign)
  WHERE n = size GROUP BY 1, 2""", TOKENS, EDGES.replace("0.35", "0.45"), _REACH))
def campaign_shared_values(spark, sf):
    """At a threshold that leaves several campaigns, whose members have values in common."""
    found, _ = _campaigns(spark, sf, 0.45)
    cells = F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f"shared_{f}").alias("vs"))
                      for f in ("credentials", "payloads", "paths")])
    rows = found.select("campaign", F.explode(cells).alias("c")).select("campaign", "c.*")
    return rows.filter(F.col("vs").isNotNull()).select(
        "campaign", "facet", F.array_join("vs", ",").alias("shared"))


# --------------------------------------------------------------------------- #
# Event table
# --------------------------------------------------------------------------- #


@query("event_table", sql("SELECT session_id, count(*) AS events FROM ev GROUP BY 1"))
def event_table(spark, sf):
    """Written by day and read back with a day filter that prunes folders."""
    from sablewatch.sources.sinks import write_events

    folder = f"{shared_folder(spark, "stream")}/events"
    write_events(events(spark, sf), folder, mode="overwrite")
    return read_events(spark, folder).groupBy("session_id").agg(F.count("*").alias("events"))
