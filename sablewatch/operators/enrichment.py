"""Geography, network owner and indicator joins.

Addresses are looked up once per distinct value, then joined back to events.
A longest-prefix lookup is an equi-join on (version, length, network key).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sablewatch.constants import (
    GENERIC_USERNAMES,
    MALWARE_AGENTS,
    OPERATOR_WORDS,
    SCANNER_AGENTS,
    SCORE_CIDR,
    SCORE_EXACT_IP,
    SCORE_GENERIC_USERNAME,
    SCORE_MALWARE_AGENT,
    SCORE_SCANNER_AGENT,
    SCORE_SHORT_AGENT,
)
from sablewatch.functions.columns import (
    contains_any,
    empty_strings,
    has_text,
    strings_or_empty,
    tag_list,
)
from sablewatch.functions.net import (
    classify_address,
    let,
    network_key,
    parse_address,
    parse_network,
    range_cover,
    range_width,
    scope_of,
)
from sablewatch.functions.skew import join_facts
from sablewatch.functions.text import marked_name, marked_words
from sablewatch.schemas import column_or_null

# --------------------------------------------------------------------------- #
# Address lookups
# --------------------------------------------------------------------------- #


def distinct_addresses(events: DataFrame, ip: str = "src_ip") -> DataFrame:
    """``ip, address, scope`` of every distinct address."""
    return (
        events.select(F.col(ip).alias("ip"))
        .filter(has_text("ip"))
        .distinct()
        .withColumn("address", parse_address(F.col("ip")))
        .withColumn("scope", scope_of(F.col("address")))
    )


def network_table(dim: DataFrame, cidr: str) -> DataFrame:
    """Add the join key ``version, plen, key``; unparseable rows are dropped."""
    parsed = F.explode(F.array_compact(F.array(parse_network(F.col(cidr))))).alias("_net")
    return dim.select("*", parsed).select("*", "_net.*").drop("_net")


def longest_prefix_match(addresses: DataFrame, layers: dict[str, DataFrame]) -> DataFrame:
    """``ip`` and, per layer, the value of the most specific covering network.

    A layer is ``version, plen, key, <layer name>``; all layers share one pass.
    Each address becomes one row per prefix length that occurs (at most 33 or
    129), joined by key and reduced with ``max_by``. Of equal networks the
    smaller value counts.
    """
    names = list(layers)
    key = ["version", "plen", "key"]
    stacked = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [layers[n].select(*key, n) for n in names],
    )
    dim = stacked.groupBy(*key).agg(*[F.min(n).alias(n) for n in names])
    return (
        _probes(addresses, stacked).join(dim, key)
        .groupBy("ip")
        .agg(*[F.max_by(n, F.when(F.col(n).isNotNull(), F.col("plen"))).alias(n) for n in names])
    )


def _probes(addresses: DataFrame, networks: DataFrame) -> DataFrame:
    """Each address's network of every prefix length that occurs (at most 33 or 129)."""
    lengths = networks.groupBy("version").agg(F.collect_set("plen").alias("plens"))
    return (
        addresses.filter(F.col("address").isNotNull())
        .select("ip", "address.*")
        .join(F.broadcast(lengths), "version")  # two rows: one per address family
        .select("ip", "version", "hex", F.explode("plens").alias("plen"))
        .select("ip", "version", "plen", network_key(F.col("hex"), F.col("plen")).alias("key"))
    )


_GEO_FIELDS = ("country", "country_name", "city", "latitude", "longitude")


def geo_layer(geo: DataFrame) -> DataFrame:
    """``geo(network, country, ...)``: geography by CIDR block."""
    place = F.struct(*[column_or_null(geo, f, _geo_type(f)).alias(f) for f in _GEO_FIELDS])
    return network_table(geo, "network").select("version", "plen", "key", place.alias("geo"))


def _geo_type(field: str) -> str:
    return "double" if field in ("latitude", "longitude") else "string"


def asn_layer(prefixes: DataFrame) -> DataFrame:
    """``prefixes(prefix, asn, as_org)``; operators are tagged here, once per prefix."""
    owner = F.struct(
        F.col("asn").cast("bigint").alias("asn"),
        "as_org",
        operator_tags(F.col("as_org")).alias("asn_tags"),
    )
    return network_table(prefixes, "prefix").select("version", "plen", "key", owner.alias("owner"))


def indicator_layer(indicators: DataFrame) -> DataFrame:
    nets = network_table(enabled(indicators).filter(F.col("kind") == "cidr"), "value")
    return nets.select("version", "plen", "key", F.col("source").alias("net"))


def enabled(indicators: DataFrame) -> DataFrame:
    return indicators.filter("enabled") if "enabled" in indicators.columns else indicators


def _geo_columns(match: Column | None, missing: str) -> list[Column]:
    """Geography of public addresses; ``geo_source`` says why there is none."""
    public = F.col("scope") == "public"
    fields = [
        (F.when(public, match[f]) if match is not None else F.lit(None).cast(_geo_type(f))).alias(f)
        for f in _GEO_FIELDS
    ]
    found = match.isNotNull() if match is not None else F.lit(False)
    source = (
        F.when(F.col("scope") == "invalid", "invalid-address")
        .when(~public, F.col("scope"))
        .when(found, "geolite2")
        .otherwise(missing)
    )
    return [*fields, source.alias("geo_source")]


def _asn_columns(match: Column) -> list[Column]:
    inner = F.col("scope").isin("private", "loopback", "link-local")
    outside = ~inner & (F.col("scope") != "invalid")
    kept = lambda f: F.when(outside, match[f])
    source = (
        F.when(F.col("scope") == "invalid", "invalid-address")
        .when(inner, "private")
        .when(match.isNotNull(), "prefix-table")
        .otherwise("unavailable")
    )
    return [
        kept("asn").alias("asn"),
        F.when(has_text(match["as_org"]), kept("as_org")).alias("as_org"),
        source.alias("asn_source"),
        strings_or_empty(kept("asn_tags")).alias("asn_tags"),
    ]


def geo_lookup(addresses: DataFrame, geo: DataFrame | None) -> DataFrame:
    """``ip`` plus geography, or why there is none."""
    if geo is None:
        return addresses.select("ip", *_geo_columns(None, "unavailable"))
    match = longest_prefix_match(addresses, {"geo": geo_layer(geo)})
    return addresses.join(match, "ip", "left").select(
        "ip", *_geo_columns(F.col("geo"), "not-found")
    )


def geo_range_lookup(addresses: DataFrame, ranges: DataFrame) -> DataFrame:
    """Geography of public addresses from ``ranges(lo, hi, ...)``; the narrowest range counts.

    ``lo`` and ``hi`` are IPv4 or IPv6 texts, or IPv4 numbers; a range with ends that are no
    addresses, of two families or in the wrong order is left out. Each range becomes
    its minimal cover by networks (at most 62 or 254), so the lookup is an equality on
    the network and never compares the addresses of one block with all its ranges.
    """
    def edge(name: str) -> Column:
        if ranges.schema[name].dataType.simpleString() == "string":
            return parse_address(F.col(name))
        digits = F.lower(F.lpad(F.hex(F.col(name).cast("bigint")), 8, "0"))
        inside = F.col(name).between(0, (1 << 32) - 1)
        return F.when(inside, F.struct(F.lit(4).alias("version"), digits.alias("hex")))

    rest = [c for c in ranges.columns if c not in ("lo", "hi")]
    cut = (
        ranges.select(F.struct(*rest).alias("match"), edge("lo").alias("a"), edge("hi").alias("b"))
        .filter((F.col("a.version") == F.col("b.version")) & (F.col("a.hex") <= F.col("b.hex")))
        .select("match", range_width("a.hex", "b.hex").alias("width"),
                F.explode(range_cover(F.col("a.version"), F.col("a.hex"), F.col("b.hex"))).alias("net"))
        .select("match", "width", "net.*")
    )
    probes = _probes(addresses.filter(F.col("scope") == "public"), cut)
    found = probes.join(cut, ["version", "plen", "key"]).groupBy("ip").agg(
        F.min_by("match", "width").alias("match"))
    return addresses.select("ip", "scope").join(found, "ip", "left").select(
        "ip", "scope", "match.*"
    )


def operator_tags(as_org: Column) -> Column:
    lowered = F.lower(as_org)
    return F.when(
        has_text(as_org),
        tag_list(*[(contains_any(lowered, words), tag) for tag, words in OPERATOR_WORDS]),
    ).otherwise(empty_strings())


def asn_lookup(addresses: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``ip, asn, as_org, asn_source, asn_tags``."""
    match = longest_prefix_match(addresses, {"owner": asn_layer(prefixes)})
    return addresses.join(match, "ip", "left").select("ip", *_asn_columns(F.col("owner")))


# --------------------------------------------------------------------------- #
# Indicators
# --------------------------------------------------------------------------- #


def exact_lists(indicators: DataFrame) -> DataFrame:
    """``ip, exact``: the sorted lists naming each address (feed-sized sets)."""
    return (
        enabled(indicators)
        .filter(F.col("kind") == "ip")
        .groupBy(F.col("value").alias("ip"))
        .agg(F.array_sort(F.collect_set("source")).alias("exact"))
    )


def _listed(exact: Column, net: Column) -> Column:
    """Struct ``(ti_score, ti_tags)``.

    Every list naming the address adds its score; of the covering networks only
    the most specific counts, and not if its list already matched exactly.
    """
    listed = strings_or_empty(exact)
    adds = net.isNotNull() & ~F.array_contains(listed, net)
    return F.struct(
        (F.size(listed) * SCORE_EXACT_IP + F.when(adds, SCORE_CIDR).otherwise(0.0)).alias(
            "ti_score"
        ),
        F.when(adds, F.concat(listed, F.array(net))).otherwise(listed).alias("ti_tags"),
    )


def indicator_lookup(addresses: DataFrame, indicators: DataFrame) -> DataFrame:
    """``ip, ti_score, ti_tags`` for addresses on any list.

    ``indicators(kind, value, source[, enabled])``, sources already prefixed.
    """
    nets = longest_prefix_match(addresses, {"net": indicator_layer(indicators)})
    return (
        addresses.select("ip")
        .join(nets, "ip", "left")
        .join(exact_lists(indicators), "ip", "left")
        .filter(F.col("net").isNotNull() | F.col("exact").isNotNull())
        .select("ip", _listed(F.col("exact"), F.col("net")).alias("l"))
        .select("ip", "l.*")
    )


def indicator_stats(indicators: DataFrame) -> DataFrame:
    is_ip = F.col("kind") == "ip"
    return indicators.filter(F.col("kind").isin("ip", "cidr")).agg(
        F.count_distinct(F.when(is_ip, F.col("value"))).alias("ip_indicators"),
        F.count_if(~is_ip).alias("cidr_indicators"),
        F.count_distinct("source").alias("sources"),
    )


def add_indicators(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored rows plus incoming ones not stored yet, with the default score."""
    key = ["kind", "value", "source"]
    default = F.when(F.col("kind") == "ip", SCORE_EXACT_IP).otherwise(SCORE_CIDR)
    fresh = (
        incoming.dropDuplicates(key)
        .join(stored.select(*key), key, "left_anti")
        .withColumn("score", default)
        .withColumn("enabled", F.lit(True))
        .withColumn("category", F.coalesce(column_or_null(incoming, "category"), F.lit("generic")))
    )
    return stored.unionByName(fresh.select(*stored.columns))


# --------------------------------------------------------------------------- #
# Text signals
# --------------------------------------------------------------------------- #


def agent_signals(user_agent: Column) -> Column:
    """Struct ``(ti_score, ti_tags)`` of a user agent; nothing for none."""
    short = F.length(user_agent) < 8
    given = has_text(user_agent)

    def signals(text: Column) -> Column:
        malware = [(text.contains(marked_name(n)), t) for n, t in MALWARE_AGENTS]
        scanner = [(text.contains(marked_name(n)), t) for n, t in SCANNER_AGENTS]
        points = lambda pairs, each: sum(
            (F.when(c, each).otherwise(0.0) for c, _ in pairs), F.lit(0.0)
        )
        score = (
            points(malware, SCORE_MALWARE_AGENT)
            + points(scanner, SCORE_SCANNER_AGENT)
            + F.when(short, SCORE_SHORT_AGENT).otherwise(0.0)
        )
        tags = tag_list(*malware, *scanner, (short, "ua:suspiciously-short"))
        return F.struct(
            F.when(given, score).otherwise(0.0).alias("ti_score"),
            F.when(given, tags).otherwise(empty_strings()).alias("ti_tags"),
        )

    return let(marked_words(F.coalesce(user_agent, F.lit(""))), signals)


def username_signals(username: Column) -> Column:
    generic = F.lower(username).isin(*GENERIC_USERNAMES)
    given = has_text(username)
    return F.struct(
        F.when(given & generic, SCORE_GENERIC_USERNAME).otherwise(0.0).alias("ti_score"),
        F.when(
            given,
            F.array(
                F.when(generic, "cred:generic-username").otherwise("cred:specific-username")
            ),
        )
        .otherwise(empty_strings())
        .alias("ti_tags"),
    )


def classify_agents(events: DataFrame) -> DataFrame:
    """``user_agent, agent`` once per distinct text, not per row."""
    return (
        events.select("user_agent")
        .filter(has_text("user_agent"))
        .distinct()
        .withColumn("agent", agent_signals(F.col("user_agent")))
    )


# --------------------------------------------------------------------------- #
# Whole events
# --------------------------------------------------------------------------- #


def enrich_addresses(
    addresses: DataFrame,
    geo: DataFrame | None,
    prefixes: DataFrame,
    indicators: DataFrame,
) -> DataFrame:
    """One row per distinct address with every address-level fact, in one pass."""
    layers = {"owner": asn_layer(prefixes), "net": indicator_layer(indicators)}
    if geo is not None:
        layers["geo"] = geo_layer(geo)
    found = addresses.join(longest_prefix_match(addresses, layers), "ip", "left").join(
        exact_lists(indicators), "ip", "left"
    )
    place = _geo_columns(
        F.col("geo") if geo is not None else None, "unavailable" if geo is None else "not-found"
    )
    return found.select(
        "ip", *place, *_asn_columns(F.col("owner")),
        _listed(F.col("exact"), F.col("net")).alias("listed"),
    )


def enrich_events(
    events: DataFrame,
    geo: DataFrame | None,
    prefixes: DataFrame,
    indicators: DataFrame,
) -> DataFrame:
    """Events with geography, network, ``threat_score`` and ``threat_tags``.

    Left joins keep every event; a source with no address passes unchanged.
    """
    facts = enrich_addresses(distinct_addresses(events), geo, prefixes, indicators)
    added = (*_GEO_FIELDS, "geo_source", "asn", "as_org", "threat_score", "threat_tags")
    own = [c for c in events.columns if c not in added]
    facts = facts.select(
        F.col("ip").alias("src_ip"),
        *_GEO_FIELDS, "geo_source", "asn", "as_org", "asn_tags", "listed",
    )
    out = events.select(*own).join(facts, "src_ip", "left")
    out = join_facts(out, classify_agents(events), "user_agent", has_text("user_agent"), F.col("event_id"))
    user = username_signals(F.col("username"))
    signals = ["listed", "agent", "user"]
    score = sum((F.coalesce(F.col(f"{s}.ti_score"), F.lit(0.0)) for s in signals), F.lit(0.0))
    tags = F.concat(
        F.array_distinct(F.concat(*[strings_or_empty(F.col(f"{s}.ti_tags")) for s in signals])),
        strings_or_empty("asn_tags"),
    )
    known = has_text("src_ip")
    return (
        out.withColumn("user", user)
        .withColumn("threat_score", F.when(known, F.bround(score, 2)).otherwise(0.0))
        .withColumn("threat_tags", F.when(known, tags).otherwise(empty_strings()))
        .drop("listed", "agent", "user", "asn_tags")
    )


def describe_addresses(
    ips: DataFrame, geo: DataFrame | None, prefixes: DataFrame, indicators: DataFrame
) -> DataFrame:
    """On-demand lookup of ``ips(src_ip)``: every fact about each address."""
    facts = enrich_addresses(distinct_addresses(ips), geo, prefixes, indicators)
    return facts.select(
        F.col("ip").alias("src_ip"),
        *_GEO_FIELDS, "geo_source", "asn", "as_org", "asn_source", "asn_tags",
        F.col("listed.ti_score").alias("threat_score"),
        F.col("listed.ti_tags").alias("threat_tags"),
        classify_address(F.col("ip")).alias("_class"),
    ).select("*", "_class.*").drop("_class")
