"""Internet addresses as Columns: parsing, scopes, prefix keys.

An address becomes a struct ``(version, hex)``: 8 hex digits for IPv4, 32 for
IPv6. Every prefix test then is a string-prefix test, and a longest-prefix
lookup is an equi-join on ``(version, length, key)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_V4 = rf"^{_OCTET}(\.{_OCTET}){{3}}$"
_V6_TAIL = rf"^(.*:){_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    Plain Column reuse copies the whole expression at each use, which for the
    nested parsing below grows the plan exponentially.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _hex2(value: Column) -> Column:
    return F.lpad(F.hex(value.cast("bigint")), 2, "0")


def _v4_hex(ip: Column) -> Column:
    octets = F.transform(F.split(ip, r"\."), lambda o: _hex2(o))
    return F.when(ip.rlike(_V4), F.lower(F.array_join(octets, "")))


def _v6_hex(ip: Column) -> Column:
    # A dotted tail (::ffff:192.0.2.1) counts as the last two groups.
    tail = lambda n: F.regexp_extract(ip, _V6_TAIL, n)
    dotted = F.concat(
        tail(1), _hex2(tail(2)), _hex2(tail(3)), F.lit(":"), _hex2(tail(4)), _hex2(tail(5))
    )
    text = F.lower(F.when(ip.rlike(_V6_TAIL), dotted).otherwise(ip))
    return let(text, _v6_groups)


def _v6_groups(text: Column) -> Column:
    """Expand ``::`` and pad every group; null unless eight valid groups result."""

    def groups(part: Column) -> Column:
        return F.filter(F.split(part, ":"), lambda g: g != "")

    def expand(halves: Column) -> Column:
        known = F.struct(
            groups(F.get(halves, F.lit(0))).alias("left"),
            groups(F.coalesce(F.get(halves, F.lit(1)), F.lit(""))).alias("right"),
        )
        return let(known, fill)

    def fill(known: Column) -> Column:
        gap = 8 - F.size(known["left"]) - F.size(known["right"])
        zeros = F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0)))
        return F.when(gap >= 1, F.concat(known["left"], zeros, known["right"]))

    parts = F.when(text.contains("::"), let(F.split(text, "::"), expand)).otherwise(
        F.split(text, ":")
    )
    well_formed = ~text.rlike(r":::|::.*::|^:[^:]|[^:]:$")
    return let(
        F.when(well_formed, parts),
        lambda p: F.when(
            (F.size(p) == 8) & F.forall(p, lambda g: g.rlike("^[0-9a-f]{1,4}$")),
            F.array_join(F.transform(p, lambda g: F.lpad(g, 4, "0")), ""),
        ),
    )


def parse_address(ip: Column) -> Column:
    """Struct ``(version int, hex string)``; null when not an address."""
    return let(ip, _parse_text)


def _parse_text(ip: Column) -> Column:
    v4 = F.when(ip.rlike(_V4), F.struct(F.lit(4).alias("version"), _v4_hex(ip).alias("hex")))
    v6 = let(
        _v6_hex(ip),
        lambda h: F.when(h.isNotNull(), F.struct(F.lit(6).alias("version"), h.alias("hex"))),
    )
    return F.when(ip.contains(":"), v6).otherwise(v4)


def network_key(address_hex: Column, plen: Column) -> Column:
    """The first ``plen`` bits as text: whole nibbles plus one masked nibble."""
    nibbles = F.floor(plen / 4).cast("int")
    spare = (plen % 4).cast("int")
    last = F.conv(F.substring(address_hex, nibbles + 1, F.lit(1)), 16, 10).cast("int")
    # 4 - spare low bits of the cut nibble are not part of the network.
    drop = F.element_at(F.array(F.lit(16), F.lit(8), F.lit(4), F.lit(2)), spare + 1)
    masked = F.lower(F.hex((last - last % drop).cast("bigint")))
    return F.concat(
        F.substring(address_hex, F.lit(1), nibbles), F.when(spare > 0, masked).otherwise("")
    )


def parse_network(value: Column) -> Column:
    """Struct ``(version, plen, key)`` of a CIDR or bare address; host bits allowed."""
    return let(value, _parse_block)


def _parse_block(value: Column) -> Column:
    given = F.when(value.contains("/"), F.trim(F.substring_index(value, "/", -1)))
    address = parse_address(F.trim(F.substring_index(value, "/", 1)))

    def build(a: Column) -> Column:
        bits = F.when(a["version"] == 4, 32).otherwise(128)
        plen = F.when(given.isNull(), bits).when(given.rlike(r"^\d{1,3}$"), given.cast("int"))
        net = F.struct(
            a["version"].alias("version"),
            plen.alias("plen"),
            network_key(a["hex"], plen).alias("key"),
        )
        one_slash = ~value.rlike("/.*/")
        return F.when(a.isNotNull() & one_slash & plen.between(F.lit(0), bits), net)

    return let(address, build)


def _bits(address_hex: Column) -> Column:
    """An address as text of 0 and 1."""
    digit = lambda i: F.lpad(F.conv(F.substring(address_hex, i, F.lit(1)), 16, 2), 4, "0")
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(address_hex)), digit), "")


def _hex_of(bits: Column) -> Column:
    nibble = lambda i: F.lower(F.conv(F.substring(bits, i * 4 + 1, F.lit(4)), 2, 16))
    last = (F.length(bits) / 4).cast("int") - 1
    return F.array_join(F.transform(F.sequence(F.lit(0), last), nibble), "")


def range_cover(version: Column, lo: Column, hi: Column) -> Column:
    """The fewest networks that make up ``lo`` to ``hi`` (hex): structs ``(version, plen, key)``.

    Of the addresses just outside the range, written as bits behind ``01``, the lower one's
    zeros and the upper one's ones below their first difference each give a network:
    the bits before it, and the bit turned round.
    """
    total = F.length(lo) * 4 + 2

    def below(text: Column) -> Column:
        return let(F.rtrim(text, F.lit("0")), lambda p: F.concat(
            F.substring(p, F.lit(1), F.length(p) - 1), F.lit("0"), F.repeat(F.lit("1"), total - F.length(p))))

    def above(text: Column) -> Column:
        return let(F.rtrim(text, F.lit("1")), lambda p: F.concat(
            F.substring(p, F.lit(1), F.length(p) - 1), F.lit("1"), F.repeat(F.lit("0"), total - F.length(p))))

    def at(text: Column, i: Column) -> Column:
        return F.substring(text, i, F.lit(1))

    def networks(edge: Column) -> Column:
        low, high, split = edge["low"], edge["high"], edge["split"]
        behind = F.filter(F.sequence(F.lit(1), total), lambda i: i > split)

        def turned(text: Column, bit: str, other: str) -> Column:
            return F.transform(
                F.filter(behind, lambda i: at(text, i) == bit),
                lambda i: network((i - 2).cast("int"), F.concat(F.substring(text, F.lit(3), i - 3), F.lit(other))))

        return F.concat(turned(low, "0", "1"), turned(high, "1", "0"))

    def network(plen: Column, prefix: Column) -> Column:
        whole = F.when(plen > 0, F.substring(prefix, F.lit(1), plen)).otherwise("")
        return F.struct(version.alias("version"), plen.alias("plen"),
                        network_key(_hex_of(F.rpad(whole, total - 2, F.lit("0"))), plen).alias("key"))

    ends = F.struct(below(F.concat(F.lit("01"), _bits(lo))).alias("low"), above(F.concat(F.lit("01"), _bits(hi))).alias("high"))
    return let(
        let(ends, lambda e: F.struct(
            e["low"].alias("low"), e["high"].alias("high"),
            F.array_min(F.filter(F.sequence(F.lit(1), total), lambda i: at(e["low"], i) != at(e["high"], i))).alias("split"))),
        networks)


def range_width(lo: str, hi: str) -> Column:
    """``hi - lo`` of two hex addresses as a struct that sorts like the number."""
    half = lambda c, i: F.conv(F.substring(F.lpad(F.col(c), 32, "0"), i, 16), 16, 10).cast("decimal(20,0)")
    low = half(hi, 17) - half(lo, 17)
    borrow = (low < 0).cast("int").cast("decimal(20,0)")
    whole = F.lit(str(1 << 64)).cast("decimal(20,0)")
    return F.struct((half(hi, 1) - half(lo, 1) - borrow).alias("high"), (low + borrow * whole).alias("low"))


def ipv4_long(ip: Column) -> Column:
    return F.conv(_v4_hex(ip), 16, 10).cast("bigint")


# --- fixed values: special-purpose address blocks ---------------------------
_V4_PRIVATE = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
    "192.0.0.0/24", "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15",
    "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4", "255.255.255.255/32",
)
_V4_PRIVATE_EXCEPT = ("192.0.0.9/32", "192.0.0.10/32")
_V6_PRIVATE = (
    "::1/128", "::/128", "64:ff9b:1::/48", "100::/64", "2001::/23",
    "2001:db8::/32", "2002::/16", "3fff::/20", "fc00::/7", "fe80::/10",
)
_V6_PRIVATE_EXCEPT = (
    "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28",
    "2001:30::/28",
)
_V6_MULTICAST = ("ff00::/8",)
_V6_ASSIGNED = ("2000::/3", "fc00::/7", "fe80::/10", "fec0::/10", "ff00::/8")
_V4_MAPPED = "00000000000000000000ffff"


def _inside(address_hex: Column, blocks: tuple[str, ...], version: int) -> Column:
    """Is the address in one of these fixed blocks? Folded to string prefixes."""
    import ipaddress

    bits = 32 if version == 4 else 128
    cond = F.lit(False)
    for block in blocks:
        net = ipaddress.ip_network(block)
        lo = format(int(net.network_address), f"0{bits // 4}x")
        hi = format(int(net.broadcast_address), f"0{bits // 4}x")
        cond = cond | address_hex.between(lo, hi)
    return cond


def _v4_scope(v4: Column) -> Column:
    return (
        F.when(_inside(v4, ("127.0.0.0/8",), 4), "loopback")
        .when(_inside(v4, _V4_PRIVATE, 4) & ~_inside(v4, _V4_PRIVATE_EXCEPT, 4), "private")
        .when(_inside(v4, ("169.254.0.0/16",), 4), "link-local")
        .when(_inside(v4, ("224.0.0.0/4",), 4), "multicast")
        .when(_inside(v4, ("240.0.0.0/4",), 4), "reserved")
        .otherwise("public")
    )


def _v6_scope(v6: Column) -> Column:
    return (
        F.when(_inside(v6, ("::1/128",), 6), "loopback")
        .when(_inside(v6, _V6_PRIVATE, 6) & ~_inside(v6, _V6_PRIVATE_EXCEPT, 6), "private")
        .when(_inside(v6, ("fe80::/10",), 6), "link-local")
        .when(_inside(v6, _V6_MULTICAST, 6), "multicast")
        .when(~_inside(v6, _V6_ASSIGNED, 6), "reserved")
        .otherwise("public")
    )


def scope_of(address: Column) -> Column:
    """Scope of a parsed address; first match wins, null is invalid."""

    def name(a: Column) -> Column:
        mapped = (a["version"] == 6) & a["hex"].startswith(_V4_MAPPED)
        v4 = F.substring(a["hex"], 25, 8)
        return (
            F.when(a.isNull(), "invalid")
            # A public IPv4-mapped address still lies in reserved IPv6 space.
            .when(mapped, let(v4, lambda h: F.replace(_v4_scope(h), F.lit("public"), F.lit("reserved"))))
            .when(a["version"] == 4, _v4_scope(a["hex"]))
            .otherwise(_v6_scope(a["hex"]))
        )

    return let(address, name)


def address_scope(ip: Column) -> Column:
    """loopback, private, link-local, multicast, reserved, public or invalid."""
    return scope_of(parse_address(ip))


def classify_address(ip: Column) -> Column:
    """Struct ``(valid, version, scope, is_bogon)``."""

    def facts(a: Column) -> Column:
        return let(
            scope_of(a),
            lambda scope: F.struct(
                a.isNotNull().alias("valid"),
                a["version"].alias("version"),
                scope.alias("scope"),
                F.when(a.isNotNull(), scope != "public").alias("is_bogon"),
            ),
        )

    return let(parse_address(ip), facts)
