from __future__ import annotations

import ipaddress
import random
import uuid

from pyspark.sql import functions as F

from sablewatch.functions import net, text
from sablewatch.functions.columns import rounded
from sablewatch.functions.skew import chunked_lag
from sablewatch.operators.search import truncate_headers

ADDRESSES = (
    "1.2.3.4 127.0.0.1 10.1.2.3 169.254.3.4 172.31.0.1 172.32.0.1 192.0.0.9 192.0.0.8 192.0.2.1 "
    "192.168.1.1 198.18.0.1 198.51.100.4 203.0.113.9 224.0.0.1 240.1.1.1 255.255.255.255 0.0.0.0 "
    "100.64.0.1 ::1 :: fe80::1 ff02::1 2001:db8::1 2606:4700::1111 100::1 4000::1 fec0::1 "
    "2001:20::5 2002::1 ::ffff:8.8.8.8 ::ffff:10.0.0.1 1:2:3:4:5:6:7:8 64:ff9b:1::1 "
    "1.2.3 256.1.1.1 01.2.3.4 nonsense 1::2::3 1:2:3:4:5:6:7:8:9 :1:2 12345::"
).split()


def python_scope(value: str) -> str:
    try:
        a = ipaddress.ip_address(value)
    except ValueError:
        return "invalid"
    for name in ("loopback", "private", "link_local", "multicast"):
        if getattr(a, f"is_{name}"):
            return name.replace("_", "-")
    return "reserved" if a.is_reserved or a.is_unspecified else "public"


def test_scopes_agree_with_the_standard_library(spark):
    df = spark.createDataFrame([(a,) for a in ADDRESSES], "ip string")
    got = dict(df.select("ip", net.address_scope(F.col("ip"))).collect())
    assert got == {a: python_scope(a) for a in ADDRESSES}


def test_network_keys_agree_with_the_standard_library(spark):
    rng = random.Random(4)
    cases = [f"{ipaddress.IPv4Address(rng.getrandbits(32))}/{rng.randrange(33)}" for _ in range(60)]
    cases += [f"{ipaddress.IPv6Address(rng.getrandbits(128))}/{rng.randrange(129)}" for _ in range(60)]
    df = spark.createDataFrame([(c,) for c in cases], "n string")
    for value, found in df.select("n", net.parse_network(F.col("n"))).collect():
        block = ipaddress.ip_network(value, strict=False)
        width = -(-block.prefixlen // 4)
        digits = format(int(block.network_address), f"0{block.max_prefixlen // 4}x")[:width]
        assert tuple(found) == (block.version, block.prefixlen, digits), value


def test_bad_networks_are_null(spark):
    df = spark.createDataFrame([(c,) for c in ("1.2.3.4/33", "a/3", "1.2.3.4/8/9", "/8", "")],
                               "n string")
    assert all(r[0] is None for r in df.select(net.parse_network(F.col("n"))).collect())


def test_text_helpers(spark):
    row = spark.range(1).select(
        text.defang(F.lit("see http://a.b http://c")).alias("fang"),
        text.name_uuid(F.lit("198.51.100.7")).alias("uid"),
        text.flexible_timestamp(F.lit("2024-01-01T00:00:00Z")).alias("z"),
        text.flexible_timestamp(F.lit("2024-01-01T02:00:00+02:00")).alias("offset"),
        text.flexible_timestamp(F.lit("1704067200")).alias("epoch"),
        text.flexible_timestamp(F.lit("yesterday")).alias("bad"),
        text.iso_utc(F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("iso"),
    ).first()
    assert row.fang == "see hxxp://a[.]b http://c"
    assert row.uid == str(uuid.uuid5(uuid.NAMESPACE_DNS, "198.51.100.7"))
    assert row.z == row.offset == row.epoch and row.bad is None
    assert row.iso == "2024-01-01T00:00:00+00:00"


def test_chunked_lag_equals_a_plain_lag(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), t, t * 10) for t in rng.sample(range(500), 120)]
    df = spark.createDataFrame(rows, "k string, t bigint, v bigint")
    got = chunked_lag(df, ["k"], ["t"], F.floor(F.col("t") / 7), "v", "p").collect()
    for k in "ab":
        ordered = sorted((r for r in got if r.k == k), key=lambda r: r.t)
        assert [r.p for r in ordered] == [None, *[r.v for r in ordered[:-1]]]


def test_header_truncation(spark):
    df = spark.createDataFrame([({"a" * 80: "v" * 2000, "b": "x"},)], "h map<string,string>")
    assert df.select(truncate_headers(F.col("h"))).first()[0] == {"a" * 64: "v" * 1024, "b": "x"}


def test_rounded_is_round(spark):
    """Ties, their neighbours, negative, large and missing numbers too; decimals stay for those."""
    values = [i / 2_000_000 for i in range(200)] + [1.0000005, 0.2345675, 0.9999995, -0.0000005, 1e20, None, float("nan"), 0.1 + 0.2]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert df.filter(~rounded("x", 6).eqNullSafe(F.round("x", 6))).count() == 0
    assert spark.range(10_000).select((F.col("id") / 9_999).alias("x")).filter(~rounded("x", 6).eqNullSafe(F.round("x", 6))).count() == 0
