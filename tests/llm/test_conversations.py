"""Conversation repair against plain dynamic programming and full enumeration."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import groupby

import pytest

from sablewatch.llm import conversations
from sablewatch.llm.conversations import Span, cheapest, op13_conversation_repair, repair_conversations, row_cell, text_hashes

GRAMMAR = re.compile(r"(s?(ua)+)?\Z")
EMPTY = hashlib.sha256(b"").hexdigest()


def options(role, fault):
    """(letter, cost, initial) of a row's edits."""
    out = [("D", 3, "")]
    if fault not in ("blank", "duplicate"):
        extra = fault == "truncated"
        out += [("K", extra, role[:1] or "?"), ("R", 2 + extra, "u"), ("R", 2 + extra, "a")]
    return out


def enumerate_all(rows):
    """The least (cost, audit) of every edit sequence with at most one insertion beyond need."""
    best = None

    def go(i, cost, audit, roles, inserted):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(rows) and GRAMMAR.match(roles):
            best = min(best or (cost, audit), (cost, audit))
        if inserted < len(rows) + 2:
            for r in "ua":
                go(i, cost + 2, audit + "I", roles + r, inserted + 1)
        if i < len(rows):
            for letter, c, r in options(*rows[i]):
                go(i + 1, cost + c, audit + letter, roles + r, inserted)

    best = 3 * len(rows) + sum(0 for _ in rows), "D" * len(rows)
    go(0, 0, "", "", 0)
    return best


def plain(rows):
    """The same row by row, with the least (cost, audit) per role state, and the roles."""
    steps = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def closed(cells):
        for _ in range(3):
            for state, (c, a, r) in list(cells.items()):
                for role in "ua":
                    to = steps.get((state, role))
                    if to is not None:
                        cells[to] = min(cells.get(to, (10**9,)), (c + 2, a + "I", r + ("+" + role,)))
        return cells

    cells = closed({"": (0, "", ())})
    for i, row in enumerate(rows):
        after = {}
        for state, (c, a, r) in cells.items():
            for letter, extra, role in options(*row):
                to = state if letter == "D" else steps.get((state, role))
                if to is not None:
                    kept = r if letter == "D" else (*r, f"{i}{'' if letter == 'K' else role}")
                    after[to] = min(after.get(to, (10**9,)), (c + extra, a + letter, kept))
        cells = closed(after)
    return min(cells[q] for q in ("", "a") if q in cells)


def brute_force(rows):
    """The report and hash of every conversation of (conv, turn, role, text)."""
    out = {}
    held = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        held[conv].append((turn is not None, turn or 0, role, hashlib.sha256(text.encode()).hexdigest(), text))
    for conv, own in held.items():
        own.sort()
        seen, named = set(), []
        for _, _, role, _, text in own:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            fault = ("blank" if not body else "duplicate" if (role, text) in seen else
                     "truncated" if body[-1] not in ".!?" else None)
            seen.add((role, text))
            named.append((role, fault))
        turns = [t for given, t, *_ in own if given]
        cost, audit, kept = plain(named)
        lines = []
        for k in kept:
            if k[0] == "+":
                lines.append({"u": "user:", "a": "assistant:"}[k[1]])
            else:
                i, role = int(k.rstrip("ua")), k.lstrip("0123456789")
                lines.append(f"{({'u': 'user', 'a': 'assistant'}[role] if role else named[i][0])}:{own[i][4]}")
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(named, named[1:], strict=False)]
        count = lambda f: sum(x == f for _, x in named)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count("blank"), count("duplicate"),
                     count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def repaired(spark, rows, **more):
    schema = "conv_id long, turn long, role string, text string, span int, uid string"
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], schema).repartition(3)
    report, turns = repair_conversations(df, **more)
    hashes = {r.conv_id: r.repaired_sha256 for r in text_hashes(turns).collect()}
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit,
                        hashes.get(r.conv_id, EMPTY)) for r in report.collect()}


def random_rows(rng, conv, n):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "u", "Assistant"]
    texts = ["a.", "b!", "c?", "d", "", " \n", None, "e. \t", "f.é", "日本語。", "g."]
    return [(conv, rng.choice([None, *range(n)]) if rng.random() < 0.3 else k, rng.choice(roles),
             f"{rng.choice(['', k])}{t}" if (t := rng.choice(texts)) and t.strip() else t) for k in range(n)]


def test_cells_equal_enumeration():
    rng = random.Random(4)
    for _ in range(250):
        rows = [(rng.choice(["system", "user", "assistant", "tool"]), rng.choice([None, None, "blank", "truncated"]))
                for _ in range(rng.randint(0, 4))]
        span = Span()
        for role, fault in rows:
            span.add(row_cell(role[:1], {None: 0, "blank": 1, "truncated": 2}[fault]))
        got = cheapest(span.cell()) if rows else (0, "")
        assert got == enumerate_all(rows) == plain(rows)[:2], rows


@pytest.mark.parametrize(("span", "fan"), [(256, 64), (3, 2)])
def test_repair_equals_brute_force(spark, monkeypatch, span, fan):
    monkeypatch.setattr(conversations, "SPAN", span)
    monkeypatch.setattr(conversations, "FAN", fan)
    rng = random.Random(span)
    rows = [r for conv in [None, *range(60)] for r in random_rows(rng, conv, rng.choice([1, 2, 3, 5, 9, 14]))]
    rows += random_rows(rng, 99, 400)  # a hot conversation
    rows += [(98, 3, "user", "same.")] * 90 + [(97, None, None, None)] * 40
    assert repaired(spark, rows) == brute_force(rows)


def test_empty_and_long(spark):
    assert repaired(spark, []) == {}
    rows = [(1, 0, "user", "x" * 300_000 + "."), (1, 2**62, "assistant", "y " * 200_000 + "!"), (2, -(2**63), "user", "a."), (2, 2**63 - 1, "user", "b.")]
    got = repaired(spark, rows)
    want = brute_force(rows)
    assert got[1] == want[1] and got[2][0] is None and got[2][1:] == want[2][1:]


def damaged(rows):
    for r in rows:
        role, text = (" " if x is None else x for x in (r.role, r.text))
        name = f"{' ' if r.conv_id is None else r.conv_id}:{' ' if r.turn is None else r.turn}"
        kind = zlib.crc32(name.encode()) % 20
        if kind:
            role = "user" if kind == 4 else role
            text = "" if kind == 1 else re.sub(r"[.!?]", "", text) if kind == 2 else text
            yield from [(r.conv_id, r.turn, role, text)] * (2 if kind == 3 else 1)


def test_query_equals_brute_force(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").collect()
    extra = [(None, None, None, None), (None, 3, "user", None), (500_001, None, "system", "x."), (500_002, 1, None, "a b.")]
    df = spark.createDataFrame([tuple(r) for r in rows] + extra, "conv_id long, turn long, role string, text string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    rows = df.collect()
    want = brute_force(list(damaged(rows)))
    got = {r.conv_id: tuple(r)[1:] for r in op13_conversation_repair(spark, str(tmp_path)).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}
    assert set(got) == {r.conv_id for r in rows}
    for conv, own in got.items():
        assert own == want.get(conv, (0, 0, 0, 0, 0, 0, "", EMPTY)), conv
