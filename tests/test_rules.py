from __future__ import annotations

import datetime as dt
import random

import pytest

from sablewatch.operators.alerts import merge_alerts, new_alerts
from sablewatch.operators.rules import condition, evaluate_rules, fired_spans
from sablewatch.plans.rule_catalog import SHIPPED_RULES, Rule, RuleError, rules_from_records

START = dt.datetime(2024, 1, 1)


def at(minutes: float) -> dt.datetime:
    return START + dt.timedelta(minutes=minutes)


def brute_peak(rows, window, field):
    best, when = 0, None
    for right in sorted(rows, key=lambda r: r["ts"]):
        inside = [r for r in rows if right["ts"] - window <= r["ts"] <= right["ts"]]
        n = len(inside) if field is None else len({r[field] for r in inside} - {None})
        if n > best:
            best, when = n, right["ts"]
    return best, when


def test_peaks_equal_brute_force(spark, make_events):
    rng = random.Random(3)
    rows = [
        {
            "ts": START + dt.timedelta(seconds=rng.choice([rng.randrange(36000), rng.randrange(60) * 600])),
            "src_ip": f"k{rng.randrange(5)}",
            "username": rng.choice(["a", "b", "c", "d", "e", None, ""]),
        }
        for _ in range(700)
    ]
    rules = [
        Rule("n", "n", "high", "threshold", window_minutes=20, threshold=2),
        Rule("d", "d", "high", "distinct", window_minutes=7, threshold=2, distinct_field="username"),
    ]
    got = {(r.rule_id, r.evidence.group_value): r
           for r in evaluate_rules(make_events(rows), rules).collect()}
    for key in {r["src_ip"] for r in rows}:
        mine = [r for r in rows if r["src_ip"] == key]
        for rule in rules:
            window = dt.timedelta(minutes=rule.window_minutes)
            best, when = brute_peak(mine, window, rule.distinct_field)
            alert = got[rule.id, key]
            assert (alert.evidence.observed, alert.last_seen) == (best, when)
            assert alert.hit_count == sum(when - window <= r["ts"] <= when for r in mine)


def test_window_is_closed_and_empty_string_is_a_key(make_events):
    rule = Rule("r", "r", "low", "threshold", window_minutes=10, threshold=2, group_by="password")
    rows = [{"ts": at(0), "password": ""}, {"ts": at(10), "password": ""},
            {"ts": at(0), "password": "x"}, {"ts": at(10.001), "password": "x"},
            {"ts": at(0), "password": None}, {"ts": at(1), "password": None}]
    assert [r.key for r in fired_spans(make_events(rows), [rule]).collect()] == [""]


def test_ratio_ignores_the_window(make_events):
    rule = Rule("r", "r", "low", "ratio", window_minutes=1, threshold=0.5,
                numerator_where={"event_type": "command"})
    rows = [{"ts": at(i * 60), "event_type": t} for i, t in
            enumerate(["command", "command", "connect"])]
    row = fired_spans(make_events(rows), [rule]).first()
    assert row.observed == pytest.approx(0.6667)


def test_conditions(make_events):
    df = make_events([{"username": None, "command": "CAT /etc/shadow", "tags": ["x"],
                       "threat_score": 40.0}])
    holds = {
        "eq": {"service": "ssh"}, "null": {"username": None}, "member": {"service": ["a", "ssh"]},
        "contains": {"command__contains": "/ETC/shadow"}, "tag": {"tags__in_tags": "x"},
        "gte": {"threat_score__gte": 40}, "lte": {"threat_score__lte": 40},
        "isnull": {"username__isnull": True}, "missing": {"no_such_column": None},
    }
    fails = {"gte_null": {"latitude__gte": 0}, "tag_on_text": {"service__in_tags": "ssh"},
             "other": {"service": "http"}}
    row = df.select(*[condition(df, w).alias(n) for n, w in {**holds, **fails}.items()]).first()
    assert all(row[n] for n in holds) and not any(row[n] for n in fails)
    with pytest.raises(RuleError):
        condition(df, {"service__like": "x"})


def test_a_broken_rule_does_not_stop_the_others(make_events):
    bad = Rule("bad", "bad", "low", "match", where={"service__nope": 1})
    good = Rule("good", "good", "low", "match", where={"service": "ssh"})
    assert [r.rule_id for r in evaluate_rules(make_events([{}]), [bad, good]).collect()] == ["good"]


def test_rule_validation():
    base = {"id": "a", "name": "a", "severity": "low", "type": "match"}
    for change in ({"type": "x"}, {"severity": "x"}, {"type": "distinct"}, {"type": "ratio"},
                   {"window_minutes": 0}, {"colour": 1}):
        with pytest.raises(RuleError):
            rules_from_records([{**base, **change}])
    with pytest.raises(RuleError):
        rules_from_records([base, base])
    assert len(SHIPPED_RULES) == 28 and all(r.enabled for r in SHIPPED_RULES)


def test_merge_is_idempotent_and_keeps_triage(make_events):
    rule = Rule("m", "m", "low", "match", where={"service": "ssh"})
    one = evaluate_rules(make_events([{"ts": at(5)}, {"ts": at(6)}]), [rule])
    from pyspark.sql import functions as F

    stored = one.withColumn("status", F.lit("resolved")).withColumn("notes", F.lit("mine"))
    later = evaluate_rules(make_events([{"ts": at(9)}]), [rule])
    merged = merge_alerts(stored, later)
    row = merged.first()
    assert (row.hit_count, row.first_seen, row.last_seen) == (2, at(5), at(9))
    assert (row.status, row.notes) == ("resolved", "mine")
    assert merge_alerts(merged, later).collect() == merged.collect()
    assert new_alerts(stored, later).count() == 0


def test_evidence_is_bounded(make_events):
    rule = Rule("m", "m", "low", "match", where={"service": "ssh"})
    rows = [{"ts": at(i), "path": f"/{i:03d}", "command": f"c{i:03d}"} for i in range(60)]
    e = evaluate_rules(make_events(rows), [rule]).first().evidence
    assert e.matching_events == 60 and len(e.sample_event_ids) == 5
    assert e.commands == [f"c{i:03d}" for i in range(10)]
    assert e.paths_sample == [f"/{i:03d}" for i in range(25)]


def test_a_flood_inside_one_window_is_spread(spark):
    """A third of the rows from one source within seconds; a hot value all the time."""
    from pyspark.sql import functions as F

    from sablewatch.operators import rules as R

    n = 30_000
    flood = spark.range(n).selectExpr(
        "concat('e', id) AS event_id", "timestamp_micros(1704067200000000 + id * 97) AS ts", "'a' AS src_ip", "'x' AS username")
    rest = spark.range(2 * n).selectExpr(
        "concat('f', id) AS event_id", "timestamp_micros(1704067200000000 + id * 1000000) AS ts",
        "concat('s', id % 50) AS src_ip", "if(id % 3 = 0, 'x', concat('u', id % 7)) AS username")
    events = flood.unionByName(rest)
    rules = [Rule("n", "n", "high", "threshold", window_minutes=5, threshold=6),
             Rule("d", "d", "high", "distinct", window_minutes=60, threshold=2, distinct_field="username"),
             Rule("m", "m", "low", "match"), Rule("r", "r", "low", "ratio", threshold=0.3, numerator_where={"username": "x"})]
    cells = R.rule_cells(events, rules)
    steps = R._count_steps(cells).filter("key = 'a'").withColumn("b", F.floor(F.col("at") / F.col("w")))
    leaf = F.floor((F.col("at") - F.col("b") * F.col("w")) / F.greatest(F.floor(F.col("w") / 2**20), F.lit(1)))
    assert steps.groupBy("b", leaf).count().agg(F.max("count")).first()[0] < 2 * n / 16
    got = {(r.rule_id, r.key): r for r in fired_spans(events, rules).collect()}
    assert got["n", "a"].observed == n and got["m", "a"].observed == n and got["r", "a"].observed == 1.0
    assert got["n", "a"].span_hi == 1704067200000000 + (n - 1) * 97
    assert got["n", "s0"].observed == 7  # every 50 seconds, closed window of 300
    assert got["d", "s1"].observed == len({"x" if i % 3 == 0 else f"u{i % 7}" for i in range(1, 3600, 50)})


def test_tasks_follow_events_and_steps(spark, make_events, monkeypatch):
    """Many events and steps are dealt to more tasks, and the folds keep one sort order."""
    from pyspark.sql import functions as F

    from sablewatch.operators import rules as R

    rows = [{"src_ip": f"198.51.100.{i % 7}", "ts": START + dt.timedelta(minutes=i), "service": f"v{i % 4}"}
            for i in range(90)]
    rules = [Rule("n", "n", "low", "threshold", window_minutes=30, threshold=2),
             Rule("d", "d", "low", "distinct", window_minutes=30, threshold=2, distinct_field="service")]
    events = make_events(rows)
    span = lambda df: sorted(map(tuple, df.collect()))
    want = span(fired_spans(events, rules))
    monkeypatch.setattr(R, "TASK_EVENTS", 5)
    monkeypatch.setattr(R, "TASK_STEPS", 10)
    assert R._dealt(events).rdd.getNumPartitions() == 18
    assert want and span(fired_spans(events, rules)) == want
    steps = R._count_steps(R.rule_cells(events, rules))
    peaks = R._peaks(steps, F.lit(2.0), 9)
    folded = peaks._jdf.queryExecution().executedPlan().toString().partition("SortMergeJoin")[0].partition("BroadcastHashJoin")[0]
    assert folded.count("Sort [") <= 3


def test_evidence_is_dealt_to_tasks_by_the_number_of_events(spark, make_events, monkeypatch):
    from sablewatch.operators import rules as R

    name, inside, assemble = "spark.sql.shuffle.partitions", [], R._assemble

    def watched(*args):
        inside.append(int(spark.conf.get(name)))
        return assemble(*args)

    monkeypatch.setattr(R, "_assemble", watched)
    monkeypatch.setattr(R, "TASK_EVENTS", 4)
    usual = spark.conf.get(name)
    rule = R.Rule("r", "r", "low", "match", where={"service": "ssh"})
    alerts = R.evaluate_rules(make_events([{"src_ip": f"192.0.2.{i % 5}"} for i in range(40)]), [rule])
    assert inside == [40] and spark.conf.get(name) == usual
    assert sorted((r.src_ip, r.hit_count) for r in alerts.collect()) == [(f"192.0.2.{i}", 8) for i in range(5)]


def test_a_task_of_the_evidence_reads_a_bounded_amount(spark, make_events, monkeypatch):
    """Inside, scans and joined shuffle partitions are bounded; the session's own settings come back."""
    from sablewatch.operators import rules as R
    from sablewatch.session import TASK_BYTES

    names = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes",
             "spark.sql.shuffle.partitions")
    usual, seen, stored = [spark.conf.get(n) for n in names], [], []
    monkeypatch.setattr(R, "cut_lineage", lambda df, cut=R.cut_lineage: (
        seen.append([spark.conf.get(n) for n in names[:2]]), stored.append(df.columns), cut(df))[-1])
    rule = Rule("n", "n", "high", "threshold", window_minutes=20, threshold=2)
    alerts = R.evaluate_rules(make_events([{"ts": at(i)} for i in range(3)]), [rule]).collect()
    assert [a.hit_count for a in alerts] == [3]
    assert all(s == [str(TASK_BYTES)] * 2 for s in seen)
    assert any("session_id" in c and "span_lo" not in c and "evidence" not in c for c in stored)  # members, once
    assert [spark.conf.get(n) for n in names] == usual
