from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from sablewatch.operators import exports as X
from sablewatch.operators.scoring import rebuild_sources, refresh_sources
from sablewatch.plans.rule_catalog import Rule
from sablewatch.schemas import EVENT
from sablewatch.sources import dimensions as D
from sablewatch.sources import logs as L
from sablewatch.sources import sinks
from sablewatch.streaming import ingest as I
from sablewatch.streaming import live
from sablewatch.streaming.state import EventStore, StateTable

START = dt.datetime(2024, 1, 1)


def put(folder, name, text):
    folder.mkdir(exist_ok=True)
    path = folder / name
    path.write_text(text)
    return str(path)


def test_jsonl(spark, tmp_path):
    lines = [
        json.dumps({"event_id": "a", "ts": "2024-01-01T00:00:00Z", "service": "ssh", "odd": 1,
                    "tags": ["t"], "extra": {"x": "y"}}),
        json.dumps({"ts": 1704067200, "service": "ftp"}),
        json.dumps({"event_id": "c", "ts": "never"}),
        '{"event_id": "torn',
        "",
    ]
    path = put(tmp_path / "in", "day.jsonl", "\n".join(lines))
    rows = {r.service: r for r in L.read_events_jsonl(spark, path, sensor="s9",
                                                      fold_unknown=True).collect()}
    assert set(rows) == {"ssh", "ftp"}
    assert rows["ssh"].extra == {"x": "y", "odd": "1", "imported_from": "day.jsonl"}
    assert rows["ssh"].ts == rows["ftp"].ts == START and rows["ftp"].sensor == "s9"
    assert rows["ftp"].event_id and rows["ftp"].severity == "info"


def test_events_round_trip_through_json_lines(spark, make_events, tmp_path):
    events = make_events([{"username": "u", "command": 'say "hi"', "tags": ["a", "b"]}, {}])
    sinks.write_text(X.event_json_rows(events), str(tmp_path / "out"))
    back = L.read_events_jsonl(spark, str(tmp_path / "out"))
    keys = [c for c in events.columns if c != "extra"]
    assert back.select(*keys).orderBy("event_id").collect() == events.select(*keys).orderBy(
        "event_id").collect()


def test_cowrie_and_auth_log(spark, tmp_path):
    cowrie = [
        {"eventid": "cowrie.login.failed", "timestamp": "2024-01-01T00:00:00Z", "session": "s",
         "src_ip": "1.2.3.4", "username": "root", "password": "x"},
        {"eventid": "cowrie.command.input", "timestamp": "2024-01-01T00:00:01Z",
         "input": "busybox wget http://x", "protocol": "telnet", "src_port": "99"},
        {"eventid": "cowrie.log.closed", "timestamp": "2024-01-01T00:00:01Z"},
    ]
    path = put(tmp_path / "c", "c.json", "\n".join(map(json.dumps, cowrie)) + "\n{bad")
    rows = {r.event_type: r for r in L.read_cowrie(spark, path, "s1").collect()}
    assert set(rows) == {"auth_attempt", "command"}
    assert rows["command"].tags == ["cowrie:input", "payload-fetch", "mirai-signature"]
    assert (rows["command"].src_ip, rows["command"].src_port) == ("0.0.0.0", 99)
    assert rows["auth_attempt"].service == "ssh" and rows["command"].service == "telnet"
    auth = [
        "Jan  5 01:02:03 h sshd[1]: Failed password for invalid user bob from 9.9.9.9 port 22 ssh2",
        "Dec 30 01:02:03 h sshd[1]: Accepted publickey for al from 9.9.9.9 port 23 ssh2",
        "Jan  5 01:02:04 h sshd[1]: Invalid user eve from 8.8.8.8",
        "Xxx 99 01:02:04 h sshd[1]: Invalid user eve from 8.8.8.8",
        "Jan  5 01:02:04 h sshd[1]: Connection closed",
    ]
    path = put(tmp_path / "a", "auth.log", "\n".join(auth))
    rows = L.read_auth_log(spark, path, "s", year=2024,
                           as_of=F.lit("2024-02-01").cast("timestamp")).collect()
    got = {(r.username, r.event_type, r.ts.year, r.src_port) for r in rows}
    assert got == {("bob", "auth_attempt", 2024, 22), ("al", "auth_success", 2023, 23),
                   ("eve", "auth_attempt", 2024, None)}
    assert len({r.session_id for r in rows if r.src_ip == "9.9.9.9"}) == 1


def test_dimensions(spark, tmp_path):
    put(tmp_path / "i", "alpha.txt", "1.2.3.4 # bad\n10.0.0.0/8\nnonsense\n\n2001:db8::/32\n")
    rows = {(r.kind, r.value, r.source) for r in
            D.read_indicators(spark, str(tmp_path / "i")).collect()}
    assert rows == {("ip", "1.2.3.4", "ti:alpha"), ("cidr", "10.0.0.0/8", "ti:alpha"),
                    ("cidr", "2001:db8::/32", "ti:alpha")}
    path = put(tmp_path / "p", "p.tsv", "# c\n1.2.3.4/16\tAS65\tOrg One\n5.0.0.0/8  66  Two\nx\t1\n")
    rows = {(r.prefix, r.asn, r.as_org) for r in D.read_prefixes(spark, path).collect()}
    assert rows == {("1.2.3.4/16", 65, "Org One"), ("5.0.0.0/8", 66, "Two")}


def test_event_table_prunes_by_day(spark, make_events, tmp_path):
    rows = [{"ts": START + dt.timedelta(days=i)} for i in range(3)]
    sinks.write_events(make_events(rows), str(tmp_path / "t"))
    one = sinks.read_events(spark, str(tmp_path / "t")).filter("day = date'2024-01-02'")
    assert one.count() == 1
    assert "PartitionFilters: [isnotnull(day" in one._jdf.queryExecution().toString()


def source_fixture(make_events, **over):
    return make_events([{"country": "DE", "country_name": "Germany", "asn": 5, **over}, {**over}])


def test_refresh_keeps_known_geography(spark, make_events):
    as_of = F.lit("2024-01-02").cast("timestamp")
    stored = rebuild_sources(source_fixture(make_events), as_of)
    rebuilt = rebuild_sources(make_events([{}, {}, {}]), as_of)
    row = refresh_sources(stored, rebuilt).first()
    assert (row.country, row.asn, row.event_count) == ("DE", 5, 3)


def test_stix_and_blocklist(spark, make_events):
    sources = rebuild_sources(source_fixture(make_events), F.lit("2024-01-02").cast("timestamp"))
    row = X.stix_indicators(sources).first()
    assert row.pattern == "[ipv4-addr:value = '192.0.2.10']" and row.labels[-1]
    text = X.blocklist_rows(sources).first().value
    assert text.startswith("# score=") and text.endswith("\n192.0.2.10")
    bundle = X.stix_objects(sources, "s", F.lit("2024-01-02").cast("timestamp")).collect()
    assert {json.loads(r.value)["type"] for r in bundle} == {"identity", "indicator"}


def test_whole_export_files_parse(spark, make_events):
    as_of = F.lit("2024-01-02").cast("timestamp")
    sources = rebuild_sources(make_events([{"src_ip": f"192.0.2.{i}"} for i in (1, 2, 3)]), as_of)

    def text(lines):
        return "".join(r.value for r in lines.orderBy("part").collect())

    for n, some in ((3, sources), (0, sources.filter("false"))):
        bundle = json.loads(text(X.stix_bundle(some, "s", as_of)))
        assert bundle["type"] == "bundle" and len(bundle["objects"]) == n + 1
        event = json.loads(text(X.misp_event(some, "s", as_of)))["Event"]
        assert event["date"] == "2024-01-02" and len(event["Attribute"]) == n
        lines = X.blocklist_file(some, as_of).orderBy("part").collect()
        assert len(lines) == n + 1 and f"# {n} addresses" in lines[0].value


def test_facts_are_joined_only_where_asked(spark):
    from sablewatch.functions.skew import join_facts

    rows = spark.createDataFrame([("1", "a", True), ("a", None, True), ("3", "a", False), ("4", "b", None)],
                                 "event_id string, k string, ok boolean")
    facts = spark.createDataFrame([("a", 7)], "k string, fact int")
    found = join_facts(rows, facts, "k", F.col("ok"), F.col("event_id"))
    assert {r.event_id: r.fact for r in found.collect()} == {"1": 7, "a": None, "3": None, "4": None}
    assert found.columns == ["event_id", "k", "ok", "fact"]


def test_ingest_detect_and_sessions_from_files(spark, tmp_path):
    """Three arrivals: one event repeated, one two days late, one line torn; a batch run twice."""
    from sablewatch.operators.enrichment import enrich_events

    prefixes = spark.createDataFrame([("45.0.0.0/8", 64500, "Hetzner")],
                                     "prefix string, asn bigint, as_org string")
    lists = spark.createDataFrame([("ip", "45.1.1.1", "ti:a")],
                                  "kind string, value string, source string")
    rules = [Rule("hit", "hit", "high", "threshold", window_minutes=10, threshold=3)]
    as_of = F.lit("2024-01-04").cast("timestamp")
    store = EventStore(spark, str(tmp_path / "events"), EVENT)
    alerts = live.LiveAlerts(spark, str(tmp_path / "alerts"), store, rules)
    sessions = live.LiveSessions(spark, str(tmp_path / "sess"))
    sources = live.LiveSources(spark, str(tmp_path / "src"), as_of)
    counts = live.LiveCounts(spark, str(tmp_path / "n"))
    steps = [x.step for x in (counts, sessions, sources, alerts)]

    def arrive(name, rows, torn=""):
        put(tmp_path / "in", name, "\n".join(json.dumps({
            "event_id": i, "ts": f"2024-01-{ts}:00Z", "src_ip": ip, "service": "ssh", "src_port": n,
            "event_type": "auth_attempt", "session_id": f"s{ip}", "username": "root"})
            for n, (i, ts, ip) in enumerate(rows)) + torn)
        I.ingest(I.stream_lines(spark, str(tmp_path / "in")), store, str(tmp_path / "cp"), then=steps, once=True,
                 enrich=lambda e: enrich_events(e, None, prefixes, lists), rejected=str(tmp_path / "bad")).awaitTermination()

    arrive("one.jsonl", [("a", "03T00:00", "45.1.1.1"), ("b", "03T00:01", "45.1.1.1"), ("c", "03T00:02", "45.1.1.1")])
    assert sessions.read(store.read()).first().status == "open"
    arrive("two.jsonl", [("c", "03T00:02", "45.1.1.1"), ("d", "03T00:03", "45.1.1.1"), ("e", "03T02:00", "45.2.2.2")],
           '\n{"event_id": "torn\n{"event_id": "x"}')
    assert {r.session_id: r.status for r in sessions.read(store.read()).collect()} == {"s45.1.1.1": "closed", "s45.2.2.2": "open"}
    arrive("late.jsonl", [("f", "01T00:00", "45.2.2.2"), ("f", "01T00:00", "45.2.2.2"), ("a", "03T00:00", "45.1.1.1")])
    for step in steps:  # a replay changes nothing
        step(store.read(2), 2)
    events = store.read()
    assert sorted(r.event_id for r in events.collect()) == list("abcdef")
    row = events.filter("event_id = 'd'").first()
    assert (row.asn, row.threat_score) == (64500, 42.0)
    assert row.threat_tags == ["ti:a", "cred:generic-username", "hosting-provider"]
    bad = spark.read.parquet(str(tmp_path / "bad"))
    assert sorted((r.reason, r.batch) for r in bad.collect()) == [("no JSON object", 1), ("no time", 1)]
    assert [(r.hit_count, r.status) for r in alerts.read().collect()] == [(4, "new")]
    assert [r.announced for r in alerts.feed().collect()] == [0] and alerts.feed(1).count() == 0
    from sablewatch.operators.sessions import build_sessions

    whole = build_sessions(events)
    cols = whole.columns
    assert sorted(sessions.read(events).select(*cols).collect()) == sorted(whole.collect())
    both = {r.session_id: (r.opened, r.updated) for r in sessions.read(events).collect()}
    assert both == {"s45.1.1.1": (0, 1), "s45.2.2.2": (1, 2)}
    rebuilt = rebuild_sources(events, as_of)
    assert sorted(sources.read(events).select(*rebuilt.columns).collect()) == sorted(rebuilt.collect())
    hourly = {(str(r.bucket), r.series): r.n for r in counts.read(events).collect()}
    assert hourly == {("2024-01-03 00:00:00", "ssh"): 4, ("2024-01-03 02:00:00", "ssh"): 1, ("2024-01-01 00:00:00", "ssh"): 1}


def test_state_reads_only_touched_partitions(spark, tmp_path):
    def merge(rows):
        return rows.groupBy("k").agg(F.sum("n").alias("n"))

    table = StateTable(spark, str(tmp_path / "t"), ["k"], merge, buckets=8)
    first = spark.createDataFrame([(f"k{i}", 1) for i in range(60)], "k string, n long")
    table.apply(first, 0)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    fresh = spark.createDataFrame([("k7", 5), ("new", 2)], "k string, n long")
    for _ in range(2):  # the second run starts from what was there before the first
        table.apply(fresh, 1)
    rows = {r.k: (r.n, r.created, r.batch) for r in table.read(first.schema).collect()}
    assert len(rows) == 61 and rows["k7"] == (6, 0, 1) and rows["new"] == (2, 1, 1) and rows["k8"] == (1, 0, 0)
    same = [p for p in (tmp_path / "t").rglob("*.parquet") if before.get(p) == p.stat().st_mtime_ns]
    assert len({p.parent for p in same}) == 6


def test_list_functions_refuse_unknown_sorts(make_events):
    from sablewatch.operators.scoring import list_sources
    from sablewatch.operators.sessions import list_sessions
    from sablewatch.operators.timeseries import timeseries

    df = make_events([{}])
    for call in (lambda: list_sources(df, sort="x"), lambda: list_sessions(df, sort="x"),
                 lambda: timeseries(df, bucket="2h"), lambda: timeseries(df, by="colour"),
                 lambda: timeseries(df, bucket="1m", hours=24 * 365)):
        with pytest.raises(ValueError):
            call()


def test_an_event_is_parsed_and_enriched_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def enrich(events):
        def counted(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch
        return events.mapInArrow(counted, events.schema)

    store = EventStore(spark, str(tmp_path / "events"), EVENT)
    put(tmp_path / "in", "a.jsonl", "\n".join(
        json.dumps({"event_id": f"e{i % 8}", "ts": f"2024-01-0{i % 2 + 1}T00:00:0{i}Z"}) for i in range(10)))
    I.ingest(I.stream_lines(spark, str(tmp_path / "in")), store, str(tmp_path / "cp"), enrich=enrich,
             rejected=str(tmp_path / "bad"), once=True).awaitTermination()
    assert seen.value == 10
    assert sorted(r.event_id for r in store.read().collect()) == [f"e{i}" for i in range(8)]


def test_reasons_come_from_the_time_that_was_read(spark, make_events):
    at = '"ts": "2024-01-01T00:00:00Z"'
    lines = {"{%s}" % at: None, '{"src_port": "x", %s}' % at: None, "{%s" % at: "no JSON object",
             "[{%s}]" % at: "no JSON object", "{}": "no time", '{"ts": "soon"}': "no time", "5": "no JSON object"}
    rows = spark.createDataFrame([(line, "f") for line in lines], "line string, _file string")
    assert {r.line: r.reason for r in I.rejected_lines(rows).collect()} == {k: v for k, v in lines.items() if v}
    assert "from_json" not in str(I._reason())  # lines are not parsed again for it
    arrivals = X.event_json(make_events([{}, {"username": None}]))
    assert sorted(arrivals.collect()) == sorted(X.event_json_rows(make_events([{}, {"username": None}])).collect())
    assert "Sort" not in arrivals._jdf.queryExecution().optimizedPlan().toString()


def test_event_store_keeps_the_earliest_of_equal_ids(spark, make_events, tmp_path):
    at = lambda day, second: dt.datetime(2024, 1, day, 0, 0, second)
    events = make_events([
        {"event_id": "a", "ts": at(1, 5), "username": "late"}, {"event_id": "a", "ts": at(1, 1), "username": "y"},
        {"event_id": "a", "ts": at(1, 1), "username": "x"}, {"event_id": "a", "ts": at(2, 0), "username": "next day"},
        {"event_id": "b", "ts": at(1, 0), "username": "one"}, {"event_id": None, "ts": at(1, 3), "username": "q"},
        {"event_id": None, "ts": at(1, 2), "username": "p"}])
    store = EventStore(spark, str(tmp_path / "events"), EVENT)
    for batch in (0, 0):  # a batch run twice
        store.add(events, batch)
    rows = {(r.event_id, r.ts.day): r.username for r in store.read().collect()}
    assert rows == {("a", 1): "x", ("a", 2): "next day", ("b", 1): "one", (None, 1): "p"}
    assert store.read().count() == 4


def test_first_batch_of_a_state_table_is_not_merged(spark, tmp_path):
    calls = []

    def merge(rows):
        calls.append(1)
        return rows.groupBy("k").agg(F.sum("n").alias("n"))

    table = StateTable(spark, str(tmp_path / "t"), ["k"], merge, buckets=2)
    first = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n long")
    table.apply(first, 0)
    assert not calls
    table.apply(first, 0)  # again: starts from nothing
    assert sorted(tuple(r) for r in table.read(first.schema).collect()) == [("a", 1, 0, 0), ("b", 2, 0, 0)]


def test_tables_of_a_batch_are_deleted_with_it(spark, tmp_path):
    """Only the stores stay of a stream, and of an evaluation its alerts; drained arrivals may go."""
    import shutil
    from pathlib import Path

    from sablewatch.operators.rules import evaluate_rules
    from sablewatch.session import shared_folder, stored

    root = Path(shared_folder(spark, "x").removeprefix("file:")).parent
    stages = lambda: {p.name for p in root.glob("stage-*")}
    before = stages()
    rules = [Rule("hit", "hit", "high", "threshold", window_minutes=10, threshold=3), Rule("any", "any", "low", "match")]
    store = EventStore(spark, str(tmp_path / "events"), EVENT)
    alerts = live.LiveAlerts(spark, str(tmp_path / "alerts"), store, rules)
    for n in range(2):
        lines = [json.dumps({"event_id": f"e{n}{i}", "ts": f"2024-01-01T00:0{n}:0{i}Z", "src_ip": "45.1.1.1"}) for i in range(3)]
        rows = spark.createDataFrame([(line,) for line in [*lines, lines[0], "torn"]], "value string")
        sinks.write_text(rows, str(tmp_path / "in" / str(n)), gzip=True)
        I.ingest(I.stream_lines(spark, str(tmp_path / "in")), store, str(tmp_path / "cp"), then=[alerts.step], once=True,
                 enrich=lambda e: e, rejected=str(tmp_path / "bad")).awaitTermination()
        assert stages() == before
        shutil.rmtree(tmp_path / "in" / str(n))
    assert store.read().count() == 6 and spark.read.parquet(str(tmp_path / "bad")).count() == 2
    got = evaluate_rules(store.read(), rules)
    assert len(stages() - before) == 1
    assert {(r.rule_id, r.hit_count) for r in got.collect()} == {("hit", 6), ("any", 6)}
    assert {(r.rule_id, r.hit_count) for r in alerts.read().collect()} == {("hit", 6), ("any", 6)}

    before, name = stages(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    usual = spark.conf.get(name, None)
    with pytest.raises(KeyError), stored(spark.range(3)) as table:
        assert table.count() == 3
        raise KeyError
    assert stages() == before and spark.conf.get(name, None) == usual


def test_compressed_lines_lie_in_files_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "GZIP_LINES", 10)
    lines = [f'{{"n": "{i} ä"}}' for i in range(35)]
    sinks.write_text(spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1), str(tmp_path / "out"), gzip=True)
    assert len(list((tmp_path / "out").glob("*.gz"))) == 4
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == sorted(lines)
