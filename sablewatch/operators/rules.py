"""Windowed detection: rule conditions, sliding peaks, alert assembly.

All rules are matched in one scan and counted into cells by one aggregation. Sums per
time bucket decide which (rule, key, bucket) can reach its threshold; only those become
segments of a tree and are folded. No step keeps all rows of a key in one task.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator, Sequence
from contextlib import ExitStack, contextmanager
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sablewatch.functions.columns import has_text, literal_map, micros
from sablewatch.functions.topk import by_key, first_k
from sablewatch.plans.rule_catalog import Rule, RuleError
from sablewatch.schemas import column_or_null
from sablewatch.session import cut_lineage, drop_table, passing_shuffles, shuffle_tasks, stored

log = logging.getLogger(__name__)

EVIDENCE_IPS, EVIDENCE_EVENTS, EVIDENCE_VALUES = 20, 5, 25
EVIDENCE_COMMANDS, EVIDENCE_PATHS = 10, 25


# --------------------------------------------------------------------------- #
# Conditions
# --------------------------------------------------------------------------- #


def condition(df: DataFrame, where: dict[str, Any]) -> Column:
    """A rule's ``where`` block as one boolean Column that is never null."""
    return reduce(
        lambda acc, item: acc & _term(df, *item), where.items(), F.lit(True)
    )


def _term(df: DataFrame, key: str, expected: Any) -> Column:
    name, _, operator = key.partition("__")
    actual = column_or_null(df, name)
    if operator in ("", "eq"):
        return _equals(actual, expected)
    if operator == "contains":
        text = F.lower(actual.cast("string"))
        return F.coalesce(text.contains(str(expected).lower()), F.lit(False))
    if operator == "in_tags":
        if not _is_array(df, name):
            return F.lit(False)
        return F.coalesce(F.array_contains(actual, expected), F.lit(False))
    if operator == "gte":
        return F.coalesce(actual.cast("double") >= float(expected), F.lit(False))
    if operator == "lte":
        return F.coalesce(actual.cast("double") <= float(expected), F.lit(False))
    if operator == "isnull":
        return actual.isNull() if expected else actual.isNotNull()
    raise RuleError(f"unknown operator {operator!r} in condition {key!r}")


def _equals(actual: Column, expected: Any) -> Column:
    if isinstance(expected, (list, tuple)):
        known = [v for v in expected if v is not None]
        hit = F.coalesce(actual.isin(known), F.lit(False)) if known else F.lit(False)
        return hit | actual.isNull() if None in expected else hit
    return actual.isNull() if expected is None else actual.eqNullSafe(F.lit(expected))


def _is_array(df: DataFrame, name: str) -> bool:
    return name in df.columns and isinstance(df.schema[name].dataType, T.ArrayType)


# --------------------------------------------------------------------------- #
# One-pass matching
# --------------------------------------------------------------------------- #


def rule_hits(
    events: DataFrame,
    rules: Sequence[Rule],
    keep: Sequence[str] = (),
    only: DataFrame | None = None,
) -> DataFrame:
    """One row per (event, rule it satisfies): ``rule_id, key, value, t, w, hit``.

    ``only(rule_id, key)`` limits the result to those groups.

    ``t`` is the event time and ``w`` the rule's window, both in microseconds;
    ``value`` is the distinct field, ``hit`` the ratio numerator. A rule whose
    condition cannot be compiled is logged and left out; the others run.
    """
    slots = []
    for rule in rules:
        if not rule.enabled:
            continue
        try:
            slots.append(_slot(events, rule))
        except RuleError as exc:
            log.error("rule %s is skipped: %s", rule.id, exc)
    kept = [F.col(c) for c in keep]
    if not slots:
        slots = [F.when(F.lit(False), F.struct(*_slot_fields("", "", "", 0, 0, False)))]
    hits = events.select(
        micros("ts").alias("t"), *kept, F.explode(F.array_compact(F.array(*slots))).alias("m")
    ).select("m.*", "t", *keep)
    return hits if only is None else hits.join(only, ["rule_id", "key"], "left_semi")


def _slot_fields(rule_id, key, value, w, hit, _):
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return (
        F.lit(rule_id).alias("rule_id"),
        as_col(key).cast("string").alias("key"),
        as_col(value).cast("string").alias("value"),
        F.lit(w).cast("bigint").alias("w"),
        as_col(hit).cast("int").alias("hit"),
    )


def _slot(events: DataFrame, rule: Rule) -> Column:
    key = column_or_null(events, rule.group_by)
    value = column_or_null(events, rule.distinct_field) if rule.distinct_field else F.lit(None)
    hit = condition(events, rule.numerator_where) if rule.type == "ratio" else F.lit(False)
    fields = _slot_fields(rule.id, key, value, rule.window_us, hit, None)
    return F.when(condition(events, rule.where) & key.isNotNull(), F.struct(*fields))


# --------------------------------------------------------------------------- #
# Cells: one scan and one aggregation for all rules
# --------------------------------------------------------------------------- #

_RK = ["rule_id", "key"]
_TYPES = {"threshold": 0, "distinct": 1, "match": 2, "ratio": 2}


def rule_cells(events: DataFrame, rules: Sequence[Rule], only: DataFrame | None = None) -> DataFrame:
    """``rule_id, key, kind, w, value, cell, n, num, lo, hi``: what all rules need of the events.

    One scan, one explode and one aggregation with map-side combine. ``kind`` is 0 for a
    sliding count (a cell is an instant), 1 for a sliding distinct (a value in a bucket
    as wide as the window) and 2 for match and ratio rules (a cell is the whole group).
    """
    kinds = literal_map({r.id: _TYPES[r.type] for r in rules if r.enabled} or {"": 2})
    hits = rule_hits(_dealt(events), rules, only=only).withColumn("kind", F.element_at(kinds, F.col("rule_id")))
    slot = (F.when(F.col("kind") == 0, F.col("t"))
            .when(F.col("kind") == 1, F.floor(F.col("t") / F.col("w"))).otherwise(F.lit(0)))
    value = F.when(F.col("kind") == 1, F.col("value"))
    return (
        hits.filter((F.col("kind") != 1) | F.col("value").isNotNull())
        .groupBy(*_RK, "kind", "w", value.alias("value"), slot.alias("cell"))
        .agg(F.count("*").alias("n"), F.sum("hit").alias("num"), F.min("t").alias("lo"), F.max("t").alias("hi"))
    )


#: Events, and steps of the windows, that one task takes, about.
TASK_EVENTS, TASK_STEPS = 250_000, 500_000


def _dealt(events: DataFrame, tasks: int | None = None) -> DataFrame:
    """Events over as many tasks as their number asks for: files may be dense, and a task
    that counts cells before the shuffle holds one row per cell."""
    tasks = tasks or -(-events.count() // TASK_EVENTS)
    if tasks <= events.sparkSession.sparkContext.defaultParallelism:
        return events
    return events.repartition(tasks, *[c for c in ("event_id", "ts", "src_ip") if c in events.columns])


def _evidence_tasks(events: DataFrame) -> int:
    """Shuffle partitions for cells and evidence: an event gives several rows of each."""
    return -(-4 * events.count() // TASK_EVENTS)


def _count_steps(cells: DataFrame) -> DataFrame:
    """Every event counts from ``t`` to ``t + w`` inclusive."""
    up = F.struct(F.col("cell").alias("at"), F.col("n").alias("delta"))
    down = F.struct((F.col("cell") + F.col("w") + 1).alias("at"), (-F.col("n")).alias("delta"))
    return (cells.filter("kind = 0").select(*_RK, "w", F.explode(F.array(up, down)).alias("s"))
            .select(*_RK, "w", "s.*"))


def _distinct_steps(cells: DataFrame, tasks: int) -> DataFrame:
    """Every run of one value with gaps of at most ``w`` counts once.

    A bucket is as wide as the window: two sightings in one are in the same run, and
    only the neighbouring buckets can continue it. So each cell tells both neighbours
    its first and last time, and one aggregation by (value, bucket) gives the edges of
    the runs. A value with a third of all rows is never sorted.
    """
    cells = cells.filter("kind = 1")
    told = F.explode(F.array(
        F.struct(F.col("cell").alias("b"), F.col("lo"), F.col("hi"), F.lit(None).cast("long").alias("before"),
                 F.lit(None).cast("long").alias("behind")),
        F.struct((F.col("cell") + 1).alias("b"), F.lit(None).cast("long").alias("lo"),
                 F.lit(None).cast("long").alias("hi"), F.col("hi").alias("before"),
                 F.lit(None).cast("long").alias("behind")),
        F.struct((F.col("cell") - 1).alias("b"), F.lit(None).cast("long").alias("lo"),
                 F.lit(None).cast("long").alias("hi"), F.lit(None).cast("long").alias("before"),
                 F.col("lo").alias("behind")))).alias("c")
    edges = (
        cells.select(*_RK, "w", "value", told).select(*_RK, "w", "value", "c.b", "c")
        # At most three rows are alike here, so nothing is gained by adding up first.
        .repartition(tasks, *_RK, "value", "b").groupBy(*_RK, "w", "value", "b")
        .agg(*[F.max(f"c.{c}").alias(c) for c in ("lo", "hi", "before", "behind")])
        .filter("lo IS NOT NULL")
    )
    far = lambda gap: gap.isNull() | (gap > F.col("w"))
    opens = F.when(far(F.col("lo") - F.col("before")),
                   F.struct(F.col("lo").alias("at"), F.lit(1).cast("bigint").alias("delta")))
    shuts = F.when(far(F.col("behind") - F.col("hi")),
                   F.struct((F.col("hi") + F.col("w") + 1).alias("at"), F.lit(-1).cast("bigint").alias("delta")))
    return (edges.select(*_RK, "w", F.explode(F.array_compact(F.array(opens, shuts))).alias("s"))
            .select(*_RK, "w", "s.*"))


# --------------------------------------------------------------------------- #
# Sliding peaks: a tree of mergeable segments
# --------------------------------------------------------------------------- #

#: Children of a segment: buckets of a window's width are cut twice by this.
_FAN = 1024


def _folded(segments: DataFrame, parent: list[str], order: str) -> DataFrame:
    """Neighbouring segments as one: ``net, peak, place`` per ``parent``.

    A segment is (sum of its steps, its largest prefix sum, where that is first
    reached). Two neighbours make (a + b, max(peak a, a + peak b), its place): the
    sums before a child come from a window over at most ``_FAN`` rows, or over one
    row per bucket of a key. Parents and order are prefixes of one sort order, so that
    rows sorted once stay sorted through all folds.
    """
    before = W.partitionBy(*parent).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    shifted = segments.withColumn("peak", F.coalesce(F.sum("net").over(before), F.lit(0)) + F.col("peak"))
    return shifted.groupBy(*parent).agg(
        F.sum("net").alias("net"), F.max(F.struct("peak", (-F.col("place")).alias("neg"))).alias("p")
    ).select(*parent, "net", F.col("p.peak").alias("peak"), (-F.col("p.neg")).alias("place"))


def _peaks(steps: DataFrame, thresholds: Column, tasks: int) -> DataFrame:
    """Highest running sum per (rule, key) and the first time it is reached.

    Sums per bucket of a window's width tell which buckets can reach the threshold;
    the steps of these become segments of a 2**20th of the window, folded twice into
    buckets and once into keys. A flood inside one window is thus spread over its
    segments. ``tasks`` is the number of tasks that the steps are dealt to.
    """
    steps = steps.withColumn("b", F.floor(F.col("at") / F.col("w"))).repartition(tasks, *_RK, "b")
    totals = steps.groupBy(*_RK, "w", "b").agg(
        F.sum("delta").alias("net"),
        F.sum(F.greatest("delta", F.lit(0))).alias("gain"),
    )
    before = by_key(_RK).orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    based = totals.withColumn("base", F.coalesce(F.sum("net").over(before), F.lit(0)))
    live = based.filter(F.col("base") + F.col("gain") >= thresholds).select(*_RK, "b", "base")
    leaf = F.greatest(F.floor(F.col("w") / (_FAN * _FAN)), F.lit(1))
    instants = (
        steps.join(live, [*_RK, "b"])
        .groupBy(*_RK, "w", "b", "base", "at").agg(F.sum("delta").alias("net"))
        .withColumn("leaf", F.floor((F.col("at") - F.col("b") * F.col("w")) / leaf))
        .withColumn("branch", F.floor(F.col("leaf") / _FAN))
        .withColumn("peak", F.col("net")).withColumn("place", F.col("at"))
        .withColumn("h", F.xxhash64(*_RK, "b"))  # sorts faster than two strings
    )
    path = ["h", *_RK, "w", "b", "base"]
    leaves = _folded(instants, [*path, "branch", "leaf"], "at")
    branches = _folded(leaves, [*path, "branch"], "leaf")
    buckets = _folded(branches, path, "branch").withColumn("n", F.col("base") + F.col("peak"))
    best = buckets.filter(F.col("n") >= thresholds).groupBy(*_RK, "w").agg(
        F.max(F.struct("n", (-F.col("place")).alias("neg"))).alias("p"))
    return best.select(
        *_RK,
        F.col("p.n").cast("double").alias("observed"),
        (-F.col("p.neg") - F.col("w")).alias("span_lo"),
        (-F.col("p.neg")).alias("span_hi"),
    )


def _group_spans(cells: DataFrame, ratio_thresholds: dict[str, float]) -> DataFrame:
    """match and ratio rules: the whole group is the span."""
    share = F.col("num") / F.col("n")
    need = F.try_element_at(literal_map(ratio_thresholds), F.col("rule_id")) \
        if ratio_thresholds else F.lit(None).cast("double")
    return cells.filter("kind = 2").filter(need.isNull() | (share >= need)).select(
        *_RK,
        F.when(need.isNull(), F.col("n").cast("double"))
        .otherwise(F.bround(share, 4))
        .alias("observed"),
        F.col("lo").alias("span_lo"),
        F.col("hi").alias("span_hi"),
    )


def fired_spans(
    events: DataFrame, rules: Sequence[Rule], only: DataFrame | None = None
) -> DataFrame:
    """``rule_id, key, observed, span_lo, span_hi`` of everything that fired.

    The cells of all rules are counted at once and stored; match and ratio rules are
    finished by that pass, the windows work on the stored cells.
    """
    rules = [r for r in rules if r.enabled]
    with shuffle_tasks(events.sparkSession, _evidence_tasks(events)):
        cells = cut_lineage(rule_cells(events, rules, only))
    return _spans(cells, rules)


def _spans(cells: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The spans of :func:`fired_spans` from stored cells of enabled rules."""
    ratios = {r.id: float(r.threshold) for r in rules if r.type == "ratio"}
    spans = _group_spans(cells, ratios)
    windowed = {r.id: float(r.threshold) for r in rules if r.type in ("threshold", "distinct")}
    if not windowed:
        return spans
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(parts, -(-2 * cells.filter("kind < 2").count() // TASK_STEPS))
    steps = [build for build, kind in ((_count_steps(cells), "threshold"), (_distinct_steps(cells, tasks), "distinct"))
             if any(r.type == kind for r in rules)]
    need = F.element_at(literal_map(windowed), F.col("rule_id"))
    return spans.unionByName(_peaks(reduce(DataFrame.unionByName, steps), need, tasks))


# --------------------------------------------------------------------------- #
# Alerts
# --------------------------------------------------------------------------- #

_EVIDENCE_COLUMNS = ("event_id", "src_ip", "session_id", "service", "command", "path")


def evaluate_rules(
    events: DataFrame, rules: Sequence[Rule], only: DataFrame | None = None
) -> DataFrame:
    """Alerts of every enabled rule, one row per (rule, group key).

    Runs at once and is stored, in as many tasks as the events ask for. So are the events
    of the firing spans, which three aggregations read: each sorts or counts only what one
    task has written before it shuffles, however few keys there are.
    """
    with _assembled(events, rules, only) as alerts:
        return cut_lineage(alerts)


@contextmanager
def passing_alerts(
    events: DataFrame, rules: Sequence[Rule], only: DataFrame | None = None
) -> Iterator[DataFrame]:
    """The alerts of :func:`evaluate_rules`, stored for the time inside."""
    with ExitStack() as kept:
        with _assembled(events, rules, only) as alerts:
            alerts = kept.enter_context(stored(alerts))
        yield alerts


@contextmanager
def _assembled(events: DataFrame, rules: Sequence[Rule], only: DataFrame | None) -> Iterator[DataFrame]:
    """The alerts, to be stored inside: cells, spans and their events are deleted at the end,
    each as soon as nothing more is computed from it."""
    rules = [r for r in rules if r.enabled]
    spark, tasks = events.sparkSession, _evidence_tasks(events)
    with shuffle_tasks(spark, tasks), passing_shuffles(spark), ExitStack() as passing:
        with stored(rule_cells(events, rules, only)) as cells:
            # One row per alert, read by three branches below: computed once, here.
            spans = passing.enter_context(stored(_spans(cells, rules)))
        base = _dealt(events, tasks)
        for name in _EVIDENCE_COLUMNS:
            base = base.withColumn(name, column_or_null(events, name).cast("string"))
        members = cut_lineage(rule_hits(base, rules, keep=_EVIDENCE_COLUMNS).join(spans, _RK).filter(
            F.col("t").between(F.col("span_lo"), F.col("span_hi"))
        ).select(*_RK, "value", "t", "observed", *_EVIDENCE_COLUMNS))
        passing.callback(drop_table, members)
        yield _assemble(members, _samples(members), rules)


_SET_FACETS = {"ips": "src_ip", "paths": "path", "values": "value"}
_ORDERED_FACETS = {"events": "event_id", "commands": "command"}


def _cells(facets: dict[str, str]) -> Column:
    """One ``(facet, v)`` per present value. An empty distinct value is a value."""
    return F.explode(
        F.array_compact(
            F.array(
                *[
                    F.when(
                        F.col(c).isNotNull() if c == "value" else has_text(c),
                        F.struct(F.lit(f).alias("facet"), F.col(c).alias("v")),
                    )
                    for f, c in facets.items()
                ]
            )
        )
    ).alias("f")


def _samples(members: DataFrame) -> DataFrame:
    """Bounded evidence lists per alert, one array column per facet."""
    sets = members.select(*_RK, _cells(_SET_FACETS)).select(*_RK, "f.*").distinct()
    sets = first_k(sets, [*_RK, "facet"], [F.col("v")], EVIDENCE_VALUES)
    ordered = members.select(*_RK, "t", "event_id", _cells(_ORDERED_FACETS)).select(
        *_RK, "t", "event_id", "f.*"
    )
    ordered = first_k(
        ordered, [*_RK, "facet"], [F.col("t"), F.col("event_id")], EVIDENCE_COMMANDS
    )
    cols = [*_RK, "facet", "_rank", "v"]
    both = sets.select(*cols).unionByName(ordered.select(*cols))
    # At most 25 values a facet reach this aggregate.
    return both.groupBy(*_RK).agg(
        *[
            F.transform(
                F.array_sort(
                    F.collect_list(F.when(F.col("facet") == f, F.struct("_rank", "v")))
                ),
                lambda x: x["v"],
            ).alias(f)
            for f in (*_SET_FACETS, *_ORDERED_FACETS)
        ]
    )


def _assemble(members: DataFrame, samples: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    order = F.struct("t", "event_id")
    core = members.groupBy(*_RK).agg(
        F.first("observed").alias("observed"),
        F.count("*").alias("hit_count"),
        F.min("t").alias("lo"),
        F.max("t").alias("hi"),
        F.array_sort(F.collect_set(F.when(has_text("service"), F.col("service")))).alias(
            "services"
        ),
        F.min_by(F.struct("src_ip", "session_id"), order).alias("sample"),
    )
    row = core.join(samples, _RK, "left").join(F.broadcast(_rule_table(core, rules)), "rule_id")

    def pick(facet: str, k: int) -> Column:
        return F.when(F.size(facet) > 0, F.slice(facet, 1, k))

    first, last = F.timestamp_micros("lo"), F.timestamp_micros("hi")
    whole = F.col("observed").cast("bigint")
    title = (
        F.when(
            F.col("type") == "threshold",
            F.concat("rule_name", F.lit(": "), whole, F.lit(" events from "), "key"),
        )
        .when(
            F.col("type") == "distinct",
            F.concat(
                "rule_name", F.lit(": "), whole, F.lit(" distinct "), "distinct_field",
                F.lit(" from "), "key",
            ),
        )
        .when(
            F.col("type") == "ratio",
            F.concat(
                "rule_name", F.lit(": ratio "),
                F.bround(F.col("observed") * 100, 0).cast("bigint"), F.lit("% for "), "key",
            ),
        )
        .otherwise(F.concat("rule_name", F.lit(": "), "key"))
    )
    evidence = F.struct(
        "observed",
        "threshold",
        F.col("hit_count").alias("matching_events"),
        "window_minutes",
        "group_by",
        F.col("key").alias("group_value"),
        "services",
        pick("ips", EVIDENCE_IPS).alias("source_ips"),
        first.alias("first_event"),
        last.alias("last_event"),
        pick("events", EVIDENCE_EVENTS).alias("sample_event_ids"),
        "distinct_field",
        F.when(F.col("type") == "distinct", pick("values", EVIDENCE_VALUES)).alias(
            "distinct_values_sample"
        ),
        pick("commands", EVIDENCE_COMMANDS).alias("commands"),
        pick("paths", EVIDENCE_PATHS).alias("paths_sample"),
    )
    dedupe = F.concat("rule_id", F.lit("|"), "key")
    return row.select(
        F.left(F.sha2(dedupe, 256), F.lit(32)).alias("alert_id"),
        "rule_id",
        "rule_name",
        "severity",
        F.when(F.col("group_by") == "src_ip", F.col("key"))
        .otherwise(F.col("sample.src_ip"))
        .alias("src_ip"),
        F.when(F.col("group_by") == "session_id", F.col("sample.session_id")).alias("session_id"),
        F.when(F.size("services") == 1, F.element_at("services", 1)).alias("service"),
        title.alias("title"),
        "description",
        evidence.alias("evidence"),
        "mitre",
        first.alias("first_seen"),
        last.alias("last_seen"),
        "hit_count",
        dedupe.alias("dedupe_key"),
        F.lit("new").alias("status"),
        F.lit(None).cast("string").alias("notes"),
    )


def _rule_table(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The rule list as a table; one row per rule, so broadcasting it is bounded."""
    schema = (
        "rule_id string, rule_name string, severity string, description string, type string, "
        "threshold double, window_minutes double, group_by string, distinct_field string, "
        "mitre array<string>"
    )
    rows = [
        (r.id, r.name, r.severity, r.description, r.type, float(r.threshold),
         float(r.window_minutes), r.group_by, r.distinct_field, list(r.mitre))
        for r in rules
    ]
    return df.sparkSession.createDataFrame(rows, schema)
