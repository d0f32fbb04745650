"""Cheapest repair of a conversation's turns by weighted interval parsing.

A conversation should read, by the initials of its roles, ``(s?(ua)+)?``. Each row may
be kept (0), given the role user or assistant (2) or deleted (3; blank rows and repeats
must be); a user or assistant turn without text may be inserted anywhere (2). A row
that stays although its text is cut off adds 1. Of all cheapest repairs the one with the
ASCII-least audit is taken: the initials K, R, D, I of its edits in order.

The repair grammar is in Chomsky normal form over *intervals of rows*. Its nonterminals
are pairs (p, q) of role states (nothing yet, after a system turn, after a user turn,
after an assistant turn); (p, q) derives the rows and insertions that lead from p to q:

* ``(p, q) -> (p, r) (r, q)`` for every r,
* ``(p, q) -> row`` by one of the edits that a row allows,
* ``(p, q) -> nothing`` by insertions alone (the insertion closure).

The cell of an interval holds, per nonterminal, the least (cost, audit). Whatever a
parse derives passes through some state r between any two neighbouring rows, so every
split of an interval gives the same cell and one split is enough: cells are combined
bottom up by span length, in a number of steps that follows the rows, not their cube.
Two audits of one cell and cost never begin one another, so least parts join to least
wholes.

Spark sorts light rows (no texts) by range of conversation and turn, so that a
conversation with a third of all rows lies in many partitions. Each partition parses its
runs in spans of at most ``SPAN`` rows; spans of one conversation are combined ``FAN``
at a time, in rounds. The audit is cut back into spans, whose edits are joined to the
texts by row number. Only the audit of a conversation and, in the query, the hash of its
text, which is sequential by definition, pass through one task, as streams.

Rows of a conversation come by turn, nulls first; ties by role, then by the SHA-256 of
the text; equal rows are interchangeable. Null role or text: one space, so a null text
is blank. A null conversation id is a conversation. An empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sablewatch.llm.registry import query, table
from sablewatch.llm.storage import cut_lineage

#: Most rows of a span that one step parses, and spans combined at a time.
SPAN = 256
FAN = 64
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
_SPACE = " \t\n\x0b\x0c\r"

# --------------------------------------------------------------------------- #
# Grammar and cells
# --------------------------------------------------------------------------- #

#: Role state -> what a turn with an initial leads to.
STEPS = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ACCEPT = (0, 3)
#: Nonterminals: from the first state to the second.
PAIRS = [(p, q) for p in STEPS for q in STEPS if p == q or q > 1 or (p, q) == (0, 1)]
_AT = {pair: i for i, pair in enumerate(PAIRS)}
#: Binary rules: whole, left and right part.
RULES = [(_AT[p, q], _AT[p, r], _AT[r, q]) for p, q in PAIRS for r in STEPS
         if (p, r) in _AT and (r, q) in _AT]

Cell = list  # per nonterminal (cost, audit) or None


def combine(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring intervals together."""
    out: Cell = [None] * len(PAIRS)
    for whole, a, b in RULES:
        x, y = left[a], right[b]
        if x is None or y is None:
            continue
        best, cost = out[whole], x[0] + y[0]
        if best is None or cost < best[0]:
            out[whole] = cost, x[1] + y[1]
        elif cost == best[0]:
            audit = x[1] + y[1]
            if audit < best[1]:
                out[whole] = cost, audit
    return out


def _insertions() -> Cell:
    """The closure of insertions: what leads from p to q without a row."""
    out: Cell = [(0, "") if p == q else None for p, q in PAIRS]
    one: Cell = [None] * len(PAIRS)
    for p, steps in STEPS.items():
        for initial, q in steps.items():
            if initial in "ua":
                one[_AT[p, q]] = INSERT, "I"
    grown = [x or y for x, y in zip(out, one, strict=True)]
    while grown != out:
        out, grown = grown, combine(grown, grown)
    return out


CLOSURE = _insertions()
_ROWS: dict[tuple[str, int], Cell] = {}


def row_cell(initial: str, fault: int) -> Cell:
    """A row's cell. ``fault``: 0 none, 1 must go, 2 its text is cut off."""
    key = initial if initial in ("s", "u", "a") else "", fault
    if key not in _ROWS:
        edits: Cell = [None] * len(PAIRS)
        extra = TRUNCATED if fault == 2 else 0
        for p, steps in STEPS.items():
            edits[_AT[p, p]] = DELETE, "D"
            if fault != 1:
                for role, q in steps.items():
                    if role == key[0]:
                        edits[_AT[p, q]] = extra, "K"
                    elif role in "ua":
                        edits[_AT[p, q]] = REROLE + extra, "R"
        _ROWS[key] = combine(combine(CLOSURE, edits), CLOSURE)
    return _ROWS[key]


class Span:
    """Cells of neighbouring intervals, combined when two of equal size are there."""

    def __init__(self) -> None:
        self.parts: list[tuple[int, Cell]] = []

    def add(self, cell: Cell) -> None:
        size = 1
        while self.parts and self.parts[-1][0] == size:
            cell = combine(self.parts.pop()[1], cell)
            size *= 2
        self.parts.append((size, cell))

    def cell(self) -> Cell:
        """The whole span's cell."""
        out = self.parts[-1][1]
        for _, cell in reversed(self.parts[:-1]):
            out = combine(cell, out)
        return out


def cheapest(cell: Cell) -> tuple[int, str]:
    return min(x for q in ACCEPT if (x := cell[_AT[0, q]]) is not None)


def written_roles(audit: str) -> str:
    """The initials that an audit's edits other than D leave, in order."""
    turns = len(audit) - audit.count("D")
    return "s" * (turns % 2) + "ua" * (turns // 2)


# --------------------------------------------------------------------------- #
# Spark
# --------------------------------------------------------------------------- #

_CELL = "cost array<long>, audit array<string>"
_SPANS = f"span long, conv_id {{kind}}, uid array<long>, first string, last string, illegal long, {_CELL}"


def _legal(left: str, right: str) -> bool:
    return left + right in ("su", "ua", "au")


def _columns(cells: list[Cell]) -> dict[str, pa.Array]:
    return {"cost": pa.array([[x and x[0] for x in c] for c in cells], pa.list_(pa.int64())),
            "audit": pa.array([[x and x[1] for x in c] for c in cells], pa.list_(pa.string()))}


def _rows(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _in_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2_000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def faults(rows: DataFrame) -> DataFrame:
    """``uid, conv_id, turn, role, digest, fault`` of ``uid, conv_id, turn, role, text``.

    ``fault``: ``blank``, ``duplicate`` (role and text stand earlier), ``truncated`` or null.
    """
    body = F.rtrim(F.col("text"), F.lit(_SPACE))
    light = rows.select(
        "uid", "conv_id", "turn", "role", F.sha2(F.encode("text", "UTF-8"), 256).alias("digest"),
        (body == "").alias("blank"), F.right(body, F.lit(1)).isin(".", "!", "?").alias("ended"))
    # One row number per distinct role and text: its earliest place.
    place = F.struct(F.col("turn").isNotNull().alias("given"), "turn", "uid")
    earliest = (light.filter(~F.col("blank")).groupBy("conv_id", "role", "digest")
                .agg(F.min(place).alias("at")).select(F.col("at.uid").alias("uid"), F.lit(True).alias("new")))
    fault = (F.when(F.col("blank"), "blank").when(F.col("new").isNull(), "duplicate")
             .when(~F.col("ended"), "truncated"))
    return light.join(earliest, "uid", "left").select(
        "uid", "conv_id", "turn", "role", "digest", fault.alias("fault"))


def _parse_spans(light: DataFrame, kind: str) -> DataFrame:
    """A row per span of at most ``SPAN`` neighbouring rows of a conversation."""
    order = ["conv_id", "turn", "role", "digest", "uid"]
    must = (F.when(F.col("fault").isin("blank", "duplicate"), 1).when(F.col("fault") == "truncated", 2)
            .otherwise(0).cast("int"))
    laid = (light.repartitionByRange(*order).sortWithinPartitions(*order)
            .select("conv_id", "uid", F.substring("role", 1, 1).alias("initial"), must.alias("must")))

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        out, own, conv, span, last, illegal = [], [], None, Span(), "", 0
        first = ""

        def flush():
            nonlocal number
            out.append((number, conv, own, first, last, illegal, span.cell()))
            number += 1

        def batch_of():
            spans, convs, uids, firsts, lasts, counts, cells = zip(*out, strict=True)
            return pa.RecordBatch.from_pydict({
                "span": pa.array(spans, pa.int64()), "conv_id": pa.array(convs, id_type),
                "uid": pa.array(uids, pa.list_(pa.int64())), "first": firsts, "last": lasts,
                "illegal": pa.array(counts, pa.int64()), **_columns(cells)})

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for row_conv, uid, initial, must in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own and (row_conv != conv or len(own) == SPAN):
                    flush()
                    own = []
                if not own:
                    conv, span, first, illegal = row_conv, Span(), initial, 0
                else:
                    illegal += not _legal(last, initial)
                own.append(uid)
                span.add(row_cell(initial, must))
                last = initial
            if len(out) >= 500:
                yield batch_of()
                out = []
        if own:
            flush()
        if out:
            yield batch_of()

    return laid.mapInArrow(run, _SPANS.format(kind=kind))


def _combine_spans(spans: DataFrame, kind: str) -> DataFrame:
    """``conv_id, illegal, cost, audit`` of whole conversations."""
    level = spans.drop("uid")
    while True:
        most = level.groupBy("conv_id").count().agg(F.max("count")).first()[0]
        if not most or most == 1:
            break
        # Neighbouring spans get consecutive numbers; the spans of one conversation are few.
        nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("span")) - 1
        order = ["conv_id", "lot", "span"]
        dealt = (level.withColumn("lot", F.floor(nth / FAN)).repartition("conv_id", "lot")
                 .sortWithinPartitions(*order).select(*order, "first", "last", "illegal", "cost", "audit"))

        def run(batches):
            state: list = []
            id_type = None

            def batch_of():
                conv, lot, first, last, illegal, span = state
                return pa.RecordBatch.from_pydict({
                    "span": pa.array([lot], pa.int64()), "conv_id": pa.array([conv], id_type),
                    "first": [first], "last": [last], "illegal": pa.array([illegal], pa.int64()),
                    **_columns([span.cell()])})

            for batch in batches:
                id_type = batch.schema.field(0).type
                for conv, lot, _, first, last, illegal, cost, audit in _rows([batch]):
                    cell = [None if c is None else (c, a) for c, a in zip(cost, audit, strict=True)]
                    if state and state[:2] != [conv, lot]:
                        yield batch_of()
                        state = []
                    if not state:
                        state = [conv, lot, first, last, illegal, Span()]
                    else:
                        state[4] += illegal + (not _legal(state[3], first))
                        state[3] = last
                    state[5].add(cell)
            if state:
                yield batch_of()

        level = cut_lineage(dealt.mapInArrow(run, _SPANS.format(kind=kind).replace(" uid array<long>,", "")))

    def finish(batches):
        for batch in batches:
            best = [cheapest([None if c is None else (c, a) for c, a in zip(*x, strict=True)])
                    for x in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({
                "conv_id": batch.column(0), "illegal": batch.column(1),
                "cost": pa.array([c for c, _ in best], pa.int64()),
                "audit": pa.array([a for _, a in best], pa.string())})

    return level.select("conv_id", "illegal", "cost", "audit").mapInArrow(
        finish, f"conv_id {kind}, illegal long, cost long, audit string")


def _cut_audits(spans: DataFrame, whole: DataFrame) -> DataFrame:
    """``span, edits, roles``: each span's part of its conversation's audit.

    ``roles`` are the initials that the span's edits other than D leave.
    """
    lines = (whole.select("conv_id", F.lit(-1).cast("long").alias("span"), "audit", F.lit(0).alias("n"))
             .unionByName(spans.select("conv_id", "span", F.lit(None).cast("string").alias("audit"),
                                       F.size("uid").alias("n"))))
    # A conversation's audit comes first, then its spans in order.
    laid = lines.repartition("conv_id").sortWithinPartitions("conv_id", "span").select("span", "audit", "n")

    def run(batches):
        def parts():
            audit, roles, at, left = "", "", 0, 0
            for span, line, n in _rows(batches):
                if span < 0:
                    audit, roles, at, left = line, written_roles(line), 0, len(line) - line.count("I")
                    continue
                left -= n
                end = at
                if left:  # insertions stand with the row behind them
                    for _ in range(n):
                        while audit[end] == "I":
                            end += 1
                        end += 1
                else:
                    end = len(audit)
                edits = audit[at:end]
                turns = len(edits) - edits.count("D")
                yield span, edits, roles[:turns]
                roles, at = roles[turns:], end

        schema = pa.schema([("span", pa.int64()), ("edits", pa.string()), ("roles", pa.string())])
        yield from _in_batches(parts(), schema)

    return laid.mapInArrow(run, "span long, edits string, roles string")


def repair_conversations(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(report, turns)``.

    ``report``: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` of every
    conversation with a row. ``turns``: ``conv_id, place, edit, role, text`` of the repaired
    conversations; ``place`` orders the turns. Gaps beyond 64 bits are null. Runs jobs when
    called.
    """
    kind = rows.schema[conv_col].dataType.simpleString()
    filled = cut_lineage(rows.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"))
        .withColumn("uid", F.monotonically_increasing_id()))
    light = cut_lineage(faults(filled))
    spans = cut_lineage(_parse_spans(light, kind))
    whole = cut_lineage(_combine_spans(spans, kind))

    count = lambda name: F.count(F.when(F.col("fault") == name, 1)).alias(name)
    width = F.expr("try_subtract(try_add(try_subtract(max(turn), min(turn)), 1), count(DISTINCT turn))")
    counted = light.groupBy("conv_id").agg(
        F.when(F.count("turn") == 0, F.lit(0).cast("long")).otherwise(width).alias("gaps"),
        count("blank"), count("duplicate"), count("truncated"))
    same = counted["conv_id"].eqNullSafe(whole["conv_id"])
    report = counted.join(whole, same).select(
        counted["conv_id"], "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    def edit(batches):
        """A row per turn that an edit leaves; an inserted one has no row number."""
        def turns():
            for span, conv, uid, edits, roles in _rows(batches):
                row = turn = 0
                for letter in edits:
                    own = None
                    if letter != "I":
                        own = uid[row]
                        row += 1
                    if letter != "D":
                        role = None if letter == "K" else "user" if roles[turn] == "u" else "assistant"
                        yield conv, span, turn, letter, own, role
                        turn += 1

        first = next(batches, None)
        if first is None:
            return
        id_type = first.schema.field(1).type
        batches = _chain(first, batches)
        schema = pa.schema([("conv_id", id_type), ("span", pa.int64()), ("turn", pa.int32()),
                            ("edit", pa.string()), ("uid", pa.int64()), ("given", pa.string())])
        yield from _in_batches(turns(), schema)

    edited = cut_lineage(
        spans.select("span", "conv_id", "uid").join(_cut_audits(spans, whole), "span")
        .select("span", "conv_id", "uid", "edits", "roles").mapInArrow(
            edit, f"conv_id {kind}, span long, turn int, edit string, uid long, given string"))
    place = F.struct("span", "turn").alias("place")
    held = (edited.filter("uid IS NOT NULL").join(filled.select("uid", "role", "text"), "uid")
            .select("conv_id", place, "edit", F.coalesce("given", "role").alias("role"), "text"))
    new = edited.filter("uid IS NULL").select(
        "conv_id", place, "edit", F.col("given").alias("role"), F.lit("").alias("text"))
    return report, held.unionByName(new)


def _chain(first, rest):
    yield first
    yield from rest


def text_hashes(turns: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of each conversation's ``role:text`` lines, as a stream."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    line = F.concat("role", F.lit(":"), "text")
    laid = (turns.select("conv_id", "place", F.encode(line, "UTF-8").alias("line"))
            .repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "line"))

    def run(batches):
        conv, digest, id_type = None, None, None

        def batch_of():
            return pa.RecordBatch.from_pydict({"conv_id": pa.array([c for c, _ in out], id_type),
                                               "repaired_sha256": [d for _, d in out]})

        out = []
        for batch in batches:
            id_type = batch.schema.field(0).type
            for own, raw in _rows([batch]):
                if digest is None or own != conv:
                    if digest is not None:
                        out.append((conv, digest.hexdigest()))
                    conv, digest = own, hashlib.sha256(raw)
                else:
                    digest.update(b"\n" + raw)
            if len(out) > 2_000:
                yield batch_of()
                out.clear()
        if digest is not None:
            out.append((conv, digest.hexdigest()))
        if out:
            yield batch_of()

    return laid.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def damage(rows: DataFrame) -> DataFrame:
    """Conversations with known faults, by the checksum of ``conv_id:turn``.

    Of 20 values 0 drops a row, 1 empties its text, 2 removes its sentence ends, 3 repeats
    it and 4 gives it the role user. Nulls are one space.
    """
    space = lambda c: F.coalesce(c, F.lit(" "))
    name = F.concat(space(F.col("conv_id").cast("string")), F.lit(":"), space(F.col("turn").cast("string")))
    drawn = rows.select(
        "conv_id", "turn", space(F.col("role")).alias("role"), space(F.col("text")).alias("text"),
        F.pmod(F.crc32(F.encode(name, "UTF-8")), F.lit(20)).alias("kind")).filter("kind <> 0")
    kind: Column = F.col("kind")
    return drawn.select(
        "conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    ).drop("copy")


@query("op13_conversation_repair")
def op13_conversation_repair(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    report, turns = repair_conversations(damage(rows))
    every = rows.select(F.col("conv_id").alias("conv")).distinct()
    hashes = text_hashes(turns).withColumnRenamed("conv_id", "hashed")
    none = hashlib.sha256(b"").hexdigest()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return (every.join(report, F.col("conv").eqNullSafe(F.col("conv_id")), "left")
            .join(hashes, F.col("conv").eqNullSafe(F.col("hashed")), "left")
            .select(F.col("conv").alias("conv_id"),
                    F.when(F.col("audit").isNull(), F.lit(0).cast("long")).otherwise(F.col("gaps")).alias("gaps"),
                    *(zero(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")),
                    F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256")))
