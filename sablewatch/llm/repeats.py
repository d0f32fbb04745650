"""Repeated passages: every byte of a ``length``-byte string that starts earlier too.

"Earlier" is by (doc_id, place in the text); strings do not cross documents and are
judged on the input. Suffixes are sorted by the difference-cover algorithm
(:mod:`sablewatch.llm.suffix_array`), distributed by content:

1. *Meeting points.* Each window of ``length`` bytes has one anchor: the place, in
   it, of the least hash of ``gram`` bytes. Equal windows have equal anchors at equal
   offsets, so all windows around one anchor travel as one record: the gram's hash,
   a name (hash) of the whole stretch these windows cover, and its place. A gram that
   occurs once cannot be in a repeated window; most of the corpus ends here.
2. *Equal stretches.* Per gram and name the earliest stands; every other one is
   removed whole. Tasks fold their own repeats first, so a passage that a third of
   all documents hold is one record per block of texts.
3. *Stretches that differ* but share the gram are sent, as text, to the partition
   where their equal windows must meet: that of the gram and of the bytes that all
   windows at similar offsets have in common. There the suffix array of what met is
   built, neighbours are compared over ``length`` bytes, and in each run of equal
   windows all but the earliest go.
4. A gram with many stretches (``CROWD``), as at the edges of a passage that many
   documents hold in contexts of their own, would fill one partition. Its partitions are
   dealt out further by place. Each one removes what repeats in it and passes on the
   earliest place of each of its windows by hash; the least of these places stands.

The steps are exact up to collisions of 128 bits of hashes.

Null text: an empty one. Null doc_id sorts first. Rows equal in id and text are one
document: both keep the same bytes. Texts shorter than ``length`` stay whole. Other
columns do not matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sablewatch.llm.bits import passes, send_filter
from sablewatch.llm.blocks import Block, PieceHash, blocks, map_blocks, mix, ragged, string_column
from sablewatch.llm.registry import query, table
from sablewatch.llm.storage import cut_lineage
from sablewatch.llm.suffix_array import equal_to_previous, suffix_array

LENGTH = 100
GRAM = 32
#: Anchor offsets that share a partition.
CELL = 35
#: Bytes of text in one suffix array, about; keys are kept whole.
SORT_BYTES = 2 << 20
#: Stretches of one gram that meet in one partition, about.
CROWD = 4000
_OTHER_BYTES = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64)


def stretches(block: Block, length: int, gram: int):
    """``(text, start, end, anchor)``: windows around one anchor, as byte ranges.

    Windows start at ``start .. end - length``. Hashes of grams are returned too.
    """
    data, bounds = block.data, block.bounds
    grams = PieceHash(data).windows(gram)
    span = length - gram + 1
    n = len(data) - length + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none, none, none, none, grams
    # The place of the least hash of `span` neighbours; of equal hashes the first.
    low = np.uint64((1 << 32) - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[: width - span], least[span - width :])
    anchor = (least & low).astype(np.int64)
    doc = np.repeat(np.arange(len(block)), np.diff(bounds))
    at = np.flatnonzero(doc[:n] == doc[length - 1 :])
    doc, anchor = doc[at], anchor[at]
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return doc[first], at[first], at[last] + length, anchor[first], grams


def merge_ranges(owner: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Union of the ranges of each owner, in order."""
    if not len(owner):
        return owner, start, end
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    # Owners are set apart on one line, so that a running maximum stays inside one.
    shift = owner * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + shift)
    new = np.ones(len(owner), bool)
    new[1:] = (start + shift)[1:] > reach[:-1]
    new[1:] |= owner[1:] != owner[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(owner)) - 1
    return owner[first], start[first], reach[last] - shift[first]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))


def _turns(rows: pa.RecordBatch) -> np.ndarray:
    """The order of a block's texts by (doc_id, tie); equal rows have equal turns."""
    keys = pd.DataFrame({"id": rows.column(0).to_pandas(), "tie": rows.column(1).to_numpy()})
    return keys.groupby(["id", "tie"], dropna=False).ngroup().to_numpy() if keys["id"].notna().all() else (
        _null_turns(keys))


def _null_turns(keys: pd.DataFrame) -> np.ndarray:
    null = keys["id"].isna()
    turn = np.empty(len(keys), np.int64)
    turn[null] = keys[null].groupby("tie").ngroup()
    turn[~null] = keys[~null].groupby(["id", "tie"]).ngroup() + len(keys)
    return turn


def removed_ranges(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, cell: int = CELL,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, tie, start, end`` of removed bytes; ranges may overlap.

    ``tie`` is the hash of the text. Runs jobs when called.
    """
    source = _source(docs, id_col, text_col)
    id_type = source.schema["doc_id"].dataType.simpleString()
    place = f"doc_id {id_type}, tie long, start int, size int"

    # Step 1: which grams occur more than once as an anchor.
    def anchors(block, rows):
        _, _, _, anchor, grams = stretches(block, length, gram)
        found, counts = np.unique(grams[anchor], return_counts=True)
        return {"gram": _signed(found), "n": counts} if len(found) else None

    busy = (map_blocks(source, "text", anchors, "gram long, n long").groupBy("gram")
            .agg(F.sum("n").alias("n")).filter("n > 1").select("gram"))
    sent = send_filter(busy)

    # Step 2. Within a block the first of equal stretches stands, in the order of
    # doc_id; the others are marked at once. Neighbouring marks make one range.
    def records(block, rows):
        doc, start, end, anchor, grams = stretches(block, length, gram)
        own = np.flatnonzero(passes(sent, _signed(grams[anchor])))
        if not len(own):
            return None
        doc, start, end, anchor = doc[own], start[own], end[own], anchor[own]
        name = PieceHash(block.data, _OTHER_BYTES)(start, end) ^ mix(anchor - start)
        at = start - block.bounds[doc]
        turn = _turns(rows)[doc]
        both = grams[anchor] ^ mix(name)
        rank = np.lexsort((at, turn, both))
        same = np.zeros(len(rank), bool)
        same[1:] = both[rank[1:]] == both[rank[:-1]]
        head = rank[np.maximum.accumulate(np.where(same, 0, np.arange(len(rank))))]
        # Equal rows hold the same places, which are no repeats of themselves.
        repeat = np.zeros(len(rank), bool)
        repeat[rank] = (turn[head] != turn[rank]) | (at[head] != at[rank])
        stays = np.flatnonzero(~repeat)
        owner, lo, hi = merge_ranges(doc[repeat], at[repeat], at[repeat] + (end - start)[repeat])
        blank = np.zeros(len(owner), np.int64)
        rows_of = np.concatenate([doc[stays], owner])
        return {
            "gram": np.concatenate([_signed(grams[anchor[stays]]), blank]),
            "name": np.concatenate([_signed(name[stays]), blank]),
            "doc_id": rows.column(0).take(rows_of), "tie": rows.column(1).take(rows_of),
            "start": np.concatenate([at[stays], lo]).astype(np.int32),
            "size": np.concatenate([(end - start)[stays], hi - lo]).astype(np.int32),
            "anchor": np.concatenate([(anchor - start)[stays], blank - 1]).astype(np.int32)}

    found = cut_lineage(map_blocks(
        source, "text", records, f"gram long, name long, {place}, anchor int"))
    ranged = ["doc_id", "tie", "start", (F.col("start") + F.col("size")).alias("end")]
    marked = found.filter("anchor < 0").select(*ranged)
    named = found.filter("anchor >= 0")
    spot = F.struct("doc_id", "tie", "start")
    first = named.groupBy("gram", "name").agg(F.min(spot).alias("first"), F.count("*").alias("n"))
    repeats = named.join(first.filter("n > 1"), ["gram", "name"])
    equal = repeats.filter(~spot.eqNullSafe(F.col("first"))).select(*ranged)

    # Step 3: the text of stretches whose gram has several names.
    dealt = (deal_pieces(source, named, length, gram, cell)
             .repartition("key").sortWithinPartitions("key", "doc_id", "tie", "start"))

    def sort_suffixes(batches):
        for batch in key_batches(batches, SORT_BYTES):
            yield from later_windows(batch, length)

    sorted_ = cut_lineage(dealt.mapInArrow(
        sort_suffixes, f"doc_id {id_type}, tie long, start int, end int, w long, w2 long"))
    differing = sorted_.filter("w IS NULL").select("doc_id", "tie", "start", "end")
    # Step 4: windows of crowded grams, each once for every partition that holds it.
    windows = sorted_.filter("w IS NOT NULL")
    least = (windows.groupBy("w", "w2").agg(F.min(spot).alias("first"), F.count("*").alias("n"))
             .filter("n > 1").select("w", "w2", "first"))
    crowded = windows.join(least, ["w", "w2"]).filter(~spot.eqNullSafe(F.col("first"))).select(
        "doc_id", "tie", "start", "end")
    return marked.unionByName(equal).unionByName(differing).unionByName(crowded)


def deal_pieces(source: DataFrame, named: DataFrame, length: int, gram: int, cell: int) -> DataFrame:
    """``key, crowded, doc_id, tie, start, bytes``: parts of stretches that differ.

    Equal windows of grams that are not crowded have equal keys.
    """
    id_type = source.schema["doc_id"].dataType.simpleString()
    mixed = (named.groupBy("gram").agg(F.min("name").alias("lo"), F.max("name").alias("hi"),
                                       F.ceil(F.count("*") / CROWD).cast("int").alias("shares"))
             .filter("lo != hi").select("gram", "shares"))
    stand = named.join(mixed, "gram").groupBy("gram", "name").agg(
        F.min(F.struct("doc_id", "tie", "start", "size", "anchor", "shares")).alias("s"))
    wanted = cut_lineage(stand.groupBy("s.doc_id", "s.tie").agg(
        F.collect_list(F.struct("s.start", "s.size", "s.anchor", "gram", "s.shares")).alias("parts")))
    near = send_filter(wanted.select("tie"))

    def likely(batches):
        for batch in batches:
            yield batch.filter(pa.array(passes(near, batch.column(1).to_numpy())))

    texts = source.mapInArrow(likely, source.schema).alias("s").join(
        wanted.alias("w"), F.col("s.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("s.tie") == F.col("w.tie")))

    def pieces(batches):
        for batch in batches:
            for block in blocks(batch.column(2)):
                rows = batch.slice(block.rows.start, len(block))
                lists = rows.column(3)
                parts = lists.flatten()
                start, size, anchor, gram_, shares = (
                    parts.field(c).to_numpy() for c in ("start", "size", "anchor", "gram", "shares"))
                doc = np.repeat(np.arange(len(block)), lists.value_lengths().to_numpy())
                key, start, size, part = cells(block.data, start + block.bounds[doc], size, anchor, gram_,
                                               length, gram, cell)
                doc, shares = doc[part], shares[part].astype(np.uint64)
                at = start - block.bounds[doc]
                tie = rows.column(1).to_numpy()[doc].view(np.uint64)
                key = np.where(shares > 1, mix(key + mix(mix(tie + mix(at)) % shares)), key)
                edges = np.append(0, np.cumsum(size)).astype(np.int32)
                bytes_ = block.data[ragged(start, size)]
                yield pa.RecordBatch.from_pydict({
                    "key": _signed(key), "crowded": shares > 1, "doc_id": rows.column(0).take(doc),
                    "tie": rows.column(1).take(doc), "start": at.astype(np.int32),
                    "bytes": pa.Array.from_buffers(pa.binary(), len(size), [
                        None, pa.py_buffer(edges), pa.py_buffer(bytes_)])})

    return texts.select("s.doc_id", "s.tie", "s.text", "parts").mapInArrow(
        pieces, f"key long, crowded boolean, doc_id {id_type}, tie long, start int, bytes binary")


def cells(raw: np.ndarray, start: np.ndarray, size: np.ndarray, anchor: np.ndarray, gram: np.ndarray,
          length: int, gram_size: int, cell: int):
    """``(key, start, size, stretch)``: parts of stretches by their windows' offset of the anchor.

    All windows whose anchor lies ``c .. c + cell - 1`` bytes behind their start have
    ``length - cell + 1`` bytes in common; the key is the hash of these and the gram's.
    """
    hashes = PieceHash(raw)
    place = start + anchor
    keys, starts, sizes, parts = [], [], [], []
    for c in range(0, length - gram_size + 1, cell):
        least = np.maximum(anchor - (size - length), c)
        most = np.minimum(anchor, c + cell - 1)
        own = np.flatnonzero(least <= most)
        at = place[own] - c
        core = hashes(at, at + length - cell + 1)
        keys.append(mix(core ^ gram[own].view(np.uint64)) + np.uint64(c))
        starts.append(place[own] - most[own])
        sizes.append(most[own] - least[own] + length)
        parts.append(own)
    return np.concatenate(keys), np.concatenate(starts), np.concatenate(sizes), np.concatenate(parts)


def key_batches(batches, limit: int):
    """Rows in the order of their key, gathered to about ``limit`` bytes of whole keys."""
    held, size = [], 0

    def whole():
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        while batch.num_rows:
            if held and size >= limit:
                keys = batch.column(0).to_numpy()
                other = np.flatnonzero(keys != held[-1].column(0)[-1].as_py())
                cut = int(other[0]) if len(other) else len(keys)
                held.append(batch.slice(0, cut))
                batch = batch.slice(cut)
                if batch.num_rows:
                    yield whole()
                    held, size = [], 0
            else:
                room = max(1, min(batch.num_rows, (limit - size) // 128 + 1))
                held.append(batch.slice(0, room))
                size += held[-1].get_total_buffer_size() * room // batch.num_rows if room == batch.num_rows else room * 128
                batch = batch.slice(room)
    if held:
        yield whole()


def later_windows(batch: pa.RecordBatch, length: int):
    """Ranges of the windows that equal an earlier one; rows are in the order of keys.

    Of crowded rows also the other windows, with two hashes each.
    """
    keys = batch.column(0).to_numpy()
    crowded = batch.column(1).to_numpy(zero_copy_only=False)
    # A key of one row has nothing to meet here.
    lone = np.ones(len(keys), bool)
    lone[1:] &= keys[1:] != keys[:-1]
    lone[:-1] &= keys[:-1] != keys[1:]
    stays = ~lone | crowded
    batch, crowded = batch.filter(pa.array(stays)), crowded[stays]
    if not batch.num_rows:
        return
    text, bounds = string_column(batch.column(5))
    text, bounds = text[bounds[0] : bounds[-1]], bounds - bounds[0]
    starts, sizes = bounds[:-1], np.diff(bounds)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = suffix_array(text)
    # Only windows inside one piece count; equal ones stay neighbours without the others.
    place = order[order + length <= bounds[1:][owner[order]]]
    run = np.cumsum(~equal_to_previous(text, place, length))
    own = owner[place]
    at = place - starts[own] + batch.column(4).to_numpy()[own]
    turn = _turns(pa.RecordBatch.from_arrays(batch.columns[2:4], names=["doc_id", "tie"]))
    by = np.lexsort((at, turn[own], run))
    same = np.zeros(len(by), bool)
    same[1:] = run[by[1:]] == run[by[:-1]]
    head = by[np.maximum.accumulate(np.where(same, 0, np.arange(len(by))))]
    # A place that is met twice, as equal rows' places are, is not its own repeat.
    gone = by[(turn[own[head]] != turn[own[by]]) | (at[head] != at[by])]

    def out(rows, lo, hi, w, w2):
        return pa.RecordBatch.from_pydict({
            "doc_id": batch.column(2).take(pa.array(rows)), "tie": batch.column(3).take(pa.array(rows)),
            "start": lo.astype(np.int32), "end": hi.astype(np.int32),
            "w": pa.array(w, pa.int64()), "w2": pa.array(w2, pa.int64())})

    if len(gone):
        rows, lo, hi = merge_ranges(own[gone], at[gone], at[gone] + length)
        yield out(rows, lo, hi, [None] * len(rows), [None] * len(rows))
    first = by[~same]
    first = first[crowded[own[first]]]
    if len(first):
        ends = place[first] + length
        yield out(own[first], at[first], at[first] + length,
                  _signed(PieceHash(text)(place[first], ends)),
                  _signed(PieceHash(text, _OTHER_BYTES)(place[first], ends)))


def cut_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                **options) -> DataFrame:
    """Every row with ``ranges``: its removed bytes as merged ``start, end`` pairs.

    Columns ``row`` (the input row), ``ranges``.
    """
    gone = (removed_ranges(docs, id_col=id_col, text_col=text_col, **options)
            .groupBy(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"))
            .agg(F.collect_list(F.struct("start", "end")).alias("ranges")))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.coalesce(F.col("row").getField(text_col), F.lit(""))
    return row.join(gone, F.col("row").getField(id_col).eqNullSafe(F.col("_id"))
                    & (F.xxhash64(text) == F.col("_tie")), "left").select("row", "ranges")


def kept_bytes(raw: bytes, ranges) -> tuple[bytes, int]:
    """What is left of a text, and the number of maximal removed runs."""
    if ranges is None or not len(ranges):
        return raw, 0
    start = np.array([r["start"] for r in ranges], np.int64)
    end = np.array([r["end"] for r in ranges], np.int64)
    _, lo, hi = merge_ranges(np.zeros(len(start), np.int64), start, end)
    out, at = [], 0
    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]]), len(lo)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                   **options) -> DataFrame:
    """The table with repeated bytes cut from its texts; a cut character goes whole."""
    found = cut_repeats(docs, id_col=id_col, text_col=text_col, **options)

    @F.pandas_udf("string")
    def left(texts: pd.Series, ranges: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or r is None
                          else kept_bytes(t.encode(), r)[0].decode(errors="ignore")
                          for t, r in zip(texts, ranges, strict=True)], dtype=object)

    own = F.col("row").getField(text_col)
    text = F.when(F.col("ranges").isNull(), own).otherwise(left(own, F.col("ranges")))
    return found.select(*[text.alias(c) if c == text_col else F.col("row").getField(c).alias(c)
                          for c in docs.columns])


_ORACLE = f"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
  p AS (SELECT doc_id, h, unnest(range(0, (length(h) // 2)::BIGINT)) AS i FROM d),
  w AS (SELECT doc_id, i, substr(h, 2 * i + 1, {2 * LENGTH}) AS s FROM p
        WHERE 2 * (i + {LENGTH}) <= length(h)),
  r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM w),
  g AS (SELECT DISTINCT doc_id, i + o AS i FROM (SELECT doc_id, i FROM r WHERE k > 1),
        unnest(range(0, {LENGTH})) AS u(o)),
  m AS (SELECT p.doc_id, p.i, substr(h, 2 * p.i + 1, 2) AS b, g.i IS NOT NULL AS gone
        FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.i = g.i),
  e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS edge FROM m),
  a AS (SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed,
        count(*) FILTER (edge) AS n_spans,
        coalesce(string_agg(b, '' ORDER BY i) FILTER (NOT gone), '') AS kept FROM e GROUP BY doc_id)
  SELECT d.doc_id, coalesce(n_bytes, 0)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
    coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
  FROM d LEFT JOIN a USING (doc_id)"""


@query("op5_repeat_removal", _ORACLE)
def op5_repeat_removal(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = cut_repeats(docs).select("row.doc_id", F.coalesce("row.text", F.lit("")).alias("text"), "ranges")

    def digest(batches):
        for batch in batches:
            total, removed, spans, sums = [], [], [], []
            for text, ranges in zip(batch.column(1), batch.column(2), strict=True):
                raw = text.as_buffer().to_pybytes()
                left, n = kept_bytes(raw, ranges.as_py())
                total.append(len(raw))
                removed.append(len(raw) - len(left))
                spans.append(n)
                sums.append(hashlib.sha256(left).hexdigest())
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "n_bytes": pa.array(total, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()),
                "kept_sha256": sums})

    id_type = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(digest, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, "
                            "kept_sha256 string")
