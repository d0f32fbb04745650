"""Near-duplicate lines: a segment-partition join on edit distance.

A line of a document is removed if an earlier line (smaller doc_id, or the same
document and an earlier line) equals it or differs from it by at most ``tau`` edits
(inserted, deleted or replaced bytes of UTF-8). Lines are judged on the input, not
on what is left. Lines of fewer than ``min_bytes`` bytes always stay: they are too
short to tell anything.

1. Equal lines are folded to their first place.
2. Each distinct line is cut into ``tau + 1`` segments. Two lines within ``tau``
   edits share a whole segment, at places that differ by no more than the edits on
   either side allow. So each line is listed under (length, segment number, hash of
   segment), and probes the lists of every length from its own down to ``tau`` less
   with the few substrings that may match (multi-match-aware selection). Lines that
   meet no other line under any key are done.
3. The others are cut finer, into ``fine`` segments, and meet again under all but
   ``tau`` of them at once. A key names its earliest line, each line is compared
   with that one by a banded bit-parallel edit distance, and only lines without a
   match are then compared with the rest of their keys, pair by pair if these are few.
4. In a key of many lines (``PAIRS``), the segments left out are all that can differ.
   Each line lists what these become by up to ``tau`` bytes masked or dropped; two
   lines are within ``tau`` edits exactly if they list the same string with few enough
   bytes masked or dropped by both. The earliest line of each string is an aggregate,
   so a passage with any number of variants makes no pairs.

Null text: no lines, and it stays null. Null doc_id sorts first. Rows equal in id
and text are one document: each keeps the same lines. Column names of the table do
not matter; all columns are returned. A document without any line left has an
empty text.
"""

from __future__ import annotations

from itertools import combinations, product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sablewatch.llm.bits import passes, send_filter
from sablewatch.llm.blocks import Block, PieceHash, map_blocks, mix, ragged
from sablewatch.llm.registry import query, table
from sablewatch.llm.storage import cut_lineage
from sablewatch.llm.words import SEPARATOR

TAU = 1
MIN_BYTES = 40
#: Segments of the second, finer cut.
FINE = 8
#: Lines of a fine key up to which all its pairs are compared.
PAIRS = 64
#: Strings listed at a time for crowded keys, about.
LISTED = 1 << 19
_MASK, _SEAM = 256, 257
_TOKEN_VALUES = np.random.Generator(np.random.PCG64(41)).integers(1, 1 << 63, 258, dtype=np.uint64)
_OTHER_BYTES = np.random.Generator(np.random.PCG64(99)).integers(1, 1 << 63, 256, dtype=np.uint64)


def lines_of(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every line, and its text; an empty text has none."""
    data, bounds = block.data, block.bounds
    breaks = np.flatnonzero(data == 0x0A)
    filled = np.diff(bounds) > 0
    # A line starts with its text and after each newline of it, the last one too.
    doc = np.concatenate([np.flatnonzero(filled), np.searchsorted(bounds, breaks, "right") - 1])
    starts = np.concatenate([bounds[:-1][filled], breaks + 1])
    order = np.lexsort((starts, doc))
    starts, doc = starts[order], doc[order]
    ends = np.empty(len(starts), np.int64)
    ends[:-1] = starts[1:] - 1
    last = np.ones(len(starts), bool)
    last[:-1] = doc[1:] != doc[:-1]
    ends[last] = bounds[doc[last] + 1]
    return starts, ends, doc


def segment_edges(length: np.ndarray, tau: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Start and size of the ``tau + 1`` segments; later ones take the rest."""
    base, longer = length // (tau + 1), length % (tau + 1)
    out, at = [], np.zeros_like(length)
    for i in range(tau + 1):
        size = base + (i >= tau + 1 - longer)
        out.append((at, size))
        at = at + size
    return out


def probe_places(i: int, delta: int, tau: int) -> range:
    """Shifts against the segment's own place at which it may match.

    Of a line longer by ``delta``: at most ``i`` edits stand before segment ``i``
    (counted from 0), and at most ``tau - i`` after it.
    """
    return range(max(-i, delta - (tau - i)), min(i, delta + tau - i) + 1)


def coarse_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, tau: int):
    """``(key, line)``: one segment of ``tau + 1``, as listed and as probed."""
    hashes, length = PieceHash(data), ends - starts
    keys, lines = [], []
    for delta in range(tau + 1):
        other = length - delta
        which = np.flatnonzero(other > 0)
        for i, (at, size) in enumerate(segment_edges(other[which], tau)):
            # At delta 0, shift 0 is also the place where the line itself is listed.
            for shift in probe_places(i, delta, tau):
                place = at + shift
                fits = (place >= 0) & (place + size <= length[which])
                own = which[fits]
                begin = starts[own] + place[fits]
                keys.append(mix(hashes(begin, begin + size[fits]) ^ mix(other[own] * (tau + 1) + i)))
                lines.append(own)
    return np.concatenate(keys), np.concatenate(lines)


def fine_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, tau: int, fine: int):
    """``(key, line, gaps)``: all but ``tau`` of ``fine`` segments, as listed and as probed.

    ``gaps[:, j]`` is start and end of the ``j``-th segment left out, in the line.
    """
    hashes, length = PieceHash(data), ends - starts
    keys, lines, gaps = [], [], []
    for delta in range(tau + 1):
        other = length - delta
        which = np.flatnonzero(other >= fine)
        edges = [at for at, _ in segment_edges(other[which], fine - 1)] + [other[which]]
        for number, left_out in enumerate(combinations(range(fine), tau)):
            # Between two segments left out, text may have moved by the edits so far.
            for moves in product(range(-tau, tau + 1), repeat=tau - 1):
                moved = [0, *moves, delta]
                if sum(abs(y - x) for x, y in zip(moved, moved[1:], strict=False)) > tau:
                    continue
                key = mix(mix(other[which]) + np.uint64(number))
                fits = np.ones(len(which), bool)
                for lo, hi, move in zip([0, *(i + 1 for i in left_out)], [*left_out, fine], moved,
                                        strict=True):
                    begin, end = edges[lo] + move, edges[hi] + move
                    if lo < hi:
                        fits &= (begin >= 0) & (end <= length[which])
                        begin, end = np.maximum(begin, 0), np.minimum(end, length[which])
                        end = np.maximum(begin, end)
                        piece = hashes(starts[which] + begin, starts[which] + end)
                        key = mix(key + piece)
                keys.append(key[fits])
                lines.append(which[fits])
                gap = [[edges[out] + moved[j], edges[out + 1] + moved[j + 1]] for j, out in enumerate(left_out)]
                gaps.append(np.array(gap, np.int64).reshape(tau, 2, len(which)).transpose(2, 0, 1)[fits])
    return np.concatenate(keys), np.concatenate(lines), np.concatenate(gaps)


def gap_variants(data: np.ndarray, key: np.ndarray, begin: np.ndarray, end: np.ndarray, tau: int):
    """``(variant, row, dropped, left)``: what gaps become by up to ``tau`` edits.

    Row ``i`` has the gaps ``data[begin[i, j]:end[i, j]]``. A variant is the hash of the
    key and of the gaps with some bytes masked and some ``dropped``; ``left`` is how
    many may be dropped on the other side.
    """
    # The gaps of a row end to end, each closed by a token of its own.
    sizes = (end - begin).ravel()
    tokens = np.full(int(sizes.sum()) + len(sizes), _SEAM, np.int64)
    closing = np.cumsum(sizes + 1)
    tokens[ragged(closing - sizes - 1, sizes)] = data[ragged(begin.ravel(), sizes)]
    per_row = (sizes + 1).reshape(begin.shape).sum(axis=1)
    stop = np.cumsum(per_row)
    sums = PieceHash(tokens, _TOKEN_VALUES)
    powers = np.full(int(per_row.max()) + 1, np.uint64(0x9E3779B97F4A7C15))
    powers[0] = 1
    np.cumprod(powers, out=powers)

    def joined(value, size, lo, hi):
        """A hash with ``tokens[lo:hi]`` put behind it."""
        return value + (sums.prefix[hi] - sums.prefix[lo]) * sums.inverse[lo] * powers[size], size + hi - lo

    row = np.arange(len(key))
    value, size, at = np.zeros(len(key), np.uint64), np.zeros(len(key), np.int64), stop - per_row
    dropped, left = np.zeros(len(key), np.int32), np.full(len(key), tau, np.int32)
    out = []
    for edits in range(tau + 1):
        whole, n = joined(value, size, at, stop[row])
        out.append((mix(mix(whole + n.astype(np.uint64)) ^ key[row]), row, dropped, left))
        if edits == tau:
            break
        of = np.repeat(np.arange(len(row)), stop[row] - at)
        place = ragged(at, stop[row] - at)
        byte = tokens[place] != _SEAM
        of, place = of[byte], place[byte]
        value, size = joined(value[of], size[of], at[of], place)
        masked = value + _TOKEN_VALUES[_MASK] * powers[size]
        row, at = np.tile(row[of], 2), np.tile(place + 1, 2)
        value, size = np.concatenate([masked, value]), np.concatenate([size + 1, size])
        left = np.tile(left[of] - np.int32(1), 2)
        dropped = np.concatenate([dropped[of], dropped[of] + np.int32(1)])
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def within_edits(a: bytes, b: bytes, tau: int) -> bool:
    """Whether ``a`` becomes ``b`` by at most ``tau`` edits.

    Bit-parallel over diagonals: bit ``i`` of ``reach[d]`` says that ``a[:i]`` and
    ``b[:i+d]`` are within the edits spent so far; only the band |d| <= tau exists.
    """
    if abs(len(a) - len(b)) > tau:
        return False
    # What both share at either end needs no work.
    n = min(len(a), len(b))
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    differ = np.flatnonzero(x[:n] != y[:n])
    head = int(differ[0]) if len(differ) else n
    differ = np.flatnonzero(x[len(a) - n :][::-1] != y[len(b) - n :][::-1])
    tail = min(int(differ[0]) if len(differ) else n, n - head)
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if max(len(a), len(b)) <= tau:
        return True
    if not a or not b:
        return False
    full = (1 << (len(a) + 1)) - 1
    # same[d]: bit i is set if a[i] == b[i+d].
    same = {}
    for d in range(-tau, tau + 1):
        bits = 0
        for i in range(max(0, -d), min(len(a), len(b) - d)):
            if a[i] == b[i + d]:
                bits |= 1 << i
        same[d] = bits

    def spread(reach: int, d: int) -> int:
        # Equal bytes cost nothing.
        while (more := (reach | ((reach & same[d]) << 1)) & full) != reach:
            reach = more
        return reach

    limit = {d: ((1 << max(0, min(len(a), len(b) - d) + 1)) - 1) & ~((1 << max(0, -d)) - 1)
             for d in same}
    reach = {d: 0 for d in same}
    reach[0] = spread(1, 0)
    goal = len(b) - len(a)
    for _ in range(tau):
        if goal in reach and reach[goal] >> len(a) & 1:
            return True
        grown = {}
        for d in same:
            bits = reach[d] | reach[d] << 1  # keep, or replace a byte
            if d + 1 in reach:
                bits |= reach[d + 1] << 1  # drop a byte of a
            if d - 1 in reach:
                bits |= reach[d - 1]  # add a byte of b
            grown[d] = spread(bits & limit[d] & full, d)
        reach = grown
    return bool(reach[goal] >> len(a) & 1)


# --------------------------------------------------------------------------- #
# The join
# --------------------------------------------------------------------------- #

def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("tie"),
                       text.alias("text"))


def _worded_lines(block: Block, min_bytes: int):
    """Edges, text, number and two hashes of the lines with a word, and which are long."""
    starts, ends, doc = lines_of(block)
    number = np.arange(len(doc)) - np.searchsorted(doc, doc)
    filled = np.concatenate([[0], np.cumsum(~SEPARATOR[block.data])])
    own = filled[ends] > filled[starts]
    starts, ends, doc, number = (x[own] for x in (starts, ends, doc, number))
    first = PieceHash(block.data)(starts, ends)
    second = PieceHash(block.data, _OTHER_BYTES)(starts, ends)
    return starts, ends, doc, number, first, second, ends - starts >= min_bytes


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def removed_lines(docs: DataFrame, *, tau: int = TAU, min_bytes: int = MIN_BYTES, fine: int = FINE,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, tie, line, near`` of every line to remove.

    ``tie`` is the text's hash, ``line`` counts from 0, ``near`` tells lines that
    equal no earlier line from those that do. Runs jobs when called.
    """
    source = _source(docs, id_col, text_col)
    id_type = source.schema["doc_id"].dataType.simpleString()

    def scan(block, rows):
        starts, ends, doc, number, h, h2, long = _worded_lines(block, min_bytes)
        if not len(doc):
            return None
        # A line's keys come with its first row in the block.
        once = np.flatnonzero(long)
        once = once[np.unique(h[once], return_index=True)[1]]
        key, line = coarse_keys(block.data, starts[once], ends[once], tau) if len(once) else (h[:0], once)
        owner = once[line]
        order = np.argsort(owner, kind="stable")
        edges = np.searchsorted(owner[order], np.arange(len(doc) + 1)).astype(np.int32)
        return {"h": _signed(h), "h2": _signed(h2), "doc_id": rows.column(0).take(doc),
                "tie": rows.column(1).take(doc), "line": number,
                "keys": pa.ListArray.from_arrays(pa.array(edges), pa.array(_signed(key[order])))}

    # The texts are read once for all of this, and once more for what may have a partner.
    seen = cut_lineage(map_blocks(
        source, "text", scan, f"h long, h2 long, doc_id {id_type}, tie long, line long, keys array<long>"))
    place = F.struct("doc_id", "tie", "line").alias("place")
    occurrences = seen.select("h", "h2", place)
    first = cut_lineage(occurrences.groupBy("h", "h2")
                        .agg(F.min("place").alias("first"), F.count("*").alias("n")))
    repeats = occurrences.join(first.filter("n > 1").select("h", "h2", "first"), ["h", "h2"])
    equal = repeats.filter(~F.col("place").eqNullSafe(F.col("first"))).select(
        "place.*", F.lit(False).alias("near"))

    keys = seen.select("h", F.explode("keys").alias("key"))
    shared = (keys.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
              .filter("lo != hi").select("key"))
    partnered = cut_lineage(keys.join(shared, "key", "left_semi").select("h").distinct())
    sent = send_filter(partnered)

    def texts(block, rows):
        starts, ends, _, _, h, h2, long = _worded_lines(block, min_bytes)
        at = np.flatnonzero(long)
        at = at[passes(sent, _signed(h[at]))]
        at = at[np.unique(h[at], return_index=True)[1]]
        if not len(at):
            return None
        raw = block.data.tobytes()
        own = [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        return {"h": _signed(h[at]), "h2": _signed(h2[at]), "bytes": pa.array(own, pa.binary())}

    lines = (map_blocks(source, "text", texts, "h long, h2 long, bytes binary")
             .join(partnered, "h", "left_semi").dropDuplicates(["h", "h2"]))
    lines = cut_lineage(lines.join(first.select("h", "h2", "first"), ["h", "h2"]))

    def finer(batches):
        for batch in batches:
            raw = b"".join(batch.column(1).to_pylist())
            sizes = np.array([len(x) for x in batch.column(1).to_pylist()], np.int64)
            ends = np.cumsum(sizes)
            key, line, _ = fine_keys(np.frombuffer(raw, np.uint8), ends - sizes, ends, tau, fine)
            if len(key):
                yield pa.RecordBatch.from_pydict(
                    {"key": _signed(key), "h": batch.column(0).take(line)})

    fine_rows = lines.select("h", "bytes").mapInArrow(finer, "key long, h long")
    groups = cut_lineage(fine_rows.join(lines.select("h", "first"), "h"))
    heads = (groups.groupBy("key").agg(F.min(F.struct("first", "h")).alias("head"), F.count("*").alias("n"))
             .filter("n > 1").select("key", F.col("head.h").alias("other"), "n"))
    met = cut_lineage(groups.join(heads, "key").filter("h != other").select("key", "h", "other", "n"))

    def check(pairs: DataFrame) -> DataFrame:
        """``h, place`` of lines that are near an earlier line they are paired with."""
        mine = lines.select("h", F.col("bytes").alias("a"), F.col("first").alias("place"))
        theirs = lines.select(F.col("h").alias("other"), F.col("bytes").alias("b"),
                              F.col("first").alias("before"))
        both = (pairs.select("h", "other").distinct().join(mine, "h").join(theirs, "other")
                .filter(F.col("before") < F.col("place")))

        def near(batches):
            for batch in batches:
                a, b = batch.column(1).to_pylist(), batch.column(2).to_pylist()
                hit = pa.array([within_edits(x, y, tau) for x, y in zip(a, b, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(hit)], names=["h"])

        return both.select("h", "a", "b").mapInArrow(near, "h long").distinct()

    by_head = cut_lineage(check(met))
    # Lines that are not near the earliest line of a key may be near a later one.
    open_rows = cut_lineage(met.filter("n > 2").join(by_head, "h", "left_anti"))
    rest = met.filter(F.col("n") <= PAIRS).select("key", F.col("h").alias("other"))
    pairs = open_rows.select("key", "h").join(rest, "key").filter("h != other")

    crowded = open_rows.filter(F.col("n") > PAIRS).select("key").distinct()
    # A line has few keys: one per choice of segments and shifts.
    members = (met.join(crowded, "key", "left_semi").groupBy("h").agg(F.collect_set("key").alias("keys"))
               .join(lines.select("h", "bytes"), "h").select("h", "bytes", "keys"))

    def variants(batches):
        for batch in batches:
            raw = batch.column(1).to_pylist()
            sizes = np.array([len(x) for x in raw], np.int64)
            ends = np.cumsum(sizes)
            data = np.frombuffer(b"".join(raw), np.uint8)
            key, line, gaps = fine_keys(data, ends - sizes, ends, tau, fine)
            listed = batch.column(2)
            owner = np.repeat(np.arange(len(raw)), np.array([len(x) for x in listed], np.int64))
            wanted = listed.flatten().to_numpy().view(np.uint64) ^ mix(owner)
            own = np.flatnonzero(np.isin(key ^ mix(line), wanted) & (gaps[:, :, 0] <= gaps[:, :, 1]).all(axis=1))
            key, line, gaps = key[own], line[own], gaps[own] + (ends - sizes)[line[own], None, None]
            cost = np.cumsum((2 * (gaps[:, :, 1] - gaps[:, :, 0]).sum(axis=1) + 1).astype(float) ** tau)
            cuts = np.flatnonzero(np.diff(cost // LISTED)) + 1
            for some in np.split(np.arange(len(key)), cuts):
                if len(some):
                    variant, row, dropped, left = gap_variants(
                        data, key[some], gaps[some, :, 0], gaps[some, :, 1], tau)
                    yield pa.RecordBatch.from_pydict({
                        "variant": _signed(variant), "h": batch.column(0).take(pa.array(line[some][row])),
                        "dropped": dropped, "left": left})

    spread = members.mapInArrow(variants, "variant long, h long, dropped int, left int")
    common = (spread.groupBy("variant").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
              .filter("lo != hi").select("variant"))
    live = cut_lineage(spread.join(common, "variant", "left_semi").join(lines.select("h", "first"), "h"))
    best = live.groupBy("variant").agg(*[
        F.min(F.when(F.col("dropped") == d, F.struct("first", "h"))).alias(f"best{d}") for d in range(tau + 1)])
    earlier = F.coalesce(*[
        F.when((F.col("left") >= d) & (F.col(f"best{d}.first") < F.col("first")), F.col(f"best{d}.h"))
        for d in range(tau + 1)])
    told = (live.join(best, "variant").select("h", earlier.alias("other")).filter("other IS NOT NULL")
            .groupBy("h").agg(F.min("other").alias("other")))
    near = by_head.unionByName(check(pairs)).unionByName(check(told)).distinct().join(lines, "h")
    return equal.unionByName(near.select("first.*", F.lit(True).alias("near")))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                **options) -> DataFrame:
    """The table with the removed lines cut from its texts; all other columns stay."""
    gone = (removed_lines(docs, id_col=id_col, text_col=text_col, **options)
            .groupBy(F.col("doc_id").alias("_gone_id"), F.col("tie").alias("_gone_tie"))
            .agg(F.sort_array(F.collect_list("line")).alias("_gone")))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    own = F.col("row").getField(text_col)
    joined = row.join(gone, F.col("row").getField(id_col).eqNullSafe(F.col("_gone_id"))
                      & (F.xxhash64(own) == F.col("_gone_tie")), "left")

    @F.pandas_udf("string")
    def without(texts: pd.Series, gone: pd.Series) -> pd.Series:
        def cut(text: str, numbers: np.ndarray) -> str:
            lines = np.array(text.split("\n"), object)
            return "\n".join(np.delete(lines, numbers))

        return pd.Series([text if numbers is None else cut(text, numbers)
                          for text, numbers in zip(texts, gone, strict=True)], dtype=object)

    text = without(own, F.col("_gone"))
    return joined.select(*[text.alias(c) if c == text_col else F.col("row").getField(c).alias(c)
                           for c in docs.columns])


_ORACLE = r"""WITH l AS (
    SELECT doc_id, i AS line, ls[i] AS x FROM (
      SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text != ''),
      unnest(range(1, len(ls) + 1)) AS u(i)),
  n AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY doc_id, line) AS k
        FROM l WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
  f AS (SELECT doc_id, line, x, strlen(x) AS size, left(x, 8) AS head, right(x, 8) AS tail
        FROM n WHERE k = 1 AND strlen(x) >= 40),
  -- One edit leaves the first or the last bytes of a line as they are.
  p AS (SELECT a.doc_id, a.line, a.x, b.x AS y, a.size, b.size AS other FROM f a JOIN f b
        ON a.head = b.head AND (b.doc_id, b.line) < (a.doc_id, a.line)
      UNION ALL SELECT a.doc_id, a.line, a.x, b.x, a.size, b.size FROM f a JOIN f b
        ON a.tail = b.tail AND (b.doc_id, b.line) < (a.doc_id, a.line)),
  near AS (SELECT DISTINCT doc_id, line FROM p
        WHERE abs(size - other) <= 1 AND levenshtein(x, y) <= 1),
  c AS (SELECT doc_id, count(*) AS n_lines FROM l GROUP BY 1),
  e AS (SELECT doc_id, count(*) AS n FROM n WHERE k > 1 GROUP BY 1),
  m AS (SELECT doc_id, count(*) AS n FROM near GROUP BY 1)
  SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(e.n, 0)::BIGINT AS n_equal,
    coalesce(m.n, 0)::BIGINT AS n_near
  FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN e USING (doc_id) LEFT JOIN m USING (doc_id)"""


@query("op9_line_dedup", _ORACLE)
def op9_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    gone = removed_lines(docs).groupBy("doc_id", "tie").agg(
        F.count(F.when(~F.col("near"), 1)).alias("n_equal"), F.count(F.when(F.col("near"), 1)).alias("n_near"))
    text = F.col("text")
    lines = F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(
        F.length(text) - F.length(F.regexp_replace(text, "\n", "")) + 1).cast("long")
    rows = docs.select("doc_id", F.xxhash64("text").alias("tie"), lines.alias("n_lines"))
    joined = rows.alias("r").join(
        gone.alias("g"), F.col("r.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("r.tie") == F.col("g.tie")),
        "left")
    return joined.select("r.doc_id", "n_lines", F.coalesce("n_equal", F.lit(0)).alias("n_equal"),
                         F.coalesce("n_near", F.lit(0)).alias("n_near"))
