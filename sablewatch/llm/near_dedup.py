"""Near-duplicate documents by ProbMinHash, banding and verification.

A document is its weighted set of shingles of ``shingle`` words (weight: how often
it occurs; a text of fewer words is one shingle). Similarity is the probability
Jaccard index

    J(x, y) = sum over d of 1 / sum over e of max(x_e / x_d, y_e / y_d)

of the normalised weights, which for sets is the ordinary Jaccard index. 1 - J is a
metric, and ProbMinHash signatures agree in a register with probability J.

1. Equal texts are folded to one, represented by its least doc_id.
2. Signatures: each shingle arrives at random registers as a Poisson process whose
   rate is its weight; a register keeps the first arrival. A shingle's arrivals end
   once they are later than the latest first arrival of its document.
3. Registers are cut into bands; documents that share a band are candidates. Each
   is compared with its band's earliest document. Bands whose documents do not all
   fall into one class that way are compared in full, in blocks of ``BLOCK_BYTES``
   bytes, except inside classes, where no link could change the result; of the
   links that join a document to one class, one is enough.
4. Candidate pairs whose signatures agree often enough are verified on the whole
   texts, exactly. Classes are the connected components of the verified links.

A pair at the threshold shares a band with probability 0.9999, and falls below the
signatures' cut with probability 0.0003; pairs above it are lost more rarely still.

Null text: an empty one. Texts without words are near only to equal texts. Null
doc_id sorts first. Rows that repeat an id share their class only if their texts
are near. Extra columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sablewatch.llm.bits import passes, send_filter
from sablewatch.llm.blocks import Block, PieceHash, blocks, map_blocks, mix
from sablewatch.llm.registry import query, table
from sablewatch.llm.storage import cut_lineage
from sablewatch.llm.words import word_edges
from sablewatch.operators.components import connected_components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 25, 5
#: Agreement of signatures below which a pair is not verified: 3.4 standard
#: deviations under the threshold.
AGREE = 0.68
#: Bytes of shingles and signatures in a block of a full comparison, about.
BLOCK_BYTES = 512 << 10
#: Documents of a block whose signatures are compared with another block at a time.
ROWS_AT_ONCE = 64
_STEP = np.uint64(0x9FB21C651E98DF25)


def shingles(block: Block, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, shingle, count)`` of every distinct shingle of every text."""
    starts, ends, ranges = word_edges(block)
    words = PieceHash(block.data)(starts, ends)
    n_words = np.diff(ranges)
    doc = np.repeat(np.arange(len(block)), n_words)
    at = np.arange(len(words))
    # A text with fewer words than a shingle gives one shingle of them all.
    short = (n_words > 0) & (n_words < size)
    begins = (at + size <= ranges[doc + 1]) if len(words) else np.empty(0, bool)
    begins[ranges[:-1][short]] = True
    first = np.flatnonzero(begins)
    gram = np.zeros(len(first), np.uint64)
    for k in range(size):
        inside = first + k < ranges[doc[first] + 1]
        gram[inside] = mix(gram[inside] * _STEP + words[first[inside] + k])
    owner = doc[first]
    _, where, counts = np.unique(gram ^ mix(owner + 1), return_index=True, return_counts=True)
    return owner[where], gram[where], counts


def signatures(block: Block, size: int, registers: int) -> np.ndarray:
    """A row of ``registers`` 32-bit marks per text; 0 in texts without words."""
    owner, gram, weight = shingles(block, size)
    late = np.uint64(0xFFFFFFFFFFFFFFFF)
    table_ = np.full(len(block) * registers, late)
    time = np.zeros(len(owner))
    mark = gram >> np.uint64(32)
    live, turn = np.arange(len(owner)), 0
    while len(live):
        turn += 1
        draw = mix(mix(gram[live]) + np.uint64(turn))
        # Uniform in (0, 1] from the high bits, the register from a second mix.
        wait = -np.log(((draw >> np.uint64(11)) + np.uint64(1)) * 2.0**-53) / weight[live]
        time[live] += wait
        register = (mix(draw ^ _STEP) % np.uint64(registers)).astype(np.int64)
        bits = time[live].astype(np.float32).view(np.uint32).astype(np.uint64)
        np.minimum.at(table_, owner[live] * registers + register, (bits << np.uint64(32)) | mark[live])
        latest = (table_.reshape(-1, registers).max(axis=1) >> np.uint64(32)).astype(np.uint32)
        end = np.where(latest == 0xFFFFFFFF, np.inf, latest.view(np.float32).astype(np.float64))
        live = live[time[live] <= end[owner[live]]]
    table_[table_ == late] = 0
    return (table_ & np.uint64(0xFFFFFFFF)).astype(np.uint32).reshape(-1, registers)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """J of two weighted sets, each ``(ascending elements, weights)``."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    elements = np.union1d(a[0], b[0])
    x, y = np.zeros(len(elements)), np.zeros(len(elements))
    x[np.searchsorted(elements, a[0])] = a[1] / a[1].sum()
    y[np.searchsorted(elements, b[0])] = b[1] / b[1].sum()
    both = np.flatnonzero((x > 0) & (y > 0))
    # max(x_e/x_d, y_e/y_d) is y_e/y_d exactly where y_e/x_e > y_d/x_d.
    with np.errstate(divide="ignore"):
        ratio = np.where(x > 0, y / np.where(x > 0, x, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    sums_x = np.concatenate([[0.0], np.cumsum(x[order])])
    sums_y = np.concatenate([[0.0], np.cumsum(y[order])])
    upto = np.searchsorted(ratio[order], ratio[both], side="right")
    total = sums_x[upto] / x[both] + (sums_y[-1] - sums_y[upto]) / y[both]
    return float((1 / total).sum())


def plain_jaccards(a: tuple[np.ndarray, np.ndarray], others: list) -> np.ndarray:
    """J of one weighted set with each of several where no shingle of either repeats.

    There it is the Jaccard index, counted for all in one step; NaN for the others.
    """
    out = np.full(len(others), np.nan)
    if not len(a[0]) or a[1].max() > 1:
        return out
    plain = [j for j, (elements, counts) in enumerate(others) if len(elements) and counts.max() == 1]
    if plain:
        sizes = np.array([len(others[j][0]) for j in plain])
        every = np.concatenate([others[j][0] for j in plain])
        at = np.minimum(np.searchsorted(a[0], every), len(a[0]) - 1)
        both = np.add.reduceat((a[0][at] == every).astype(np.int64), np.cumsum(sizes) - sizes)
        out[plain] = both / (len(a[0]) + sizes - both)
    return out


def band_keys(marks: np.ndarray, bands: int) -> np.ndarray:
    """One key per band (columns) of every signature (rows)."""
    cut = marks.reshape(len(marks), bands, -1).astype(np.uint64)
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(marks), 1))
    for k in range(cut.shape[2]):
        key = mix(key * _STEP + cut[:, :, k])
    return key


def shingle_sets(column: pa.Array, size: int):
    """``(ascending shingles, counts)`` of every text of a column."""
    for block in blocks(column):
        owner, gram, count = shingles(block, size)
        order = np.lexsort((gram, owner))
        gram, count = gram[order], count[order]
        edges = np.searchsorted(owner[order], np.arange(len(block) + 1))
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            yield gram[lo:hi], count[lo:hi]


def _read_sets(rows: pa.StructArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """``(ascending shingles, counts)`` of rows with ``grams`` and ``counts``."""
    out = []
    for grams, counts in zip(rows.field("grams").to_pylist(), rows.field("counts").to_pylist(), strict=True):
        gram = np.frombuffer(grams, "<u8")
        out.append((gram, np.ones(len(gram), np.int64) if counts is None else np.frombuffer(counts, "<u4").astype(np.int64)))
    return out


def _root(roots: dict[int, int], node: int) -> int:
    """The name of a class after the joins noted in ``roots``; shortens the way to it."""
    while node in roots:
        up = roots[node]
        if up in roots:
            roots[node] = roots[up]
        node = up
    return node


def _marks(column: pa.Array, registers: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, registers)


def _agreeing(one: np.ndarray, two: np.ndarray, class_x: np.ndarray, class_y: np.ndarray,
              agree: float, bands: int, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(i, j, share)`` of signatures that agree, of different classes.

    A pair is judged in the first band it shares.
    """
    out = []
    for lo in range(0, len(one), ROWS_AT_ONCE):
        same = one[lo:lo + ROWS_AT_ONCE, None, :] == two[None, :, :]
        share = np.count_nonzero(same, axis=2) / one.shape[1]
        i, j = np.nonzero((share >= agree) & (class_x[lo:lo + ROWS_AT_ONCE, None] != class_y[None, :]))
        whole = same[i, j].reshape(len(i), bands, one.shape[1] // bands).all(axis=2)
        first = whole.argmax(axis=1) == band
        i, j = i[first], j[first]
        out.append((i + lo, j, share[i, j]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class NearDuplicates:
    """The tables of one run; ``classes()`` gives its result."""

    def __init__(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS,
                 rows: int = ROWS, agree: float = AGREE) -> None:
        self.size, self.threshold, self.agree = shingle, threshold, agree
        self.bands, self.registers = bands, bands * rows
        text = F.coalesce(F.col(text_col), F.lit(""))
        # Equal texts are told by 128 bits of hashes.
        self.source = docs.select(
            F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("t1"),
            F.xxhash64(F.lit(1), text, F.length(text)).alias("t2"), text.alias("text"))
        self.nodes = cut_lineage(self._sign())

    def _sign(self) -> DataFrame:
        """``node, doc_id, t1, t2, marks``: one row per distinct text."""
        size, registers = self.size, self.registers
        id_type = self.source.schema["doc_id"].dataType.simpleString()

        def sign(block, rows):
            marks = signatures(block, size, registers)
            return {"doc_id": rows.column(0), "t1": rows.column(1), "t2": rows.column(2),
                    "marks": [m.tobytes() for m in marks]}

        signed = map_blocks(self.source, "text", sign,
                            f"doc_id {id_type}, t1 long, t2 long, marks binary")
        folded = signed.groupBy("t1", "t2").agg(
            F.min(F.struct("doc_id")).alias("least"), F.min("marks").alias("marks"))
        return folded.select(F.monotonically_increasing_id().alias("node"),
                             F.col("least.doc_id").alias("doc_id"), "t1", "t2", "marks")

    def _texts(self, nodes: DataFrame) -> DataFrame:
        """``node, text`` of the given nodes, read from the documents again."""
        wanted = cut_lineage(nodes.select("node").distinct().join(
            self.nodes.select("node", "doc_id", "t1", "t2"), "node"))
        sent = send_filter(wanted.select("t1"))

        def wanted_rows(batches):
            for batch in batches:
                yield batch.filter(pa.array(passes(sent, batch.column(1).to_numpy())))

        kept = self.source.mapInArrow(wanted_rows, self.source.schema)
        same = kept["doc_id"].eqNullSafe(wanted["doc_id"]) & (kept["t1"] == wanted["t1"]) & (
            kept["t2"] == wanted["t2"])
        return kept.join(wanted, same).select("node", "text").dropDuplicates(["node"])

    def _sets(self, nodes: DataFrame) -> DataFrame:
        """``node, grams, counts`` of the given nodes: their shingles, cut once.

        ``counts`` is null where no shingle repeats.
        """
        size = self.size

        def cut(batches):
            for batch in batches:
                grams, counts = [], []
                for gram, count in shingle_sets(batch.column(1), size):
                    grams.append(gram.astype("<u8").tobytes())
                    counts.append(count.astype("<u4").tobytes() if len(count) and count.max() > 1 else None)
                yield pa.RecordBatch.from_pydict({
                    "node": batch.column(0), "grams": pa.array(grams, pa.binary()), "counts": pa.array(counts, pa.binary())})

        return self._texts(nodes).mapInArrow(cut, "node long, grams binary, counts binary")

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """Those of the distinct ``a, b`` pairs whose texts are similar enough."""
        ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
        sets = cut_lineage(self._sets(ends))
        side = lambda node, x: sets.select(F.col("node").alias(node), F.struct("grams", "counts").alias(x))
        both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
        threshold = self.threshold

        def verify(batches):
            for batch in batches:
                hit = [probability_jaccard(x, y) >= threshold - 1e-9
                       for x, y in zip(_read_sets(batch.column(2)), _read_sets(batch.column(3)), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [c.filter(pa.array(hit, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

        return both.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long")

    def components(self) -> DataFrame:
        """``node, component`` of every text."""
        bands, registers, agree = self.bands, self.registers, self.agree

        def cut(batches):
            for batch in batches:
                marks = _marks(batch.column(1), registers)
                worded = np.flatnonzero(marks.any(axis=1))
                if len(worded):
                    keys = band_keys(marks[worded], bands)
                    yield pa.RecordBatch.from_pydict({
                        "key": keys.ravel().view(np.int64),
                        "band": np.tile(np.arange(bands, dtype=np.int32), len(worded)),
                        "node": batch.column(0).take(np.repeat(worded, bands))})

        rows = self.nodes.select("node", "marks").mapInArrow(cut, "key long, band int, node long")
        ranked = rows.join(self.nodes.select("node", F.struct(F.struct("doc_id"), "node").alias("rank")), "node")
        shared = (ranked.groupBy("key").agg(F.min("rank").alias("head"), F.count("*").alias("n"))
                  .filter("n > 1").select("key", F.col("head.node").alias("head"), "n"))
        members = cut_lineage(rows.join(shared, "key"))
        near = members.filter("node != head").select(F.col("node").alias("a"), F.col("head").alias("b"))
        signs = self.nodes.select("node", "marks")

        def agreeing(batches):
            for batch in batches:
                same = (_marks(batch.column(2), registers) == _marks(batch.column(3), registers)).mean(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [c.filter(pa.array(same >= agree)) for c in batch.columns[:2]], names=["a", "b"])

        pairs = (near.distinct().join(signs.select(F.col("node").alias("a"), F.col("marks").alias("x")), "a")
                 .join(signs.select(F.col("node").alias("b"), F.col("marks").alias("y")), "b")
                 .select("a", "b", "x", "y").mapInArrow(agreeing, "a long, b long"))
        by_head = cut_lineage(self._verified(cut_lineage(pairs)))
        by_node = self.nodes.select("node").join(connected_components(by_head), "node", "left").select(
            "node", F.coalesce("component", "node").alias("class"))
        classes = cut_lineage(by_node)
        # Classes are joined by name, so that no link is followed twice.
        joined = connected_components(self._between_classes(members, classes))
        return classes.join(joined.withColumnRenamed("node", "class"), "class", "left").select(
            "node", F.coalesce("component", "class").alias("component"))

    def _between_classes(self, members: DataFrame, classes: DataFrame) -> DataFrame:
        """Classes ``a, b`` with a verified link between documents of one band."""
        bands, registers, agree = self.bands, self.registers, self.agree
        threshold = self.threshold
        placed = cut_lineage(members.filter("n > 2").join(classes, "node").select(
            "key", "band", "node", "head", "n", "class"))
        heads = placed.filter("node = head").select("key", F.col("class").alias("head_class"))
        open_keys = (placed.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi"))
                     .filter("lo != hi").select("key"))
        opened = cut_lineage(placed.join(open_keys, "key", "left_semi").join(heads, "key"))
        size = F.length("grams") + F.coalesce(F.length("counts"), F.lit(0)) + 4 * registers
        sets = cut_lineage(self._sets(opened).withColumn("bytes", size))
        parts = (opened.join(sets.select("node", "bytes"), "node").groupBy("key")
                 .agg(F.ceil(F.sum("bytes") / BLOCK_BYTES).alias("parts")))
        full = (opened.join(parts, "key").join(self.nodes.select("node", "marks"), "node").join(sets, "node")
                .withColumn("part", F.pmod(F.xxhash64("node"), "parts")))
        # What is not of its head's class meets all blocks of the band.
        entry = F.struct("node", "class", "marks", "grams", "counts")
        whole = full.groupBy("key", "band", "part").agg(F.collect_list(entry).alias("right"))
        odd = (full.filter(F.col("class") != F.col("head_class"))
               .groupBy("key", F.col("part").alias("odd")).agg(F.collect_list(entry).alias("left")))

        def compare(batches):
            roots: dict[int, int] = {}  # an entry for each link this task returns
            for batch in batches:
                a, b = [], []
                for band, left, right in zip(*batch.columns, strict=True):
                    x, y, band = left.values, right.values, band.as_py()
                    one, two = (_marks(v.field("marks"), registers) for v in (x, y))
                    class_x, class_y = (v.field("class").to_numpy() for v in (x, y))
                    i, j, share = _agreeing(one, two, class_x, class_y, agree, bands, band)
                    if not len(i):
                        continue
                    order = np.lexsort((-share, i))
                    i, j = i[order], j[order]
                    sets_x, sets_y = _read_sets(x), _read_sets(y)
                    for mine in np.split(j, np.flatnonzero(np.diff(i)) + 1):
                        at = i[0]
                        i = i[len(mine):]
                        # Classes that this task has joined by links need no other link.
                        own = _root(roots, class_x[at])
                        mine = [k for k in mine.tolist() if _root(roots, class_y[k]) != own]
                        score = plain_jaccards(sets_x[at], [sets_y[k] for k in mine])
                        for k, like in zip(mine, score.tolist(), strict=True):
                            other = _root(roots, class_y[k])
                            if other == _root(roots, class_x[at]):
                                continue
                            if like != like:  # NaN: a shingle repeats
                                like = probability_jaccard(sets_x[at], sets_y[k])
                            if like >= threshold - 1e-9:
                                roots[other] = _root(roots, class_x[at])
                                a.append(class_x[at])
                                b.append(class_y[k])
                if a:
                    yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        met = odd.join(whole, "key").select("band", "left", "right")
        return met.mapInArrow(compare, "a long, b long").distinct()

    def classes(self) -> DataFrame:
        """``doc_id, class_id, class_size, kept`` of every row of the documents.

        The class is named by the least doc_id in it; the first row of that id and
        text order is kept, so each class keeps one row.
        """
        # The best of a component and the rows of it both read this table.
        own = cut_lineage(self.nodes.select("node", "doc_id", "t1", "t2").join(self.components(), "node"))
        best = own.groupBy("component").agg(F.min(F.struct(F.struct("doc_id"), "node")).alias("best"))
        named = own.join(best, "component").select(
            "t1", "t2", F.col("best.col1.doc_id").alias("class_id"),
            (F.col("node") == F.col("best.node")).alias("chosen"), F.col("doc_id").alias("least"))
        rows = self.source.select("doc_id", "t1", "t2")
        return rows.join(named, ["t1", "t2"]).select(
            "doc_id", "t1", "t2", "class_id",
            (F.col("chosen") & F.col("doc_id").eqNullSafe(F.col("least"))).alias("kept"))


def near_duplicate_classes(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, class_id, kept`` of every row; see :class:`NearDuplicates`."""
    return NearDuplicates(docs, **options).classes().select("doc_id", "class_id", "kept")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The table with one row of every class: equal rows of the kept text are one."""
    found = NearDuplicates(docs, id_col=id_col, text_col=text_col, **options).classes()
    kept = found.filter("kept").select(
        F.col("doc_id").alias("_kept_id"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2")).distinct()
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.coalesce(F.col("row").getField(text_col), F.lit(""))
    same = (F.col("row").getField(id_col).eqNullSafe(F.col("_kept_id")) & (F.xxhash64(text) == F.col("_t1"))
            & (F.xxhash64(F.lit(1), text, F.length(text)) == F.col("_t2")))
    # An id is the name of a class, so rows that repeat id and text are told apart last.
    # Of rows that repeat id and text the one whose other columns hash least stays; a map
    # has no hash, so it counts as JSON.
    plain = [F.to_json(f"row.`{f.name}`") if "map<" in f.dataType.simpleString() else F.col(f"row.`{f.name}`")
             for f in docs.schema if f.name != text_col]
    repeats = Window.partitionBy("_kept_id", "_t1", "_t2").orderBy(F.xxhash64(*plain), F.hash(*plain))
    chosen = row.join(kept, same).withColumn("_n", F.row_number().over(repeats))
    return chosen.filter("_n = 1").select("row.*")


@query("op3_near_dedup")
def op3_near_dedup(spark, sf_dir):
    return near_duplicate_classes(table(spark, sf_dir, "documents"))
