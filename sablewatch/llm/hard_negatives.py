"""Hard negatives by rotated one-bit codes with exact intervals.

For each anchor: its positives are the best rows of its own label; for each positive,
the negatives are the best rows of other labels whose score lies between two shares of
the positive's. A score is the inner product of integer vectors.

1. *Codes.* A random rotation of the vectors, padded with zeros to ``bits`` coordinates,
   is kept as signs only. Turned back, the sign vector of x is a direction u; stored
   with the code are its length, the alignment ``a`` = <x, u/|u|> and |x|.
2. *Estimates.* The anchor's rotated vector is rounded to ``PLANES`` bits a coordinate;
   its product with a sign vector is a sum of popcounts of (code AND bit plane). That
   gives b, the anchor's part along u/|u|, up to a known rounding error.
3. *Intervals.* Apart from a * b, the score is the product of two parts at right angles
   to u, at most sqrt(|x|^2 - a^2) * sqrt(|q|^2 - b^2) (Cauchy-Schwarz). So the score
   surely lies in an interval; nothing here is a probability.
4. *Scores.* The best few estimates are scored in integers first; of the rest only
   those whose interval reaches the bound so found, and which may lie in a wanted
   window, are scored too, in integers. Results are exact.

Vectors lie in blocks of about ``BLOCK`` rows by label group and hash of the id, anchors
in blocks of ``ANCHORS``. For positives, blocks of anchors meet the blocks of their label
group; for negatives, with their windows, all blocks. A pair of blocks is compared in
one task and returns, per anchor, no more rows than are wanted, so that a label with a
third of all rows only has more blocks. All anchors against all rows is what is asked.

A null id, label or vector, or a vector with a null or non-finite component, takes no
part. Rows that repeat id, label and vector count once; "other rows" have another id.
Ties go to the smaller id. Vectors of different length are read as if the shorter ended
in zeros; empty and zero vectors score 0. No positive, or no row in a window: no rows.
A score times 100 must fit 64 bits, else the job stops with an error. Extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sablewatch.llm.registry import query, table
from sablewatch.llm.storage import cut_lineage

#: Code bits for each dimension; a code is a multiple of 64 bits.
BITS_PER_DIMENSION = 4
#: Bit planes of a rounded anchor.
PLANES = 6
#: Vectors, and anchors, in a block.
BLOCK = 4_096
ANCHORS = 256
#: Label groups; a group of many rows is many blocks.
GROUPS = 64
#: Best estimates that are scored to find a bound.
SEEDS = 32
#: Anchors compared at a time.
TILE = 32

_ITEM = ("id", "label", "v", "code", "norm", "along", "length")
_RESULT = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, "
           "negative_score long")


# --------------------------------------------------------------------------- #
# Codes and intervals
# --------------------------------------------------------------------------- #

def rotation(dim: int, bits: int) -> np.ndarray:
    """``bits x dim`` with orthonormal columns: a random turn of zero-padded vectors."""
    return np.linalg.qr(np.random.default_rng(12).normal(size=(bits, dim)))[0]


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, ...]:
    """Codes as 64-bit words, |x|, the alignment with the code's direction, its length."""
    x = vectors.astype(np.float64)
    positive = x @ turn.T >= 0
    code = np.packbits(positive, axis=1, bitorder="little").view("<u8")
    direction = (2.0 * positive - 1.0) @ turn
    length = np.linalg.norm(direction, axis=1)
    along = np.einsum("ij,ij->i", x, direction) / np.maximum(length, 1e-300)
    return code, np.linalg.norm(x, axis=1), along, length


class Anchors:
    """Anchors as rounded bit planes."""

    def __init__(self, vectors: np.ndarray, turn: np.ndarray) -> None:
        turned = vectors.astype(np.float64) @ turn.T
        self.norm = np.linalg.norm(vectors.astype(np.float64), axis=1)
        self.low = turned.min(axis=1)
        self.step = np.maximum(turned.max(axis=1) - self.low, 1e-300) / (2**PLANES - 1)
        level = np.rint((turned - self.low[:, None]) / self.step[:, None])
        rounded = self.low[:, None] + self.step[:, None] * level
        #: Most that rounding changes the product with any vector of signs.
        self.error = np.abs(turned - rounded).sum(axis=1)
        self.total = rounded.sum(axis=1)
        bits = (level.astype(np.uint8)[:, None, :] >> np.arange(PLANES, dtype=np.uint8)[:, None]) & 1
        self.planes = np.packbits(bits, axis=2, bitorder="little").view("<u8")

    def intervals(self, which: slice, code: np.ndarray, norm: np.ndarray, along: np.ndarray,
                  length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Estimates and sure lower and upper bounds of anchors x vectors."""
        planes = self.planes[which]
        weighted = np.zeros((len(planes), len(code)), np.int32)
        for p in range(PLANES):
            counted = np.zeros(weighted.shape, np.uint16)
            for w in range(code.shape[1]):
                counted += np.bitwise_count(planes[:, p, w, None] & code[None, :, w])
            weighted += counted.astype(np.int32) << p
        ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
        chosen = self.low[which, None] * ones + self.step[which, None] * weighted
        unit = 1 / np.maximum(length, 1e-300)
        part = (2 * chosen - self.total[which, None]) * unit
        error = self.error[which, None] * unit
        own = self.norm[which, None]
        across = np.sqrt(np.maximum(norm**2 - along**2, 0))
        rest = np.sqrt(np.maximum(own**2 - np.maximum(np.abs(part) - error, 0) ** 2, 0))
        estimate = along * part
        # The last term covers the rounding of doubles.
        reach = np.abs(along) * error + across * rest + 1e-9 * (1 + own * norm)
        return estimate, estimate - reach, estimate + reach


def first_by_score(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best, ties to the smaller id."""
    if len(score) > 4 * k:
        floor = -np.partition(-score, k - 1)[k - 1]
        at = np.flatnonzero(score >= floor)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))[:k]]


def kth_best(score: np.ndarray, k: int) -> float:
    return -np.partition(-score, k - 1)[k - 1] if len(score) >= k else -np.inf


# --------------------------------------------------------------------------- #
# Comparing two blocks
# --------------------------------------------------------------------------- #

class Side:
    """A block's rows as arrays."""

    def __init__(self, rows: pa.StructArray, dim: int) -> None:
        self.rows = rows
        field = lambda name: rows.field(name).to_numpy(zero_copy_only=False)
        self.id, self.label = field("id"), field("label")
        self.v = _padded(rows.field("v"), dim)
        self.norm, self.along, self.length = field("norm"), field("along"), field("length")
        code = rows.field("code").to_pylist()
        self.code = np.frombuffer(b"".join(code), "<u8").reshape(len(code), -1)


def best_positives(anchor: Side, other: Side, turn: np.ndarray, k: int):
    """``(anchor row, other row, score)`` of each anchor's ``k`` best of its label."""
    for i, estimate, _, upper in _tiles(anchor, other, turn):
        usable = (other.label == anchor.label[i]) & (other.id != anchor.id[i])
        at = np.flatnonzero(usable)
        if not len(at):
            continue
        seeds = at[np.argsort(-estimate[at])[:SEEDS]] if len(at) > SEEDS else at
        bound = kth_best(other.v[seeds] @ anchor.v[i], k)
        live = at[upper[at] >= bound]
        score = other.v[live] @ anchor.v[i]
        top = first_by_score(score, other.id[live], k)
        yield i, live[top], score[top]


def best_negatives(anchor: Side, other: Side, turn: np.ndarray, windows: list, k: int):
    """The same for rows of other labels: the ``k`` best inside each window."""
    for i, estimate, lower, upper in _tiles(anchor, other, turn):
        own = windows[i]
        low, high = min(w[0] for w in own), max(w[1] for w in own)
        at = np.flatnonzero((other.label != anchor.label[i]) & (other.id != anchor.id[i])
                            & (upper >= low) & (lower <= high))
        if not len(at):
            continue
        # Estimates just below the highest end are the likeliest to be first.
        order = np.argsort(-np.where(estimate[at] <= high, estimate[at], -np.inf))
        tried = other.v[at[order[:SEEDS]]] @ anchor.v[i]
        bound = min(max(lo, kth_best(tried[(tried >= lo) & (tried <= hi)], k)) for lo, hi in own)
        live = at[upper[at] >= bound]
        score = other.v[live] @ anchor.v[i]
        found = []
        for lo, hi in own:
            inside = np.flatnonzero((score >= lo) & (score <= hi))
            found.append(inside[first_by_score(score[inside], other.id[live[inside]], k)])
        found = np.unique(np.concatenate(found))
        yield i, live[found], score[found]


def _tiles(anchor: Side, other: Side, turn: np.ndarray):
    if 100 * anchor.norm.max() * other.norm.max() >= 2.0**62:
        raise ValueError("scores of these vectors need more than 64 bits")
    rounded = Anchors(anchor.v, turn)
    for first in range(0, len(anchor.id), TILE):
        which = slice(first, min(first + TILE, len(anchor.id)))
        estimate, lower, upper = rounded.intervals(which, other.code, other.norm, other.along, other.length)
        for n, i in enumerate(range(which.start, which.stop)):
            yield i, estimate[n], lower[n], upper[n]


# --------------------------------------------------------------------------- #
# Spark
# --------------------------------------------------------------------------- #

def mine_hard_negatives(vectors: DataFrame, anchors: Column, *, positives: int = 5, negatives: int = 3,
                        low_percent: int = 50, high_percent: int = 95, id_col: str = "vec_id",
                        label_col: str = "label", vector_col: str = "embedding",
                        bits: int | None = None) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors`` holds integer vectors (array of long); ``anchors`` says which rows are
    anchors. Runs jobs when called.
    """
    spark = vectors.sparkSession
    rows = (vectors.withColumn("_anchor", F.coalesce(anchors, F.lit(False)))
            .select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                    F.col(vector_col).cast("array<long>").alias("v"), "_anchor")
            .filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
                    & ~F.exists("v", lambda x: x.isNull()))
            .groupBy("id", "label", "v").agg(F.max("_anchor").alias("anchor")))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("label"), F.lit(GROUPS)).cast("int"))
    single = cut_lineage(rows)
    # At most GROUPS rows.
    groups = {r.part: r for r in single.groupBy("part").agg(
        F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).collect()}
    if not groups:
        return spark.createDataFrame([], _RESULT)
    dim = max(1, *(r.dim for r in groups.values()))
    turn_bits = bits or 64 * max(1, -(-BITS_PER_DIMENSION * dim // 64))
    turn_bits = max(turn_bits, 64 * -(-dim // 64))

    def code(batches):
        turn = rotation(dim, turn_bits)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("v"))
            grid = _padded(lists, dim)
            words, norm, along, length = encode(grid, turn)
            raw, width = words.tobytes(), 8 * words.shape[1]
            extra = {"code": pa.array([raw[i : i + width] for i in range(0, len(raw), width)], pa.binary()),
                     "norm": norm, "along": along, "length": length}
            yield pa.RecordBatch.from_pydict(
                {n: batch.column(i) for i, n in enumerate(batch.schema.names)} | extra)

    coded = cut_lineage(single.mapInArrow(
        code, "id long, label long, v array<long>, anchor boolean, part int, code binary, norm double, "
        "along double, length double").withColumn("node", F.monotonically_increasing_id()))

    # Blocks are numbered through all groups; a group's are consecutive.
    first, count, total = {}, {}, 0
    for part in sorted(groups):
        first[part], count[part] = total, -(-groups[part].n // BLOCK)
        total += count[part]
    pick = lambda found: F.create_map(*[F.lit(x) for kv in found.items() for x in kv])[F.col("part")]
    item = F.struct(*_ITEM)
    index = cut_lineage(
        coded.withColumn("block", pick(first) + F.pmod(F.xxhash64("id"), pick(count)).cast("int"))
        .groupBy("block").agg(F.collect_list(item).alias("x")))

    asking = coded.filter("anchor")
    # At most GROUPS rows.
    asked = {r.part: r.n for r in asking.groupBy("part").agg(F.count("*").alias("n")).collect()}
    if not asked:
        return spark.createDataFrame([], _RESULT)

    def anchor_blocks(df: DataFrame, lots: Column, blocks: Column, *more: str) -> DataFrame:
        """Anchors in lots of about ANCHORS, a row for each block of vectors to meet."""
        return (df.groupBy("part", F.pmod(F.xxhash64("node"), lots).alias("own"))
                .agg(F.collect_list(F.struct(*_ITEM, "node", *more)).alias("q"))
                .withColumn("block", F.explode(blocks)).select("block", "q"))

    def meet(blocks: DataFrame, compare, schema: str) -> DataFrame:
        def run(batches):
            turn = rotation(dim, turn_bits)
            for batch in batches:
                for q, x in zip(batch.column(0), batch.column(1), strict=True):
                    asked, other = Side(q.values, dim), Side(x.values, dim)
                    node = q.values.field("node").to_numpy()
                    found = [(node[i], other.id[at], score) for i, at, score in compare(asked, other, turn)]
                    if found:
                        yield pa.RecordBatch.from_pydict({
                            "node": np.repeat([n for n, _, _ in found], [len(s) for _, _, s in found]),
                            "other": np.concatenate([i for _, i, _ in found]),
                            "score": np.concatenate([s for _, _, s in found])})

        return blocks.join(index, "block").select("q", "x").mapInArrow(run, schema)

    schema = "node long, other long, score long"
    lots = pick({part: -(-n // ANCHORS) for part, n in asked.items()})
    same = F.sequence(pick(first), pick(first) + pick(count) - 1)
    met = meet(anchor_blocks(asking, lots, same),
               lambda q, x, turn: best_positives(q, x, turn, positives), schema)
    order = Window.partitionBy("node").orderBy(F.desc("score"), "other")
    chosen = cut_lineage(met.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= positives)
                         .withColumnRenamed("other", "positive_id").withColumnRenamed("score", "positive_score"))

    # The least and greatest integer score of a window.
    share = "positive_score * {0}"
    low = F.expr(f"({share} + pmod(-{share}, 100)) div 100".format(low_percent))
    high = F.expr(f"({share} - pmod({share}, 100)) div 100".format(high_percent))
    windows = (chosen.withColumn("low", low).withColumn("high", high).filter("low <= high")
               .groupBy("node").agg(F.collect_list(F.struct("low", "high")).alias("windows")))
    wanted = asking.join(windows, "node")

    def negatives_of(q: Side, x: Side, turn: np.ndarray):
        listed = [[(w["low"], w["high"]) for w in own] for own in q.rows.field("windows").to_pylist()]
        return best_negatives(q, x, turn, listed, negatives)

    every = F.sequence(F.lit(0), F.lit(total - 1))
    found = meet(anchor_blocks(wanted, lots, every, "windows"), negatives_of, schema).select(
        "node", F.col("other").alias("negative_id"), F.col("score").alias("negative_score"))
    names = asking.select("node", F.col("id").alias("anchor_id"))
    inside = ((F.col("negative_score") * 100 >= F.col("positive_score") * low_percent)
              & (F.col("negative_score") * 100 <= F.col("positive_score") * high_percent))
    by_score = Window.partitionBy("node", "nth").orderBy(F.desc("negative_score"), "negative_id")
    return (found.join(chosen, "node").filter(inside)
            .withColumn("rank", F.row_number().over(by_score).cast("int")).filter(F.col("rank") <= negatives)
            .join(names, "node")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def _padded(lists: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows of a grid, ended by zeros."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), dim), np.int64)
    at = np.repeat(np.arange(len(lists)), sizes)
    out[at, np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
    return out


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label,
         CAST(coalesce(list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positive AS (
  SELECT * FROM scored WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score,
       n.score AS negative_score, CAST(row_number() OVER (
         PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank
FROM positive p JOIN scored n ON n.anchor_id = p.anchor_id AND n.label <> p.anchor_label
 AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3
"""


@query("op12_hard_negatives", ORACLE)
def op12_hard_negatives(spark, sf_dir):
    values = F.col("embedding").cast("array<double>")
    rows = table(spark, sf_dir, "embeddings").filter(~F.exists(
        values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = rows.select("vec_id", moved.alias("label"),
                        F.transform(values, lambda x: F.floor(x * 256)).alias("embedding"))
    return mine_hard_negatives(whole, F.col("vec_id") % 50 == 0)
