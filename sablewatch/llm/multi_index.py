"""Nearest neighbours by inner product through multi-index hashing.

1. Equal vectors are folded to one, which stands for all their ids.
2. *Codes.* The largest inner product is the least distance once each vector gets one
   more coordinate, the root of (largest norm squared - own norm squared); a query
   gets 0 there. A rotation learned on a bounded sample (principal directions, then
   turned so that signs keep most of the length) gives each vector a binary code of
   its signs.
3. *Index.* A code is cut into ``parts`` substrings; each vector is listed under
   every (number, substring).
4. *Search.* Codes within Hamming distance ``r`` of a query's agree with it in some
   substring up to ``r // parts`` bits (pigeonhole), so probing all substrings that
   near retrieves every code within ``r``. Lists and the queries that probe them meet
   in blocks of bounded size, where a pair is taken under the first list it shares.
   The lists that a query's own substrings name come first; their ``k``-th best score
   is its bound, and the probes that follow, up to ``probe_bits``, return only what
   reaches it. Scores are inner products of the original vectors in double precision.

A query that has found fewer than ``k`` neighbours in the end, while there are more
vectors, probes every list. Vectors that are null, zero, or hold null or
non-finite components take no part. A null id takes no part, neither as query nor as
candidate. Rows that repeat an id and vector count once. Fewer candidates than ``k``:
all of them. Extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sablewatch.llm.registry import query, table
from sablewatch.llm.storage import cut_lineage

K = 20
#: Bits of a code (at most 64), and substrings it is cut into.
BITS = 64
PARTS = 8
#: Vectors the rotation is learned on.
SAMPLE = 10_000
#: Most bits that a probed substring differs in: every code within distance 23.
PROBE_BITS = 2
#: Vectors, or queries, in a block.
BLOCK = 2_048


def learn_rotation(sample: np.ndarray, bits: int, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection whose signs are the code (iterative quantization)."""
    mean = sample.mean(axis=0) if len(sample) else np.zeros(sample.shape[1])
    centred = sample - mean
    _, _, axes = np.linalg.svd(centred.T @ centred)
    axes = axes[:bits].T
    rng = np.random.default_rng(5)
    if axes.shape[1] < bits:  # more bits than dimensions: random directions for the rest
        more = rng.normal(size=(axes.shape[0], bits - axes.shape[1]))
        axes = np.hstack([axes, more / np.linalg.norm(more, axis=0)])
    projected = centred @ axes
    turn, _ = np.linalg.qr(rng.normal(size=(bits, bits)))
    for _ in range(rounds):
        signs = np.where(projected @ turn >= 0, 1.0, -1.0)
        u, _, v = np.linalg.svd(signs.T @ projected)
        turn = (u @ v).T
    return mean, axes @ turn


def codes_of(vectors: np.ndarray, mean: np.ndarray, axes: np.ndarray) -> np.ndarray:
    bits = (vectors - mean) @ axes >= 0
    padded = np.zeros((len(bits), 64), np.uint8)
    padded[:, : bits.shape[1]] = bits
    return np.packbits(padded, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def substring(code: Column, part: int, bits: int, parts: int) -> Column:
    width = bits // parts
    return F.shiftrightunsigned(code, part * width).bitwiseAND(F.lit((1 << width) - 1))


def flips(width: int, upto: int) -> list[int]:
    """All masks of ``width`` bits with at most ``upto`` bits set."""
    return [sum(1 << i for i in chosen) for n in range(upto + 1) for chosen in combinations(range(width), n)]


def nearest(vectors: DataFrame, queries: Column, *, k: int = K, id_col: str = "vec_id",
            vector_col: str = "embedding", bits: int = BITS, parts: int = PARTS,
            sample: int = SAMPLE, probe_bits: int = PROBE_BITS) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the rows for which ``queries`` holds.

    Runs jobs when called.
    """
    spark = vectors.sparkSession
    values = F.col(vector_col).cast("array<double>")
    whole = (F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()
             & ~F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
             & F.exists(values, lambda x: x != 0))
    rows = (vectors.withColumn("_query", F.coalesce(queries, F.lit(False))).filter(whole)
            .select(F.col(id_col).alias("id"), values.alias("v"), "_query"))
    # Zeros of either sign are one value.
    rows = rows.withColumn("v", F.transform("v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)))
    rows = rows.withColumn("h", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v"))

    # Equal vectors: their k + 1 least ids are all that any query can want of them.
    ids = rows.select("h", "h2", "id").distinct()
    order = Window.partitionBy("h", "h2").orderBy("id")
    least = (ids.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
             .groupBy("h", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    single = rows.groupBy("h", "h2").agg(F.min("v").alias("v"))
    # Nodes are numbered by their least id, so that ties of scores go by node.
    folded = cut_lineage(single.join(least, ["h", "h2"]).withColumn(
        "norm", F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
        .orderBy(F.get("ids", F.lit(0)), "h", "h2").withColumn("node", F.monotonically_increasing_id()))

    stats = folded.agg(F.max("norm").alias("norm"), F.max(F.size("v")).alias("dim"), F.min(F.size("v")).alias("low"),
                       F.count("*").alias("n")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not stats.n:
        return spark.createDataFrame([], schema)
    if stats.dim != stats.low:
        raise ValueError("vectors of different length")
    largest = stats.norm

    def longer(flat: np.ndarray, norm: np.ndarray) -> np.ndarray:
        grid = flat.reshape(len(norm), -1)
        return np.hstack([grid, np.sqrt(np.maximum(largest - norm, 0))[:, None]])

    # At most `sample` vectors come to the driver.
    picked = folded.orderBy(F.xxhash64("h"), "h", "h2").limit(sample).select("v", "norm").toPandas()
    learned = longer(np.concatenate(picked["v"].to_numpy()), picked["norm"].to_numpy())
    mean, axes = learn_rotation(learned, bits)

    def encode(batches):
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            norm = batch.column(2).to_numpy()
            listed = codes_of(longer(flat, norm), mean, axes)
            # A query has no extra coordinate; its own length does not matter.
            asked = longer(flat, norm)
            asked[:, :-1] *= np.sqrt(largest / norm)[:, None]
            asked[:, -1] = 0
            yield pa.RecordBatch.from_pydict({
                "node": batch.column(0), "code": listed.view(np.int64),
                "asked": codes_of(asked, mean, axes).view(np.int64)})

    coded = cut_lineage(folded.select("node", "v", "norm").mapInArrow(
        encode, "node long, code long, asked long"))

    listed = folded.select("node", "v").join(coded.select("node", "code"), "node")
    wanted = rows.filter("_query").select("h", "h2").distinct()
    asking = cut_lineage(folded.join(wanted, ["h", "h2"], "left_semi").select("node", "v")
                         .join(coded.select("node", F.col("asked").alias("code")), "node"))
    width = bits // parts

    def lists(df: DataFrame, masks: list[int]) -> DataFrame:
        """Each row under every list it belongs to or probes, gathered in blocks."""
        under = F.array(*[F.struct(F.lit(i).alias("part"), substring(F.col("code"), i, bits, parts).alias("value"))
                          for i in range(parts)])
        spread = df.withColumn("e", F.explode(under)).withColumn(
            "value", F.explode(F.transform(F.array(*[F.lit(m).cast("long") for m in masks]),
                                           lambda m: F.col("e.value").bitwiseXOR(m)))
        ).withColumn("part", F.col("e.part")).drop("e")
        # One row per list: parts * 2**width of them, whatever the table's size.
        sizes = spread.groupBy("part", "value").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
        return (spread.join(F.broadcast(sizes), ["part", "value"])
                .groupBy("part", "value", F.pmod(F.xxhash64("node"), "blocks").alias("block"))
                .agg(F.collect_list(F.struct(*df.columns)).alias("rows")))

    index = cut_lineage(lists(listed.select("node", "code", "v"), [0]))

    def matches(asked: DataFrame, upto: int) -> DataFrame:
        """``node, other, score`` of pairs that meet under a list and reach the bound.

        ``asked`` has ``node, code, v, bound``; without a bound the best of each
        block are returned.
        """
        met = lists(asked, flips(width, upto)).select("part", "value", F.col("rows").alias("q")).join(
            index.select("part", "value", F.col("rows").alias("x")), ["part", "value"])

        def compare(batches):
            for batch in batches:
                for part, q, x in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                    q, x = q.values, x.values
                    left, right = _grid(q), _grid(x)
                    score = left @ right.T
                    apart = q.field("code").to_numpy().view(np.uint64)[:, None] ^ (
                        x.field("code").to_numpy().view(np.uint64)[None, :])
                    low = np.uint64((1 << width) - 1)
                    for i in range(part):  # met under an earlier list already
                        near = np.bitwise_count((apart >> np.uint64(width * i)) & low) <= upto
                        score[near] = -np.inf
                    bound = q.field("bound").to_numpy(zero_copy_only=False)
                    most = min(k + 6, score.shape[1])
                    best = -np.partition(-score, most - 1, axis=1)[:, most - 1]
                    floor = np.where(np.isnan(bound), best, bound)
                    # More than the products' rounding, so that no tie is lost to it.
                    reach = np.linalg.norm(left, axis=1) * np.linalg.norm(right, axis=1).max()
                    floor = floor - 1e-12 * reach
                    one, two = np.nonzero((score >= floor[:, None]) & (score > -np.inf))
                    node, other = q.field("node").to_numpy()[one], x.field("node").to_numpy()[two]
                    exact = _in_order(left, right, one, two)
                    # The best of the block for each query, ties to the smaller node.
                    order = np.lexsort((other, -exact, one))
                    nth = np.arange(len(order)) - np.searchsorted(one[order], one[order])
                    kept = order[nth < k + 6]
                    yield pa.RecordBatch.from_pydict({
                        "node": node[kept], "other": other[kept], "score": exact[kept]})

        return met.select("part", "q", "x").mapInArrow(compare, "node long, other long, score double")

    by_score = Window.partitionBy("node").orderBy(F.desc("score"), "other")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("n", F.row_number().over(by_score)).filter(F.col("n") <= k + 6)

    # A null bound means none: fewer than k + 1 vectors met so far.
    blank = F.lit(None).cast("double").alias("bound")
    first = cut_lineage(best(matches(asking.select("node", "code", "v", blank), 0)))
    bounds = first.filter(F.col("n") == k + 1).select("node", F.col("score").alias("bound"))
    bounded = asking.join(bounds, "node", "left").select("node", "code", "v", "bound")
    found = cut_lineage(best(matches(bounded, probe_bits)).drop("n"))
    counts = found.groupBy("node").agg(F.count("*").alias("n"))
    short = (asking.join(counts, "node", "left").filter(F.coalesce("n", F.lit(0)) < min(k + 1, stats.n))
             .select("node", "code", "v", blank))
    rest = matches(short, width)
    top = best(found.join(short.select("node"), "node", "left_anti").unionByName(rest)).select("node", "other")

    # The exact scores of what is left, and from vectors back to ids: ties to the
    # smaller id, a query's own row left out.
    own = folded.select("node", F.col("v").alias("x"))
    theirs = folded.select(F.col("node").alias("other"), F.col("v").alias("y"), "ids")
    spread = (top.join(own, "node").join(theirs, "other")
              .select("node", _inner("x", "y").alias("score"), F.explode("ids").alias("vec_id")))
    named = (rows.filter("_query").select("h", "h2", F.col("id").alias("query_id")).distinct()
             .join(folded.select("h", "h2", "node"), ["h", "h2"]).select("node", "query_id"))
    in_order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (named.join(spread, "node").filter("vec_id != query_id")
            .withColumn("rank", F.row_number().over(in_order).cast("int")).filter(F.col("rank") <= k)
            .select(F.col("query_id").cast("long"), "rank", F.col("vec_id").cast("long"), "score"))


def _grid(rows: pa.StructArray) -> np.ndarray:
    return rows.field("v").flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def _in_order(left: np.ndarray, right: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Products of the rows ``one`` and ``two``, summed from the first component to the last,
    as :func:`_inner` does: equal to it bit for bit."""
    out = np.zeros(len(one))
    for i in range(left.shape[1]):
        out += left[one, i] * right[two, i]
    return out


def _inner(x: str, y: str) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p)


@query("op4_multi_index_search")
def op4_multi_index_search(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
