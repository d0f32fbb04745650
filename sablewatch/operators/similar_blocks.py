"""Pairs of items at or above a similarity, compared in blocks of the holders of a value.

A value that many items hold would be joined into one row per pair of holders. Here its
holders are dealt into blocks of bounded size, every two blocks of one value meet in one
group, and the group counts the shared values of all its pairs by products of 0/1 matrices.
A pair that meets under several values counts under the first of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sablewatch.constants import FACET_WEIGHTS
from sablewatch.session import cut_lineage

FACETS = tuple(FACET_WEIGHTS)
#: Items with more values than this are not compared in blocks.
BLOCK_VALUES = 128
#: Items of a block where pairs are listed, and where they are summed up.
LIST_ITEMS, SUM_ITEMS = 4096, 4096
#: Pairs that one task compares, about.
TASK_PAIRS = 64_000_000
#: Items of a side that are compared at a time.
_TILE = 256
#: Values that two blocks share, up to which all of a block's items are kept as one matrix.
_FEW_VALUES = 2048
#: Pairs of a batch, at least; at most a tile's more.
_BATCH_PAIRS = 16_384
_EPS = 1e-9

_PAIRS = "a string, b string, score double"
_SUMS = "a string, b string, edges double, total double"


def item_rows(marked: DataFrame, items: DataFrame) -> DataFrame:
    """``item, m, sizes, codes``: one row per item.

    ``marked``: ``item, facet, value, key``, at most ``BLOCK_VALUES`` rows an item, with
    ``key`` where the item can meet others; ``items``: ``item, m`` and facet sizes ``n_*``.
    A code holds a number of the value, its facet's place and ``key``.
    """
    numbers = cut_lineage(marked.select("facet", "value").distinct().withColumn("number", F.monotonically_increasing_id()))
    place = F.array_position(F.array(*[F.lit(f) for f in FACETS]), F.col("facet")) - 1
    code = F.col("number") * 16 + place * 2 + F.col("key").cast("long")
    codes = marked.join(numbers, ["facet", "value"]).groupBy("item").agg(F.collect_list(code).alias("codes"))
    sizes = F.array(*[F.col(f"n_{f}").cast("long") for f in FACETS]).alias("sizes")
    return cut_lineage(codes.join(items.select("item", "m", sizes), "item"))


def _met(rows: DataFrame, block: int) -> DataFrame:
    """The rows by value and pair of blocks: ``number, lo, hi, slot`` and the row.

    Dealt to as many tasks as the pairs to be compared ask for: bytes say little of them.
    """
    keys = F.filter("codes", lambda c: c % 2 == 1)
    posted = rows.withColumn("number", F.explode(F.transform(keys, lambda c: F.shiftright(c, 4))))
    counts = cut_lineage(posted.groupBy("number").agg(F.ceil(F.count("*") / block).alias("blocks"), F.count("*").alias("n"))
                         .filter("n > 1"))
    # One row: pairs to compare, and groups.
    pairs, groups = counts.agg(F.sum(F.col("n").cast("double") * F.col("n") / 2),
                               F.sum(F.col("blocks") * (F.col("blocks") + 1) / 2)).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, -(-int(pairs or 0) // TASK_PAIRS), min(int(groups or 0), 4 * cores))
    dealt = posted.join(counts, "number").withColumn("slot", F.pmod(F.xxhash64("item"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    return dealt.withColumn("other", other).select(
        "number", F.least("slot", "other").alias("lo"), F.greatest("slot", "other").alias("hi"), "slot",
        "item", "m", "sizes", "codes").repartition(tasks, "number", "lo", "hi")


#: Weight of two items by the facets that each has, as bits; added up in the order of facets.
_WEIGHT = np.zeros((1 << len(FACETS), 1 << len(FACETS)))
for _f, _w in enumerate(FACET_WEIGHTS.values()):
    _has = np.arange(1 << len(FACETS)) >> _f & 1 == 1
    _WEIGHT += _w * (_has[:, None] | _has[None])


class _Side:
    """Items of one block as arrays."""

    def __init__(self, group: pa.Table) -> None:
        codes = group["codes"].combine_chunks()
        self.codes = codes.flatten().to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(len(group)), np.diff(codes.offsets.to_numpy()))
        self.n, self.items = len(group), group["item"].combine_chunks()
        self.m = group["m"].to_numpy()
        sizes = group["sizes"].combine_chunks().flatten().to_numpy().reshape(-1, len(FACETS)).astype(np.float64)
        self.has = ((sizes > 0) << np.arange(len(FACETS))).sum(1)
        # Nothing is shared where a size is 0: any divisor will do.
        self.sizes = np.maximum(sizes, 1)
        self.tiles = []
        for lo in range(0, self.n, _TILE):
            own = (rows >= lo) & (rows < lo + _TILE)
            self.tiles.append((lo, min(lo + _TILE, self.n), rows[own] - lo, self.codes[own]))


class _Shared:
    """The values that two sets of codes share, by facet, and the earlier keys that they share."""

    def __init__(self, left: np.ndarray, right: np.ndarray, number: int) -> None:
        self.values = np.intersect1d(left >> 1, right >> 1)
        facet = self.values & 7
        self.place = np.empty(len(facet), np.int64)
        self.place[np.argsort(facet, kind="stable")] = np.arange(len(facet))
        ends = np.cumsum(np.bincount(facet, minlength=len(FACETS)))
        self.facets = [(f, w, slice(hi - n, hi)) for f, (w, n, hi) in enumerate(zip(
            FACET_WEIGHTS.values(), np.diff(ends, prepend=0).tolist(), ends.tolist(), strict=True)) if n]
        keys = np.intersect1d(left[left & 1 == 1] >> 1, right[right & 1 == 1] >> 1)
        self.early = keys[keys >> 3 < number]

    def matrices(self, tile: tuple) -> tuple[np.ndarray, np.ndarray]:
        """A tile's items by values, and by earlier keys."""
        lo, hi, rows, codes = tile
        key = codes & 1 == 1
        return (_matrix(hi - lo, rows, codes >> 1, self.values, self.place),
                _matrix(hi - lo, rows[key], codes[key] >> 1, self.early))


def _matrix(n: int, rows: np.ndarray, values: np.ndarray, vocabulary: np.ndarray, place: np.ndarray | None = None) -> np.ndarray:
    at = np.searchsorted(vocabulary, values)
    here = at < len(vocabulary)
    here[here] = vocabulary[at[here]] == values[here]
    out = np.zeros((n, len(vocabulary)), np.float32)
    out[rows[here], at[here] if place is None else place[at[here]]] = 1
    return out


def _scores(left: _Side, right: _Side, one: tuple, two: tuple, shared: _Shared, a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray | bool]:
    """Scores of a tile's pairs, and which of them have no earlier key to meet under."""
    x, y = slice(one[0], one[1]), slice(two[0], two[1])
    score = np.zeros((one[1] - one[0], two[1] - two[0]))
    for f, w, own in shared.facets:
        both = (a[0][:, own] @ b[0][:, own].T).astype(np.float64)
        all_of = left.sizes[x, f][:, None] + right.sizes[y, f][None]
        all_of -= both
        both *= w
        both /= all_of
        score += both
    score /= _WEIGHT[left.has[x]][:, right.has[y]]
    return score, a[1] @ b[1].T == 0 if len(shared.early) else True


def _tiles(key: tuple, group: pa.Table, threshold: float) -> Iterator[tuple]:
    """``left, right, one, two, score, hit`` of all tiles of a group.

    The values that the blocks share are looked up once per tile, or where they are
    many, once per pair of tiles.
    """
    number, lo, hi = (k.as_py() for k in key)
    slot = group["slot"].to_numpy()
    left = _Side(group.filter(pa.array(slot == lo)))
    right = left if lo == hi else _Side(group.filter(pa.array(slot == hi)))
    shared = _Shared(left.codes, right.codes, number)
    few = len(shared.values) <= _FEW_VALUES
    others = [shared.matrices(two) for two in right.tiles] if few else []
    for i, one in enumerate(left.tiles):
        if few:
            own = others[i] if left is right else shared.matrices(one)
        for j, two in enumerate(right.tiles):
            if left is right and j < i:
                continue
            if few:
                score, first = _scores(left, right, one, two, shared, own, others[j])
            else:
                here = _Shared(one[3], two[3], number)
                score, first = _scores(left, right, one, two, here, here.matrices(one), here.matrices(two))
            hit = score >= threshold - _EPS
            hit &= first
            if left is right and i == j:
                hit &= np.triu(np.ones(hit.shape, bool), 1)
            if hit.any():
                yield left, right, one, two, score, hit


def similar_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """``a, b, score`` (a < b): every pair of items at or above the threshold, once.

    The pairs leave a task in batches, as they are found.
    """

    def listed(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, names, found, n = pa.Table.from_batches(batches), None, [], 0
        for left, right, one, two, score, hit in _tiles(key, group, threshold):
            if names is None:
                names = left.items if right is left else pa.concat_arrays([left.items, right.items])
                order = pc.array_sort_indices(names)
                rank = np.empty(len(names), np.int64)
                rank[order.to_numpy()] = np.arange(len(names))
                names, offset = names.take(order), 0 if right is left else left.n
            i, j = np.nonzero(hit)
            found.append((rank[i + one[0]], rank[j + (offset + two[0])], score[hit]))
            n += len(i)
            if n >= _BATCH_PAIRS:
                yield _batch(names, found)
                found, n = [], 0
        if found:
            yield _batch(names, found)

    return _met(rows, LIST_ITEMS).groupBy("number", "lo", "hi").applyInArrow(listed, _PAIRS)


def _batch(names: pa.Array, found: list[tuple]) -> pa.RecordBatch:
    i, j, score = (np.concatenate(c) for c in zip(*found, strict=True))
    return pa.record_batch({"a": names.take(pa.array(np.minimum(i, j))), "b": names.take(pa.array(np.maximum(i, j))), "score": score})


def similar_sums(rows: DataFrame, threshold: float) -> DataFrame:
    """``a, b, edges, total`` of the pairs of :func:`similar_pairs`, without listing them.

    Rows with ``b`` are links that connect what the pairs connect; the others add up the
    number and the scores of pairs, times their multiplicities, by one of their items.
    """

    def summed(key, group):
        mass, links, label, offset = {}, [], None, 0
        for left, right, one, two, score, hit in _tiles(key, group, threshold):
            if label is None:
                offset = 0 if right is left else left.n
                label = np.arange(offset + right.n)
            pairs = np.where(hit, left.m[one[0] : one[1], None].astype(np.float64) * right.m[None, two[0] : two[1]], 0.0)
            own = mass.setdefault(one[0], np.zeros((2, one[1] - one[0])))
            own += [pairs.sum(1), (pairs * score).sum(1)]
            rows_at, columns_at = slice(one[0], one[1]), slice(offset + two[0], offset + two[1])
            while (apart := hit & (label[rows_at, None] != label[None, columns_at])).any():
                for i in np.flatnonzero(apart.any(1)).tolist():
                    j = int(apart[i].argmax())
                    a, b = label[one[0] + i], label[offset + two[0] + j]
                    if a != b:
                        label[label == max(a, b)] = min(a, b)
                        links.append((one[0] + i, two[0] + j))
        if label is None:
            return pa.table({"a": pa.array([], pa.string()), "b": pa.array([], pa.string()),
                             "edges": pa.array([], pa.float64()), "total": pa.array([], pa.float64())})
        i, j = np.array(links, np.int64).reshape(-1, 2).T
        sums = np.concatenate([v for _, v in sorted(mass.items())], axis=1)
        at = np.concatenate([k + np.arange(v.shape[1]) for k, v in sorted(mass.items())])
        at, sums = at[sums[0] > 0], sums[:, sums[0] > 0]
        none = pa.nulls(len(at), pa.string())
        return pa.table({
            "a": pa.concat_arrays([left.items.take(pa.array(i)), left.items.take(pa.array(at))]),
            "b": pa.concat_arrays([right.items.take(pa.array(j)), none]),
            "edges": np.concatenate([np.zeros(len(i)), sums[0]]), "total": np.concatenate([np.zeros(len(i)), sums[1]])})

    return _met(rows, SUM_ITEMS).groupBy("number", "lo", "hi").applyInArrow(summed, _SUMS)
