"""Best-fit packing of documents into sequences of fixed size, with conflicts.

A document of more than ``capacity`` units is cut into full sequences and a rest;
full ones are bins of their own. Rests and shorter documents are placed, the largest
first, in the tightest bin that may take them. A bin may not take a document

* whose duplicate cluster (equal texts after folding case and white space, or a
  column of the caller's) already has one in it, or
* whose source already has ``per_source`` documents in it.

Bins are ordered by what is left in them. Each carries a bitmap of the sources it has
its fill of and one of its clusters (bits by hash, so a false conflict may cost some
fill, never a rule). Bins with the same source bitmap share a bitmap of occupied
residuals, in which the successor of a size is found by bit operations; the search
goes on, over bitmaps and residuals, until it has the tightest compatible bin.

Documents are dealt to shards by the hash of their id and place in the input, so a hot
source or cluster, or rows that repeat an id and text, are spread; each shard of about ``shard_rows`` rows is packed by one task. Only ids,
sources, sizes and cluster hashes are shuffled, no texts. Shards grow with the table,
not in size.

Size is the length of the text in UTF-8 bytes, or a column of the caller's. Null or
empty text, or a null size: no units, and not packed (bin null). Null source and
null cluster conflict with nothing. Null ids and repeated rows are packed like any
others. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sablewatch.llm.registry import query, table

CAPACITY = 16_384
PER_SOURCE = 4
SHARD_ROWS = 20_000
#: Bits of a bin's cluster bitmap.
CLUSTER_BITS = 256


class Shelf:
    """The open bins of one shard."""

    def __init__(self, capacity: int, per_source: int) -> None:
        self.capacity, self.per_source = capacity, per_source
        # Source bitmap -> bitmap of residuals that have a bin with that source bitmap.
        self.occupied: dict[int, int] = {}
        # (source bitmap, residual) -> bins, in the order they came.
        self.places: dict[tuple[int, int], OrderedDict[int, None]] = {}
        self.clusters: list[int] = []  # per bin, its cluster bitmap
        self.counts: list[dict[int, int]] = []  # per bin, documents of each source
        self.sources: list[int] = []  # per bin, bitmap of sources at their limit
        self.left: list[int] = []
        # The class (size, source, whole cluster) of the item before, and where its search
        # ended: while items of one class follow each other, what lay before stays closed.
        self.last: tuple[int, int, int] | None = None
        self.at = 0

    def _file(self, bin_: int) -> None:
        full, left = self.sources[bin_], self.left[bin_]
        if left:
            self.places.setdefault((full, left), OrderedDict())[bin_] = None
            self.occupied[full] = self.occupied.get(full, 0) | 1 << left

    def _unfile(self, bin_: int) -> None:
        full, left = self.sources[bin_], self.left[bin_]
        held = self.places[full, left]
        del held[bin_]
        if not held:
            del self.places[full, left]
            self.occupied[full] &= ~(1 << left)
            if not self.occupied[full]:
                del self.occupied[full]

    def find(self, size: int, source: int, cluster: int, name: int) -> int | None:
        """The tightest bin that may take the item, if any may; ``name`` is the whole cluster."""
        key = size, source, name
        at = self.at if cluster and key == self.last else size
        self.last = key
        open_ = [m for full, m in self.occupied.items() if not full & source]
        union = 0
        for m in open_:
            union |= m
        while rest := union >> at:
            at += (rest & -rest).bit_length() - 1
            best = None
            for full, m in self.occupied.items():
                if full & source or not m >> at & 1:
                    continue
                for bin_ in self.places[full, at]:
                    if not self.clusters[bin_] & cluster:
                        if best is None or bin_ < best:
                            best = bin_
                        break
            if best is not None:
                self.at = at
                return best
            at += 1
        self.at = at
        return None

    def put(self, size: int, source: int, cluster: int, name: int) -> int:
        """Places an item; returns its bin. Items come by descending size."""
        bin_ = self.find(size, source, cluster, name)
        if bin_ is None:
            bin_ = len(self.left)
            self.left.append(self.capacity)
            self.clusters.append(0)
            self.counts.append({})
            self.sources.append(0)
        else:
            self._unfile(bin_)
        self.left[bin_] -= size
        self.clusters[bin_] |= cluster
        if source:
            seen = self.counts[bin_][source] = self.counts[bin_].get(source, 0) + 1
            if seen >= self.per_source:
                self.sources[bin_] |= source
        self._file(bin_)
        return bin_


def pack_shard(sizes: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int,
               per_source: int) -> np.ndarray:
    """The bin of every item (its size at most ``capacity``).

    ``sources`` are small numbers from 0, ``clusters`` hashes; -1 in ``sources`` and 0
    in ``clusters`` stand for none. Equal items are placed one after the other.
    """
    shelf = Shelf(capacity, per_source)
    out = np.empty(len(sizes), np.int64)
    for i in np.lexsort((sources, clusters, -sizes)).tolist():
        bits = clusters[i]
        cluster = 1 << int(bits % CLUSTER_BITS) if bits else 0
        source = 1 << int(sources[i]) if sources[i] >= 0 else 0
        out[i] = shelf.put(int(sizes[i]), source, cluster, int(bits))
    return out


def pack_documents(docs: DataFrame, *, capacity: int = CAPACITY, per_source: int = PER_SOURCE,
                   id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                   size_col: str | None = None, cluster_col: str | None = None,
                   shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``doc_id, piece, start, size, shard, bin, source, cluster``: a row per piece.

    ``start`` is the piece's first unit in its document. A bin is named by ``shard``
    and ``bin``. Counts the rows once to choose the number of shards.
    """
    text = F.col(text_col)
    size = F.col(size_col) if size_col else F.octet_length(text)
    folded = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    cluster = F.xxhash64(F.col(cluster_col)) if cluster_col else F.xxhash64(folded)
    origin = F.col(cluster_col) if cluster_col else text
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.when(origin.isNotNull(), cluster).alias("cluster"),
        F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0)).alias("size"))
    shards = max(1, -(-rows.count() // shard_rows))
    dealt = rows.withColumn("shard", F.pmod(
        F.xxhash64("doc_id", "cluster", "size", F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def pack(key, group):
        group = group.sort_by([("size", "descending"), ("doc_id", "ascending"), ("cluster", "ascending")])
        sizes = group["size"].to_numpy()
        full, rest = np.divmod(sizes, capacity)
        source = group["source"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        cluster = group["cluster"].combine_chunks().fill_null(0).to_numpy().view(np.uint64)
        open_ = np.flatnonzero(rest)
        bins = pack_shard(rest[open_], source[open_], cluster[open_], capacity, per_source)
        pieces = np.maximum(full + (rest > 0), 1)
        row = np.repeat(np.arange(len(sizes)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        whole = piece < full[row]
        bin_ = np.empty(len(row), np.int64)
        last = np.full(len(sizes), -1, np.int64)
        last[open_] = bins
        bin_[~whole] = last[row[~whole]]
        # Full sequences are numbered behind the packed bins.
        used = int(bins.max()) + 1 if len(bins) else 0
        bin_[whole] = used + np.arange(int(whole.sum()))
        length = np.where(whole, capacity, rest[row])
        return pa.table({
            "doc_id": group["doc_id"].take(row), "piece": piece.astype(np.int32),
            "start": piece * capacity, "size": length, "shard": group["shard"].take(row),
            "bin": pa.array(bin_, mask=length == 0), "source": group["source"].take(row),
            "cluster": group["cluster"].take(row)})

    return dealt.groupBy("shard").applyInArrow(
        pack, f"doc_id {kinds['doc_id']}, piece int, start long, size long, shard int, bin long, "
        "source string, cluster long")


@query("op1_best_fit_packing")
def op1_best_fit_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"))
