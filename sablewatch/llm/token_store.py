"""Token ids in binary shards, found by document key through a minimal perfect hash.

``write_store`` ranges the documents by id, encodes each range once and writes it
as one shard: raw little-endian ids, nothing else. The index is cut by key hash
into buckets; each bucket file is a minimal perfect hash over its keys (bit
levels: a key that alone takes a bit at a level is placed there, the others go on
to the next level; its slot is the rank of its bit) with, per slot, a fingerprint
of the key, the shard, the offset and the length. ``read_store`` looks keys up:
one bucket, at most a few bit tests, one fingerprint test, one ranged read.

Null or empty text: only the end id. Null id: sorts first, and is a key like any
other. Rows that repeat an id stay separate records, in order of their text's
hash; the n-th one is found under (id, n). Many rows of one id lie in several shards. Other columns are ignored. An empty
table gives a store without shards. A key that was never stored is told by its
fingerprint (a false hit has chance 2**-32).
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sablewatch.llm.blocks import blocks, mix
from sablewatch.llm.byte_tokens import default_tokenizer
from sablewatch.llm.id_payloads import id_payloads
from sablewatch.llm.registry import query, table
from sablewatch.llm.storage import cut_lineage, new_file, read_range, shared_folder

END_ID = 2
#: Documents per index bucket, about; a bucket is built and loaded by one task.
BUCKET_KEYS = 50_000
#: Bits per key at each level of the hash.
GAMMA = 2
_NULL_KEY = -(1 << 63)
#: Row numbers of one id that are made at a time.
RUN = 10_000
_SEED = np.uint64(0xA24BAED4963EE407)
_ROWS = "key long, nth long, shard int, at long, n_tokens long"


# --------------------------------------------------------------------------- #
# Minimal perfect hash
# --------------------------------------------------------------------------- #

def key_hash(keys: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """A distinct 64-bit value for each (key, n) in practice; equal keys spread over n."""
    return mix(keys.astype(np.int64).view(np.uint64) + _SEED * (nth.astype(np.uint64) + np.uint64(1)))


class PerfectHash:
    """Distinct 64-bit hashes -> 0..n-1, in about three bits a key."""

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels
        self.ranks, before = [], 0
        for words in levels:
            counts = np.bitwise_count(words).astype(np.int64)
            self.ranks.append(before + np.concatenate([[0], np.cumsum(counts)]))
            before = int(self.ranks[-1][-1])

    @staticmethod
    def _bits(hashes: np.ndarray, level: int, n_bits: int) -> np.ndarray:
        return (mix(hashes + np.uint64(level + 1)) % np.uint64(n_bits)).astype(np.int64)

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        rest, levels = np.unique(hashes), []
        while len(rest):
            n_words = -(-GAMMA * len(rest) // 64)
            bit = cls._bits(rest, len(levels), 64 * n_words)
            alone = np.bincount(bit, minlength=64 * n_words)[bit] == 1
            words = np.zeros(n_words, np.uint64)
            np.bitwise_or.at(words, bit[alone] >> 6, np.uint64(1) << (bit[alone] & 63).astype(np.uint64))
            levels.append(words)
            rest = rest[~alone]
        return cls(levels)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash; -1 for one that reaches no level's bit."""
        out = np.full(len(hashes), -1, np.int64)
        live = np.arange(len(hashes))
        for level, words in enumerate(self.levels):
            bit = self._bits(hashes[live], level, 64 * len(words))
            word, low = words[bit >> 6], (bit & 63).astype(np.uint64)
            hit = (word >> low) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << low) - np.uint64(1)))
            out[live[hit]] = (self.ranks[level][bit >> 6] + below)[hit]
            live = live[~hit]
        return out


# Bucket file: int64 counts (levels, words per level, keys), then the level
# words, then per slot a 32-bit fingerprint, shard, offset and length.
_SLOT = np.dtype([("print", "<u4"), ("shard", "<u4"), ("at", "<u8"), ("n", "<u4")])


def pack_bucket(hashes: np.ndarray, shard: np.ndarray, at: np.ndarray, n: np.ndarray) -> bytes:
    index = PerfectHash.build(hashes)
    slots = np.zeros(len(hashes), _SLOT)
    place = index.slots(hashes)
    for name, values in (("print", hashes >> np.uint64(32)), ("shard", shard), ("at", at), ("n", n)):
        slots[name][place] = values
    head = np.array([len(index.levels), *map(len, index.levels), len(hashes)], "<i8")
    return b"".join([head.tobytes(), *(w.astype("<u8").tobytes() for w in index.levels), slots.tobytes()])


class BucketIndex:
    def __init__(self, raw: bytes) -> None:
        n_levels = int(np.frombuffer(raw, "<i8", 1)[0])
        sizes = np.frombuffer(raw, "<i8", n_levels + 1, 8)
        at, levels = 8 * (n_levels + 2), []
        for size in sizes[:-1].tolist():
            levels.append(np.frombuffer(raw, "<u8", size, at))
            at += 8 * size
        self.index = PerfectHash(levels)
        self.records = np.frombuffer(raw, _SLOT, int(sizes[-1]), at)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are stored, and their records."""
        place = self.index.slots(hashes)
        found = place >= 0
        records = self.records[place[found]]
        same = records["print"] == (hashes[found] >> np.uint64(32)).astype(np.uint32)
        found[np.flatnonzero(found)[~same]] = False
        return found, records[same]


def bucket_of(hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    return (mix(hashes ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(n_buckets)).astype(np.int32)


# --------------------------------------------------------------------------- #
# Writing
# --------------------------------------------------------------------------- #

def write_store(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text",
                tokenizer: str | None = None, end_id: int = END_ID, shards: int | None = None,
                width: str = "<u2") -> dict:
    """Write shards and index below ``folder``; returns the store's description.

    ``shards`` defaults to the session's shuffle partitions. ``width`` is the
    numpy type of a stored id; a larger id stops the job.
    """
    spark = docs.sparkSession
    path = tokenizer or default_tokenizer()
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_KEY)).alias("key"),
        F.xxhash64(F.col(text_col)).alias("tie"), F.monotonically_increasing_id().alias("row"),
        F.col(text_col).alias("text"),
    )
    # Ranged before encoding; the tie and the row split an id that many rows share.
    order = ["key", "tie", "row"]
    placed = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("key", "text")

    def encode(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        known = id_payloads(path)
        kind = np.dtype(width)
        limit, end = np.iinfo(kind).max, np.array([end_id], kind).tobytes()
        at, last, count = 0, None, 0
        first = next(batches, None)
        if first is None:
            return
        with new_file(f"{folder}/ids-{shard:06d}.bin") as file:
            for batch in itertools.chain([first], batches):
                keys = batch.column(0).to_numpy()
                for block in blocks(batch.column(1)):
                    raw = []
                    for i in range(len(block)):
                        ids = known.encode(block.text(i))
                        if len(ids) and ids.max() > limit:
                            raise ValueError(f"id {ids.max()} needs more than {width}")
                        raw.append(ids.astype(kind, copy=False).tobytes() + end)
                    file.write(b"".join(raw))
                    lengths = np.fromiter(map(len, raw), np.int64, len(raw)) // kind.itemsize
                    own, nth = keys[block.rows], np.zeros(len(block), np.int64)
                    for i, key in enumerate(own.tolist()):
                        count = count + 1 if key == last else 0
                        last, nth[i] = key, count
                    ends = at + np.cumsum(lengths)
                    yield pa.RecordBatch.from_pydict({
                        "key": own, "nth": nth, "shard": np.full(len(own), shard, np.int32),
                        "at": ends - lengths, "n_tokens": lengths})
                    at = int(ends[-1])

    located = cut_lineage(placed.mapInArrow(encode, _ROWS))
    totals = located.groupBy("shard").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs"),
                                          F.min("key").alias("low"), F.max("key").alias("high"))
    # One row per shard, not per document.
    found = sorted(totals.collect(), key=lambda r: r.shard)
    sizes = {r.shard: (r.n, r.docs) for r in found}
    crossing = sorted({a.high for a, b in zip(found, found[1:], strict=False) if a.high == b.low})
    if crossing:  # ids that go on in the next shard: their rows are numbered through
        parts = located.filter(F.col("key").isin(crossing)).groupBy("key", "shard").agg(F.count("*").alias("n"))
        before = Window.partitionBy("key").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        # At most two rows for each shard.
        offsets = parts.select("key", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
        located = located.join(F.broadcast(offsets), ["key", "shard"], "left").select(
            "key", (F.col("nth") + F.coalesce("before", F.lit(0))).alias("nth"), "shard", "at", "n_tokens")
    n_buckets = max(1, -(-sum(d for _, d in sizes.values()) // BUCKET_KEYS))
    starts, before = {}, 0
    for shard in sorted(sizes):
        starts[shard] = before
        before += sizes[shard][0]

    def assign(batches):
        for batch in batches:
            found = key_hash(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_pydict({
                "bucket": bucket_of(found, n_buckets), "hash": found.view(np.int64),
                "shard": batch.column(2), "at": batch.column(3), "n_tokens": batch.column(4)})

    def build(key, group):
        hashes = group["hash"].to_numpy().view(np.uint64)
        raw = pack_bucket(hashes, *(group[c].to_numpy() for c in ("shard", "at", "n_tokens")))
        with new_file(f"{folder}/index-{key[0].as_py():06d}.bin") as file:
            file.write(raw)
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "keys": [len(hashes)]})

    buckets = located.mapInArrow(assign, "bucket int, hash long, shard int, at long, n_tokens long")
    built = buckets.groupBy("bucket").applyInArrow(build, "bucket int, keys long")
    built.agg(F.sum("keys")).collect()
    return {"folder": folder, "buckets": n_buckets, "starts": starts, "width": width,
            "tokens": before}


# --------------------------------------------------------------------------- #
# Reading
# --------------------------------------------------------------------------- #

def read_store(keys: DataFrame, store: dict) -> DataFrame:
    """``key, nth, start, n_tokens, ids`` of every stored key; others give no row.

    ``keys`` has ``key`` and ``nth``. ``ids`` is the raw little-endian payload.
    Keys meet their bucket's index file, then their shard, in offset order.
    """
    folder, n_buckets, width = store["folder"], store["buckets"], store["width"]
    size = np.dtype(width).itemsize

    def assign(batches):
        for batch in batches:
            found = key_hash(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_pydict({
                "key": batch.column(0), "nth": batch.column(1),
                "bucket": bucket_of(found, n_buckets)})

    def look_up(batches):
        index: tuple[int, BucketIndex | None] = (-1, None)
        for batch in batches:
            own = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            hashes, buckets = key_hash(*own), batch.column(2).to_numpy()
            for bucket in np.unique(buckets).tolist():
                if index[0] != bucket:
                    try:
                        raw = read_range(f"{folder}/index-{bucket:06d}.bin")
                    except FileNotFoundError:
                        continue  # no key was stored in this bucket
                    index = (bucket, BucketIndex(raw))
                at = np.flatnonzero(buckets == bucket)
                found, records = index[1].find(hashes[at])
                at = at[found]
                yield pa.RecordBatch.from_pydict({
                    "key": own[0][at], "nth": own[1][at], "shard": records["shard"].astype(np.int32),
                    "at": records["at"].astype(np.int64), "n_tokens": records["n"].astype(np.int64)})

    starts = store["starts"]

    def fetch(batches):
        for batch in batches:
            key, nth, shard, at, n = (c.to_numpy() for c in batch.columns)
            # Neighbouring records of one shard are read by one ranged read of bounded size.
            ends = at + n
            cut = np.flatnonzero((shard[1:] != shard[:-1]) | (at[1:] != ends[:-1])) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(key)], strict=True):
                while lo < hi:
                    stop = lo + max(1, int(np.searchsorted(ends[lo:hi], at[lo] + (4 << 20), "right")))
                    first, total = int(at[lo]), int(ends[stop - 1] - at[lo])
                    raw = read_range(f"{folder}/ids-{int(shard[lo]):06d}.bin", first * size, total * size)
                    edges = ((at[lo:stop] - first) * size).tolist()
                    lengths = (n[lo:stop] * size).tolist()
                    yield pa.RecordBatch.from_pydict({
                        "key": key[lo:stop], "nth": nth[lo:stop],
                        "start": at[lo:stop] + np.array([starts[s] for s in shard[lo:stop].tolist()]),
                        "n_tokens": n[lo:stop],
                        "ids": pa.array([raw[a : a + b] for a, b in zip(edges, lengths, strict=True)],
                                        pa.binary())})
                    lo = stop

    placed = (keys.mapInArrow(assign, "key long, nth long, bucket int")
              .repartition("bucket").sortWithinPartitions("bucket"))
    found = placed.mapInArrow(look_up, _ROWS)
    by_shard = found.repartition("shard", F.expr("at div 4000000")).sortWithinPartitions("shard", "at")
    return by_shard.mapInArrow(
        fetch, "key long, nth long, start long, n_tokens long, ids binary")


def stored_keys(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``key, nth`` of every row of a table: the n-th row of an id.

    Numbers are made in runs of ``RUN``, which are dealt out, for ids of very many rows.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_KEY)).alias("key")
    counts = docs.select(key).groupBy("key").agg(F.count("*").alias("n"))
    step = F.lit(RUN).cast("long")
    runs = counts.select("key", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, step)).alias("at"))
    dealt = runs.repartition("key", "at")
    return dealt.select("key", F.explode(F.sequence("at", F.least(F.col("at") + step, F.col("n")) - 1)).alias("nth"))


@query("op10_token_store")
def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    store = write_store(docs, shared_folder(spark, "token-store"))
    found = read_store(stored_keys(docs), store)
    width = store["width"]

    def digest(batches):
        for batch in batches:
            sums = [zlib.crc32(np.frombuffer(raw, width).astype("<u4").tobytes())
                    for raw in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "key": batch.column(0), "start": batch.column(1), "n_tokens": batch.column(2),
                "ids_crc32": pa.array(sums, pa.int64())})

    out = found.select("key", "start", "n_tokens", "ids").mapInArrow(
        digest, "key long, start long, n_tokens long, ids_crc32 long")
    doc_id = F.when(F.col("key") != F.lit(_NULL_KEY), F.col("key"))
    return out.select(doc_id.alias("doc_id"), "start", "n_tokens", "ids_crc32")
