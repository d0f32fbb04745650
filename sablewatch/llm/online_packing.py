"""Sum-of-squares packing of token documents into sequences, as they come.

A document is its token ids and an end id. Whole multiples of ``capacity`` are
sequences of their own; what is left is placed at once, never moved for a later
document, in the way that makes the sum over all fill levels of (number of open
windows at that level) squared least: the level array holds those numbers, and a
document of size s turns a window of level h into one of level h + s (a new window has
level 0, a full one counts no more). Levels are thus kept evenly populated, so that a
fitting window is at hand for most sizes. Ties go to the fuller level, windows of one
level are taken oldest first.

When the input ends, or more than ``max_open`` windows are open, the open windows are
settled: the emptiest give tokens to the fullest, cutting a document where one window
is full, so all but one are full; the last one's tokens become sequences of powers of
two (the binary digits of its level), which need no padding.

Rows are packed where they lie: a partition of the input is one run with its own
windows, nothing is shuffled, and a task holds the ids of open windows only (at most
``max_open * capacity``). Runs follow the input's files, so a repeated task gives the
same result; read ``docs`` from files or cut its lineage. Hot sources or keys change
nothing, since rows are not dealt by any column.

Null or empty text: the end id alone. Null ids and repeated rows are packed like any
others. A very long text is encoded in parts and cut into full sequences. Extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sablewatch.llm.blocks import string_column
from sablewatch.llm.registry import query, table
from sablewatch.llm.id_payloads import id_payloads

CAPACITY = 2_048
END_ID = 1
#: Open windows at which a run settles all of them.
MAX_OPEN = 4_096
#: Bytes of ids in a batch of results, about.
BATCH_BYTES = 4 << 20
#: Sequence numbers of a run; the run's number stands above them.
RUN_BITS = 40

SCHEMA = ("doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, "
          "offset long, ids binary")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Levels:
    """The level array, and the windows of each level."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        #: Open windows by level; 0 and ``capacity`` stay 0, such windows do not count.
        self.counts = np.zeros(capacity + 1, np.int64)
        self.windows: dict[int, deque] = {}
        self.open = 0

    def choose(self, size: int) -> int:
        """The level whose window should take ``size``; 0 is a new window."""
        top = self.capacity - size
        before, after = self.counts[: top + 1], self.counts[size:]
        # (n - 1)^2 - n^2 at the old level and (m + 1)^2 - m^2 at the new one; a new
        # window leaves no level, a window that gets full enters none.
        change = 2 * (after - before) + 2
        change[0] -= 1
        change[top] -= 1
        usable = before > 0
        usable[0] = True
        change[~usable] = np.iinfo(np.int64).max
        return top - int(np.argmin(change[::-1]))

    def take(self, level: int) -> list:
        """Removes the oldest window of a level, or makes one."""
        if level == 0:
            return []
        self.counts[level] -= 1
        self.open -= 1
        return self.windows[level].popleft()

    def add(self, level: int, window: list) -> None:
        self.counts[level] += 1
        self.open += 1
        self.windows.setdefault(level, deque()).append(window)

    def drain(self) -> list[tuple[int, list]]:
        """All open windows with their levels, the fullest first; none stay."""
        out = [(level, w) for level in sorted(self.windows, reverse=True) for w in self.windows[level]]
        self.counts[:] = 0
        self.windows.clear()
        self.open = 0
        return out


# A piece is (row, first id, number of ids); a window is a list of pieces.

def settle(windows: list[tuple[int, list]], capacity: int) -> Iterator[list]:
    """Sequences of what open windows hold: full ones, then powers of two."""
    left, right = 0, len(windows) - 1
    held = [list(w) for _, w in windows]
    while left < right:
        gap = capacity - sum(n for _, _, n in held[left])
        while gap and left < right:
            row, start, n = held[right].pop()
            give = min(n, gap)
            if give < n:
                held[right].append((row, start, n - give))
            held[left].append((row, start + n - give, give))
            gap -= give
            if not held[right]:
                right -= 1
        if not gap:
            yield held[left]
            left += 1
    if left > right:
        return
    rest = deque(held[left])
    total = sum(n for _, _, n in rest)
    if total == capacity:
        yield list(rest)
        return
    for bit in reversed(range(total.bit_length())):
        need, out = total & 1 << bit, []
        while need:
            row, start, n = rest.popleft()
            take = min(n, need)
            out.append((row, start, take))
            if take < n:
                rest.appendleft((row, start + take, n - take))
            need -= take
        if out:
            yield out


class Run:
    """One partition's packing: documents in, finished sequences out."""

    def __init__(self, capacity: int, max_open: int) -> None:
        self.capacity, self.max_open = capacity, max_open
        self.levels = Levels(capacity)

    def put(self, row: int, size: int) -> Iterator[list]:
        """Places a document of ``size`` ids; yields the sequences that this ends."""
        whole = size // self.capacity
        for i in range(whole):
            yield [(row, i * self.capacity, self.capacity)]
        rest = size - whole * self.capacity
        if rest:
            level = self.levels.choose(rest)
            window = self.levels.take(level)
            window.append((row, whole * self.capacity, rest))
            if level + rest == self.capacity:
                yield window
            else:
                self.levels.add(level + rest, window)
        if self.levels.open > self.max_open:
            yield from self.end()

    def end(self) -> Iterator[list]:
        yield from settle(self.levels.drain(), self.capacity)


def pack_tokens(docs: DataFrame, *, capacity: int = CAPACITY, end_id: int = END_ID,
                id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
                max_open: int = MAX_OPEN) -> DataFrame:
    """``doc_id, start, length, doc_tokens, sequence_id, offset, ids``: a row per piece.

    ``start`` is the piece's first id in its document, ``offset`` its place in the
    sequence; ``ids`` are the piece's ids, little-endian and 32 bits wide.
    """
    path = tokenizer or default_tokenizer()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        from pyspark import TaskContext

        known = id_payloads(path)
        packing = Run(capacity, max_open)
        number = TaskContext.get().partitionId() << RUN_BITS
        # Row -> [doc id, all its ids, ids not yet returned].
        held: dict[int, list] = {}
        out: list[tuple] = []
        size = 0

        def batch_of(pieces):
            doc, start, length, total, sequence, offset, ids = zip(*pieces, strict=True)
            whole = pa.array([d.as_py() for d in doc], kind)
            return pa.RecordBatch.from_pydict({
                "doc_id": whole, "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()),
                "doc_tokens": pa.array(total, pa.int64()), "sequence_id": pa.array(sequence, pa.int64()),
                "offset": pa.array(offset, pa.int64()), "ids": pa.array(ids, pa.binary())})

        def finish(sequence: list) -> int:
            nonlocal number
            offset, grown = 0, 0
            for row, start, n in sequence:
                own = held[row]
                ids = own[1][start : start + n].astype("<u4").tobytes()
                out.append((own[0], start, n, len(own[1]), number, offset, ids))
                offset += n
                grown += len(ids)
                own[2] -= n
                if not own[2]:
                    del held[row]
            number += 1
            return grown

        row, kind = 0, None
        for batch in batches:
            kind = batch.schema.field(0).type
            raw, bounds = string_column(batch.column(1))
            edges = bounds.tolist()
            for i in range(batch.num_rows):
                found = known.encode(raw[edges[i] : edges[i + 1]].tobytes())
                ids = np.append(found, np.asarray(end_id, found.dtype))
                held[row] = [batch.column(0)[i], ids, len(ids)]
                for sequence in packing.put(row, len(ids)):
                    size += finish(sequence)
                    if size > BATCH_BYTES:
                        yield batch_of(out)
                        out, size = [], 0
                row += 1
        for sequence in packing.end():
            finish(sequence)
        if out:
            yield batch_of(out)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, SCHEMA.format(kind=kind))


@query("op11_sum_of_squares_packing")
def op11_sum_of_squares_packing(spark, sf_dir):
    return pack_tokens(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset")
