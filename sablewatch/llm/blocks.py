"""Texts of an Arrow batch as one byte array, and hashes of any of its pieces.

Operators run inside ``mapInArrow``. A batch is taken in blocks of whole texts
of about ``BLOCK_BYTES``, so that memory follows the block and the longest text,
not the number of rows in a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

# Odd multiplier and byte values for polynomial hashes modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_RANDOM = np.random.Generator(np.random.PCG64(20240117))
BYTE_VALUES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (splitmix64)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Block:
    """Whole texts: ``data`` holds their UTF-8 bytes, ``bounds`` their edges in it."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, rows: slice) -> None:
        self.data = data
        self.bounds = bounds
        self.rows = rows

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()


def string_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and edges of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, edges, data = column.buffers()
    kind = np.int64 if wide else np.int32
    bounds = np.frombuffer(edges, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw, bounds.astype(np.int64)


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The texts of a string column, some at a time."""
    if not len(column):
        return
    raw, bounds = string_column(column)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(bounds, bounds[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        lo, hi = bounds[first], bounds[last]
        yield Block(raw[lo:hi], bounds[first : last + 1] - lo, slice(first, last))
        first = last


#: A Mersenne prime, and a base below it, for the second hash.
_PRIME = np.uint64((1 << 31) - 1)
_PRIME_BASE = 1_367_130_551


def _powers(n: int, base: int, prime: bool) -> np.ndarray:
    if not prime:
        out = np.full(n, base, np.uint64)
        out[:1] = 1
        return np.cumprod(out, out=out)
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:  # the powers known so far, times the next one
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, int(_PRIME))) % _PRIME
        done += step
    return out


_TABLES: dict[bool, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int, prime: bool) -> tuple[np.ndarray, np.ndarray]:
    """Powers and inverse powers of a base; those of a block's size are kept."""
    size = BLOCK_BYTES + 1
    if n <= size and prime in _TABLES:
        return tuple(t[:n] for t in _TABLES[prime])
    base, inverse = (_PRIME_BASE, pow(_PRIME_BASE, -1, int(_PRIME))) if prime else (_BASE, _BASE_INVERSE)
    made = n if n > size or n < size // 8 else size
    # Those modulo the prime fit half the space; a worker keeps its tables as long as it lives.
    kind = np.uint32 if prime else np.uint64
    tables = _powers(made, base, prime).astype(kind, copy=False), _powers(made, inverse, prime).astype(kind, copy=False)
    if made == size:
        _TABLES[prime] = tables
    return tuple(t[:n] for t in tables)


class PieceHash:
    """Polynomial prefix sums: the hash of any ``data[start:end]`` in constant time.

    Modulo 2**64 alone, some pieces of a thousand bytes of two kinds collide whatever the
    base. So pieces of ``LONG`` bytes and more get a second sum, modulo a prime, which
    tells these apart; it is made when first needed.
    """

    LONG = 128

    def __init__(self, data: np.ndarray, values: np.ndarray = BYTE_VALUES) -> None:
        n = len(data)
        powers, self.inverse = _power_tables(n + 1, False)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.multiply(values[data], powers[:n], out=self.prefix[1:])
        np.cumsum(self.prefix, out=self.prefix)
        self._source, self._second = (data, values), None

    def _prime_sums(self) -> tuple[np.ndarray, np.ndarray]:
        if self._second is None:
            data, values = self._source
            powers, inverse = _power_tables(len(data) + 1, True)
            # Sums of numbers below 2**31 do not overflow.
            sums = np.zeros(len(data) + 1, np.uint64)
            np.multiply((values % _PRIME)[data], powers[: len(data)], out=sums[1:])
            sums[1:] %= _PRIME
            self._second = np.cumsum(sums, out=sums), inverse
        return self._second

    def _joined(self, value: np.ndarray, start, end) -> np.ndarray:
        sums, inverse = self._prime_sums()
        return mix(value ^ mix((sums[end] - sums[start]) % _PRIME * inverse[start] % _PRIME + _PRIME))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed with the length, so that equal values mean equal pieces."""
        start, end = np.asarray(start), np.asarray(end)
        value = (self.prefix[end] - self.prefix[start]) * self.inverse[start] + (end - start).astype(np.uint64)
        out = mix(value)
        long = np.flatnonzero(end - start >= self.LONG)
        if len(long):
            out[long] = self._joined(value[long], start[long], end[long])
        return out

    def windows(self, size: int) -> np.ndarray:
        """The hash of every ``data[i:i+size]``."""
        n = len(self.prefix) - size
        if n <= 0:
            return np.empty(0, np.uint64)
        value = (self.prefix[size:] - self.prefix[:-size]) * self.inverse[:n]
        return mix(value) if size < self.LONG else self._joined(value, slice(0, n), slice(size, None))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``concatenate([arange(s, s + n) for s, n in zip(starts, lengths)])``."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def rows_equal_before(keys: np.ndarray) -> np.ndarray:
    """True where an equal key stands earlier in the array."""
    out = np.ones(len(keys), bool)
    out[np.unique(keys, return_index=True)[1]] = False
    return out


def map_blocks(df, text: str, fn, schema: str):
    """Apply ``fn(block, rows)`` to every block of the text column of ``df``.

    ``rows`` is the slice of the Arrow batch the block covers; ``fn`` returns a
    mapping of columns or None for no rows. Select the needed columns first.
    """

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for block in blocks(column):
                rows = batch.slice(block.rows.start, block.rows.stop - block.rows.start)
                out = fn(block, rows)
                if out is not None:
                    yield pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(run, schema)


def range_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values[bounds[i]:bounds[i+1]]``, empty ranges included."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
