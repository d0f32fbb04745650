"""Text segments that a tokenizer treats alone, looked up in a table of seen ones.

A segment is a run of white space with what follows it up to the next white
space. No token crosses its edges, so the tokens of a text are those of its
segments in turn. Each Python worker keeps a bounded table of segments it has
met; only new ones are encoded. The table changes speed, never results.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from sablewatch.llm.blocks import Block, PieceHash, ragged

#: Most segments a worker keeps; beyond it those met once are forgotten.
TABLE_SEGMENTS = 600_000


class Ragged:
    """Arrays of different length, one per segment, end to end."""

    def __init__(self, dtype) -> None:
        self.values = np.empty(0, dtype)
        self.starts = np.empty(0, np.int64)
        self.lengths = np.empty(0, np.int64)

    def append(self, parts: list[np.ndarray]) -> None:
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = len(self.values) + np.cumsum(lengths)
        flat = np.concatenate(parts).astype(self.values.dtype) if parts else self.values[:0]
        self.values = np.concatenate([self.values, flat])
        self.starts = np.concatenate([self.starts, ends - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])

    def keep(self, which: np.ndarray) -> None:
        starts, lengths = self.starts[which], self.lengths[which]
        self.values = self.values[ragged(starts, lengths)]
        self.lengths = lengths
        self.starts = np.cumsum(lengths) - lengths

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arrays of ``which`` end to end, and their lengths."""
        lengths = self.lengths[which]
        return self.values[ragged(self.starts[which], lengths)], lengths


class SegmentTable:
    """Segment hash -> row of the ragged columns that ``encode`` fills.

    ``encode(list of bytes)`` returns, per column name, one array per segment.
    """

    def __init__(self, encode: Callable[[list[bytes]], dict[str, list[np.ndarray]]],
                 columns: dict[str, type], limit: int = TABLE_SEGMENTS) -> None:
        self.encode = encode
        self.columns = {name: Ragged(kind) for name, kind in columns.items()} | {"_text": Ragged(np.uint8)}
        self.limit = limit
        self.hashes = np.empty(0, np.uint64)  # ascending
        self.rows = np.empty(0, np.int64)  # rows[i] is the row of hashes[i]
        self.hits = np.empty(0, np.int64)  # by row: blocks that used it

    def _shrink(self) -> None:
        keep = np.flatnonzero(self.hits > 1)
        if 2 * len(keep) > self.limit:
            keep = keep[:0]
        place = np.full(len(self.hits), -1)
        place[keep] = np.arange(len(keep))
        stays = place[self.rows] >= 0
        self.hashes, self.rows = self.hashes[stays], place[self.rows[stays]]
        self.hits = np.ones(len(keep), np.int64)
        for column in self.columns.values():
            column.keep(keep)

    def look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The row of every ``data[start:end]``; rows hold until the next call."""
        if len(self.rows) > self.limit:
            self._shrink()
        hashes = PieceHash(data)(starts, ends)
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == distinct[inside]
        row = np.empty(len(distinct), np.int64)
        row[known] = self.rows[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            pieces = [raw[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(),
                                               strict=True)]
            row[new] = self._append(pieces)
            self.hashes = np.insert(self.hashes, at[new], distinct[new])
            self.rows = np.insert(self.rows, at[new], row[new])
        self.hits[row] += 1
        return self._checked(row[inverse], data, starts, ends)

    def _append(self, pieces: list[bytes]) -> np.ndarray:
        """New rows for some segments."""
        rows = np.arange(len(self.hits), len(self.hits) + len(pieces))
        columns = self.encode(pieces) | {"_text": [np.frombuffer(p, np.uint8) for p in pieces]}
        for name, parts in columns.items():
            self.columns[name].append(parts)
        self.hits = np.concatenate([self.hits, np.zeros(len(pieces), np.int64)])
        return rows

    def _checked(self, rows: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The rows, but rows of their own for segments whose bytes are not the row's."""
        sizes = ends - starts
        same = self.columns["_text"].lengths[rows] == sizes
        live = np.flatnonzero(same)
        if len(live):
            text, _ = self.columns["_text"].take(rows[live])
            differ = text != data[ragged(starts[live], sizes[live])]
            if differ.any():
                same[live] = np.add.reduceat(differ, np.cumsum(sizes[live]) - sizes[live]) == 0
        if same.all():
            return rows
        odd = np.flatnonzero(~same)
        rows = rows.copy()
        rows[odd] = self._append([data[a:b].tobytes() for a, b in zip(starts[odd], ends[odd], strict=True)])
        return rows


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def white_space_segments(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Edges of the segments of all texts: a text's segments are end to end.

    A segment starts where ASCII white space follows a byte that is no white
    space. Next to other Unicode white space, of two or three bytes, the cut is
    left out, because a tokenizer may take both as one run.
    """
    data, bounds = block.data, block.bounds
    space = _SPACE[data]
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    at = np.flatnonzero(cut)
    before = at[at > 0]
    # The last bytes of U+0085, U+00A0, U+1680, U+2000-200A, 2028, 2029, 202F, 205F, U+3000.
    odd = before[data[before - 1] >= 0x80]
    if len(odd):
        two = (data[odd - 2] == 0xC2) & ((data[odd - 1] == 0x85) | (data[odd - 1] == 0xA0))
        lead, middle = data[np.maximum(odd - 3, 0)], data[odd - 2]
        three = ((lead == 0xE1) & (middle == 0x9A)) | (
            (lead == 0xE2) & ((middle == 0x80) | (middle == 0x81))) | (
            (lead == 0xE3) & (middle == 0x80))
        cut[odd[two | three]] = False
        at = np.flatnonzero(cut)
    starts = np.unique(np.concatenate([bounds[:-1], at]))
    starts = starts[starts < len(data)]
    return starts, np.append(starts[1:], len(data))
