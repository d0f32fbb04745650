"""Words of a block of texts, found on its bytes."""

from __future__ import annotations

import numpy as np

from sablewatch.llm.blocks import Block

# A word is a run of bytes outside these: U+0020 and U+0009 to U+000D.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def word_edges(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and per text the range of its words."""
    data, bounds = block.data, block.bounds
    inside = ~SEPARATOR[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    # A text's edge is a word's edge too.
    edges = bounds[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, bounds)


def code_points(data: np.ndarray) -> np.ndarray:
    """Prefix counts of code points: ``p[end] - p[start]`` for any piece."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
