"""Suffix array of a byte string by the difference cover modulo 3, in numpy.

Suffixes at positions 1 and 2 modulo 3 are the sample. Their leading triples are
sorted and named; if names repeat, the string of names is sorted the same way.
Suffixes at positions 0 modulo 3 are sorted by their first symbol and the rank of
the sampled suffix behind it, and merged into the sample.
"""

from __future__ import annotations

import numpy as np


def _order(*columns: np.ndarray) -> np.ndarray:
    """Stable order by the columns, the first most significant."""
    return np.lexsort(columns[::-1])


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of all suffixes of ``text`` (small non-negative ints) in order.

    A suffix that is a prefix of another comes first.
    """
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    # Symbols from 1 on; three zeros behind the end.
    symbols = np.zeros(n + 3, np.int64)
    symbols[:n] = text.astype(np.int64) + 1
    # With n = 1 modulo 3 the sample takes the empty suffix n too, so that the two
    # halves of the reduced string cannot run into each other.
    end = n + (n % 3 == 1)
    ones, twos = np.arange(1, end, 3), np.arange(2, end, 3)
    sample = np.concatenate([ones, twos])

    # Names of the sampled triples; few enough bits are packed into one key.
    width = int(symbols.max()).bit_length()
    triple = [symbols[sample + k] for k in range(3)]
    if 3 * width <= 63:
        packed = (triple[0] << (2 * width)) | (triple[1] << width) | triple[2]
        distinct, name = np.unique(packed, return_inverse=True)
        count = len(distinct)
        order = None
    else:
        order = _order(*triple)
        new = np.zeros(len(order), np.int64)
        for column in triple:
            new[1:] |= column[order[1:]] != column[order[:-1]]
        name = np.empty(len(order), np.int64)
        name[order] = np.cumsum(new)
        count = int(name.max()) + 1
    if count < len(sample):
        order = suffix_array(name)
    elif order is None:
        order = np.argsort(name)
    rank = np.zeros(n + 4, np.int64)  # of sampled positions, from 1; 0 behind the end
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    if end > n:
        order = order[sample[order] != n]
    sampled = sample[order]

    zeros = np.arange(0, n, 3)
    # Merge: against 1 modulo 3 one symbol decides, then ranks; against 2 modulo 3 two.
    big = len(sample) + 2
    zeros = zeros[np.argsort(symbols[zeros] * big + rank[zeros + 1])]
    one, two = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]

    def by_one(i):
        return symbols[i] * big + rank[i + 1]

    before = np.searchsorted(by_one(one), by_one(zeros))
    # Two symbols and a rank; pairs too large to be packed with it are named first.
    pair_zero, pair_two = ((symbols[i] << width) | symbols[i + 1] for i in (zeros, two))
    if 2 * width + big.bit_length() > 63:
        pairs = np.unique(np.concatenate([pair_zero, pair_two]))
        pair_zero, pair_two = np.searchsorted(pairs, pair_zero), np.searchsorted(pairs, pair_two)
    before += np.searchsorted(pair_two * big + rank[two + 2], pair_zero * big + rank[zeros + 2])
    place = before + np.arange(len(zeros))
    out = np.empty(n, np.int64)
    taken = np.zeros(n, bool)
    taken[place] = True
    out[place] = zeros
    out[~taken] = sampled
    return out


def equal_to_previous(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix in order shares ``length`` symbols with the one before it.

    ``text`` holds bytes. Prefixes of neighbours are compared in words of eight bytes,
    first ones first, so that pairs that differ early cost little; the last word may
    overlap the one before it.
    """
    n = len(text)
    same = np.zeros(len(order), bool)
    if len(order) < 2:
        return same
    live = np.flatnonzero((order[1:] + length <= n) & (order[:-1] + length <= n)) + 1
    size = 8 if length >= 8 else 1
    # The word at each byte, overlapping.
    words = np.ndarray((max(n - size + 1, 0),), f"<u{size}", np.ascontiguousarray(text), strides=(1,))
    for k in [*range(0, length - size, size), length - size]:
        if not len(live):
            break
        live = live[words[order[live] + k] == words[order[live - 1] + k]]
    same[live] = True
    return same
