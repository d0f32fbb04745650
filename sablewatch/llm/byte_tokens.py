"""Byte-level BPE ids and token spans of whole texts, by segment table."""

from __future__ import annotations

import os

import numpy as np

from sablewatch.llm.blocks import Block
from sablewatch.llm.segments import SegmentTable, white_space_segments

_TABLES: dict[tuple[str, bool], SegmentTable] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_spelling() -> dict[str, int]:
    """The character that byte-level BPE vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(256 + n)] = b
    return out


def token_table(path: str, with_spans: bool) -> SegmentTable:
    """This worker's table for a tokenizer file; ``path`` must exist on each node.

    Columns: ``ids``; with spans also ``chars``, the code points that start in
    each token, so that a code point split over tokens counts for its first.
    """
    key = (path, with_spans)
    if key in _TABLES:
        return _TABLES[key]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    starts_in = None
    if with_spans:
        spelling = byte_spelling()
        starts_in = np.zeros(tokenizer.get_vocab_size(), np.int64)
        for token, i in tokenizer.get_vocab().items():
            raw = [spelling.get(c, 0) for c in token]
            starts_in[i] = sum((b & 0xC0) != 0x80 for b in raw)

    def encode(pieces: list[bytes]) -> dict[str, list[np.ndarray]]:
        found = tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)
        ids = [np.array(x.ids, np.int32) for x in found]
        out = {"ids": ids}
        if starts_in is not None:
            out["chars"] = [starts_in[x] for x in ids]
        return out

    columns = {"ids": np.int32} | ({"chars": np.int32} if with_spans else {})
    return _TABLES.setdefault(key, SegmentTable(encode, columns))


def encode_block(block: Block, table: SegmentTable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts end to end, the edges of each text in them, and the rows used."""
    starts, ends = white_space_segments(block)
    rows = table.look_up(block.data, starts, ends)
    ids, lengths = table.columns["ids"].take(rows)
    edges = np.concatenate([[0], np.cumsum(lengths)])
    return ids, edges[np.searchsorted(starts, block.bounds)], rows
