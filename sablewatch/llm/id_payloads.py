"""Token ids of whole texts by way of their words, each encoded once per worker.

No token of the vocabularies used here crosses from a character that is no white space
into white space. So a text's ids are those of its segments (a run of white space and
what follows it) end to end, or of its words where white space is dropped. A worker
keeps a bounded dictionary from a segment to the bytes of its ids;
a text's ids are one join of looked-up pieces. The segments themselves are the keys:
equal hashes of different segments change nothing.

A new segment of plain letters, digits and ASCII signs is cut into the tokenizer's
pieces here, which its merges then take one by one, because the library's own
normalizer and splitter cost several times its merges; any other segment goes to the
library whole. Both ways give the library's ids. Where white space is kept, a text of such
characters alone is cut into pieces at once, without segments.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np

#: Segments, and pieces, that a worker keeps; then it starts over. Speed only.
KEPT = 600_000
#: Longer segments are encoded each time they occur.
LONGEST_KEPT = 64
#: A text is split at a time into segments about so many bytes long together.
CHUNK_BYTES = 1 << 20

# White space follows an ASCII sign, letter or digit: a segment starts there.
_EDGE = re.compile(rb"(?<=[!-~])[ \t-\r]")
# Letters that neither normal forms nor context change, and plain ASCII.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(rf"[!-~{_LETTERS}]+")
_PLAIN_SEGMENT = re.compile(rf"[ \t-\r]*[!-~{_LETTERS}]*")
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
_PLAIN_TEXT = re.compile(rf"[ \t-\r!-~{_LETTERS}]*")
_WORD_PIECES = re.compile(rf"{_SHORT}|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")
_BYTE_PIECES = re.compile(
    rf"{_SHORT}| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_SEGMENT = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")


def byte_spelling() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[b] = chr(256 + n)
    return out


def chunks(text: bytes, size: int = CHUNK_BYTES) -> Iterator[bytes]:
    """Parts of a text of about ``size`` bytes that begin where a segment does."""
    at = 0
    while len(text) - at > size:
        found = _EDGE.search(text, at + size)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def _plain_words(word: str) -> list[str] | None:
    """Lower-case pieces of a word whose white space the tokenizer drops."""
    if word.isascii() and word.isalpha():
        return [word.lower()]
    if not _PLAIN.fullmatch(word) or "<|" in word:
        return None
    return _WORD_PIECES.findall(word.lower())


def _plain_segments(segment: str) -> list[str] | None:
    if segment.isascii() and segment.removeprefix(" ").isalpha():
        return [segment]
    if not _PLAIN_SEGMENT.fullmatch(segment) or "<|" in segment:
        return None
    return _BYTE_PIECES.findall(segment)


class _Pieces(dict):
    """A piece -> the bytes of its ids, by the model's merges alone."""

    def __init__(self, model, code: str, kept: int) -> None:
        super().__init__()
        self.tokenize, self.code, self.kept = model.tokenize, code, kept
        self.spelling = byte_spelling()
        self.space = self.spelling[32]

    def __missing__(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():
            spelled = piece.replace(" ", self.space)
        else:
            spelled = piece.encode().decode("latin-1").translate(self.spelling)
        out = array(self.code, [t.id for t in self.tokenize(spelled)]).tobytes()
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= self.kept:
                self.clear()
            self[piece] = out
        return out


class IdPayloads(dict):
    """A segment -> the bytes of its ids."""

    def __init__(self, path: str, kept: int = KEPT) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.kind, self.code = np.dtype("u4" if wide else "u2"), "I" if wide else "H"
        self.kept = kept
        self.pieces = _Pieces(self.tokenizer.model, self.code, kept)
        self.split, self.cut = _rules(json.loads(Path(path).read_text()))

    def __missing__(self, segment) -> bytes:
        text = segment.decode() if isinstance(segment, bytes) else segment
        parts = self.cut(text)
        out = self._library(text) if parts is None else b"".join(map(self.pieces.__getitem__, parts))
        if len(segment) <= LONGEST_KEPT:
            if len(self) >= self.kept:
                self.clear()
            self[segment] = out
        return out

    def _library(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _ids(self, part: bytes) -> bytes:
        if self.cut is _plain_segments:
            text = part.decode()
            if "<|" not in text and _PLAIN_TEXT.fullmatch(text):
                return b"".join(map(self.pieces.__getitem__, _BYTE_PIECES.findall(text)))
        return b"".join(map(self.__getitem__, self.split(part)))

    def encode(self, text: bytes) -> np.ndarray:
        """The ids of a whole text."""
        parts = [self._ids(part) for part in chunks(text)]
        return np.frombuffer(parts[0] if len(parts) == 1 else b"".join(parts), self.kind)


def _rules(spec: dict) -> tuple[Callable[[bytes], list], Callable[[str], list[str] | None]]:
    """How a tokenizer's texts are split into segments, and segments into plain pieces."""
    def kinds(part):
        return [] if not part else [x["type"] for x in part.get("normalizers") or part.get("pretokenizers") or [part]]

    normal, before = kinds(spec["normalizer"]), kinds(spec["pre_tokenizer"])
    if spec["model"]["type"] == "BPE" and not normal and before == ["ByteLevel"]:
        return lambda raw: _SEGMENT.findall(raw.decode()), _plain_segments
    if spec["model"]["type"] == "BPE" and normal == ["NFC", "Replace", "Lowercase"] and before == ["Split", "ByteLevel"]:
        return bytes.split, _plain_words
    raise ValueError(f"no rule for a tokenizer with {normal} and {before}")


_KNOWN: dict[str, IdPayloads] = {}


def id_payloads(path: str) -> IdPayloads:
    """This worker's dictionary for a tokenizer file; ``path`` must exist on each node."""
    if path not in _KNOWN:
        _KNOWN[path] = IdPayloads(path)
    return _KNOWN[path]
