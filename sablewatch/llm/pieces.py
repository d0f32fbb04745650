"""SentencePiece BPE encoding by a table of each prefix's last token, and decoding.

A sequence of pieces is the BPE encoding of its text exactly if every neighbouring
pair is *compatible*: merging the two pieces' text gives back those two pieces. So
each prefix of a text has one last piece, and the whole encoding follows from that
table. ``PieceCodec.encode_text`` finds, with an automaton, the pieces that end at
each character, keeps the one that is compatible with the last piece of the prefix
before it, and reads the ids backwards from the end.

Compatibility is tested on merge trees: while the pieces are built, some symbol of
the left piece ends, and some symbol of the right piece starts, at the joint. The
pair is incompatible if at some time a merge over the joint comes before the merges
that use up either symbol; of equal ranks the left one comes first.

Texts are cut into segments that no piece crosses (before a run of spaces, around
newlines) where the vocabulary allows, and met segments are kept per worker.

Null or empty text: no ids, and decoded to the empty text. The character U+2581
reads as a space, as in the library. Other columns are ignored; each row gives a row.
"""

from __future__ import annotations

import hashlib
import struct

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sablewatch.llm.blocks import Block, map_blocks
from sablewatch.llm.registry import query, table
from sablewatch.llm.segments import Ragged, SegmentTable

MARK = "▁"
#: Piece types of the model file (fixed by the format).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_NEVER = 1 << 60
_CODECS: dict[str, PieceCodec] = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(raw: bytes):
    """``(number, value)`` of a protobuf message's fields."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            yield tag >> 3, raw[at : at + size]
            at += size
        else:
            size = 4 if kind == 5 else 8
            yield tag >> 3, raw[at : at + size]
            at += size


def read_model(path: str) -> list[tuple[str, float, int]]:
    """``(piece, score, type)`` of every id of a model file.

    Only models as the codec encodes are taken: BPE, no rewriting of characters, a
    space put before the text, spaces kept, no user-defined pieces.
    """
    with open(path, "rb") as f:
        raw = f.read()
    pieces, trainer, normalizer = [], {}, {}
    for number, value in _fields(raw):
        if number == 1:
            own = dict(_fields(value))
            score = struct.unpack("<f", own[2])[0] if 2 in own else 0.0
            pieces.append((own[1].decode(), score, own.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normalizer = dict(_fields(value))
    plain = (trainer.get(3) == 2 and not normalizer.get(2) and normalizer.get(3, 1)
             and not normalizer.get(4, 1) and normalizer.get(5, 1))
    if not plain or any(kind in (USER_DEFINED, UNUSED) for _, _, kind in pieces):
        raise ValueError("the model needs a normalizer or pieces that are not supported")
    return pieces


class PieceCodec:
    def __init__(self, path: str) -> None:
        pieces = read_model(path)
        normal = [(-score, i, piece) for i, (piece, score, kind) in enumerate(pieces)
                  if kind == NORMAL]
        self.ids = {piece: i for _, i, piece in normal}
        # The order in which merges are tried; of equal ranks the leftmost is first.
        order = {score: r for r, score in enumerate(sorted({score for score, _, _ in normal}))}
        self.rank = {piece: order[score] for score, _, piece in normal}
        self.byte_ids = {int(piece[3:5], 16): i for i, (piece, _, kind) in enumerate(pieces)
                         if kind == BYTE}
        self.unknown = next(i for i, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN)
        self.is_byte = np.array([kind == BYTE for _, _, kind in pieces])
        self.automaton = ahocorasick.Automaton()
        self.right: dict[str, list[tuple[str, int, int]]] = {}
        self.left: dict[str, list[tuple[str, int, int]]] = {}
        for piece in self.ids:
            tree = self._tree(piece)
            if tree is not None:  # else merges never build it
                self.automaton.add_word(piece, piece)
                self.right[piece] = self._spine(piece, tree, 1)
                self.left[piece] = self._spine(piece, tree, 0)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        joined = set("".join(p for p in self.ids if len(p) > 1))
        inner = any(a != MARK and b == MARK for p in self.ids for a, b in zip(p, p[1:], strict=False))
        self.cut_spaces, self.cut_lines = not inner, "\n" not in joined
        self.pieces = Ragged(np.uint8)
        self.pieces.append([self._surface(*p) for p in pieces])
        self.digits = Ragged(np.uint8)
        self.digits.append([np.frombuffer(b"%d," % i, np.uint8) for i in range(len(pieces))])
        self.table = SegmentTable(
            lambda found: {"ids": [np.array(self.encode_text(p.decode().replace(" ", MARK)), np.int32)
                                   for p in found]}, {"ids": np.int32})

    @staticmethod
    def _surface(piece: str, score: float, kind: int) -> np.ndarray:
        raw = {BYTE: lambda: bytes([int(piece[3:5], 16)]), CONTROL: lambda: b"",
               UNKNOWN: lambda: " ⁇ ".encode()}.get(kind, piece.replace(MARK, " ").encode)()
        return np.frombuffer(raw, np.uint8)

    # -- merges ----------------------------------------------------------- #

    def _tree(self, text: str) -> dict[str, tuple[str, str]] | None:
        """Every merge's two parts while ``text`` becomes one symbol, or None."""
        symbols, parts = list(text), {}
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1),
                       key=lambda i: (self.rank.get(symbols[i] + symbols[i + 1], _NEVER), i))
            merged = symbols[best] + symbols[best + 1]
            if merged not in self.rank:
                return None
            parts[merged] = symbols[best], symbols[best + 1]
            symbols[best : best + 2] = [merged]
        return parts

    def _spine(self, piece: str, tree: dict, side: int) -> list[tuple[str, int, int]]:
        """Symbols at the piece's right (1) or left (0) edge, with the ranks of the
        merges that make and that use up each."""
        out, used = [], _NEVER
        while True:
            made = self.rank[piece] if piece in tree else -1
            out.append((piece, made, used))
            if piece not in tree:
                return out
            piece, used = tree[piece][side], made

    def compatible(self, a: str, b: str) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            known = all(
                merge >= a_used or merge > b_used or a_made > b_used or b_made >= a_used
                for x, a_made, a_used in self.right[a]
                for y, b_made, b_used in self.left[b]
                if (merge := self.rank.get(x + y)) is not None)
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            self.pairs[a, b] = known
        return known

    # -- encoding --------------------------------------------------------- #

    def encode_text(self, text: str) -> list[int]:
        """Ids of a text in which spaces are already written as U+2581."""
        last: list[str | None] = [None] * len(text)  # None: a character without a piece
        at = -1
        for end, piece in self.automaton.iter(text):
            start = end + 1 - len(piece)
            if last[end] is not None and at == end:
                continue  # the last piece of a prefix is unique
            if start == 0 or last[start - 1] is None or self.compatible(last[start - 1], piece):
                last[end], at = piece, end
        out: list[int] = []
        end = len(text)
        while end:
            piece = last[end - 1]
            if piece is None:
                end -= 1
                raw = text[end].encode()
                ids = [self.byte_ids.get(b, self.unknown) for b in raw]
                out.extend(reversed(ids) if self.byte_ids else [self.unknown])
            else:
                end -= len(piece)
                out.append(self.ids[piece])
        out.reverse()
        return out

    def encode_block(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and each text's edges in them."""
        data, bounds = block.data, block.bounds
        mark = MARK.encode()
        if mark in data.tobytes():
            texts = [block.text(i).replace(mark, b" ") for i in range(len(block))]
            bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            data = np.frombuffer(b"".join(texts), np.uint8)
        # A space goes before each text that is not empty.
        filled = np.diff(bounds) > 0
        data = np.insert(data, bounds[:-1][filled], 0x20)
        bounds = bounds + np.concatenate([[0], np.cumsum(filled)])
        starts = [bounds[:-1]]
        if self.cut_spaces:
            space = data == 0x20
            space[1:] &= data[:-1] != 0x20
            starts.append(np.flatnonzero(space))
        if self.cut_lines:
            lines = np.flatnonzero(data == 0x0A)
            starts += [lines, lines + 1]
        start = np.unique(np.concatenate(starts))
        start = start[start < len(data)]
        rows = self.table.look_up(data, start, np.append(start[1:], len(data)))
        ids, lengths = self.table.columns["ids"].take(rows)
        edges = np.concatenate([[0], np.cumsum(lengths)])
        return ids, edges[np.searchsorted(start, bounds)]

    # -- decoding --------------------------------------------------------- #

    def decode_block(self, ids: np.ndarray, edges: np.ndarray) -> list[bytes]:
        """The UTF-8 text of each ``ids[edges[i]:edges[i+1]]``."""
        flat, lengths = self.pieces.take(ids)
        ends = np.concatenate([[0], np.cumsum(lengths)])[edges]
        raw, out = flat.tobytes(), []
        has_bytes = np.concatenate([[0], np.cumsum(self.is_byte[ids])])[edges]
        for i, (lo, hi) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            text = raw[lo:hi]
            if text[:1] == b" " and not self.is_byte[ids[edges[i]]]:
                text = text[1:]
            if has_bytes[i + 1] > has_bytes[i]:
                text = replace_invalid(text)
            out.append(text)
        return out


def replace_invalid(raw: bytes) -> bytes:
    """Each byte that belongs to no UTF-8 character becomes U+FFFD."""
    out = []
    while True:
        try:
            raw.decode()
            return b"".join([*out, raw])
        except UnicodeDecodeError as e:
            out += [raw[: e.start], "�".encode()]
            raw = raw[e.start + 1 :]


def codec(path: str) -> PieceCodec:
    """This worker's codec for a model file that is on each node."""
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def _id_type(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()


def encode_pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                  model: str | None = None) -> DataFrame:
    """``doc_id, ids`` of every row."""
    path = model or default_model()
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(block, rows):
        ids, edges = codec(path).encode_block(block)
        return {"doc_id": rows.column(0),
                "ids": pa.ListArray.from_arrays(edges.astype(np.int32), pa.array(ids, pa.int32()))}

    return map_blocks(source, "text", run, f"doc_id {_id_type(source)}, ids array<int>")


def decode_pieces(encoded: DataFrame, *, model: str | None = None) -> DataFrame:
    """``doc_id, text`` of rows ``doc_id, ids``; null ids give an empty text."""
    path = model or default_model()
    source = encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            edges = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)
            texts = codec(path).decode_block(ids, edges)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "text": pa.array([t.decode() for t in texts], pa.string())})

    return source.mapInArrow(run, f"doc_id {_id_type(source)}, text string")


def piece_round_trip(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                     model: str | None = None) -> DataFrame:
    """Counts and digests of each text's ids and of the text decoded from them.

    Encoding and decoding run in one pass, so ids are not carried between stages.
    """
    path = model or default_model()
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(block, rows):
        own = codec(path)
        ids, edges = own.encode_block(block)
        digits, lengths = own.digits.take(ids)
        ends = np.concatenate([[0], np.cumsum(lengths)])[edges]
        view = memoryview(digits)
        sums = [hashlib.sha256(view[lo : max(lo, hi - 1)]).hexdigest()
                for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        texts = own.decode_block(ids, edges)
        return {"doc_id": rows.column(0), "n_tokens": np.diff(edges), "ids_sha256": sums,
                "decoded_sha256": [hashlib.sha256(t).hexdigest() for t in texts]}

    return map_blocks(source, "text", run, f"doc_id {_id_type(source)}, n_tokens long, "
                      "ids_sha256 string, decoded_sha256 string")


@query("op6_piece_codec")
def op6_piece_codec(spark, sf_dir):
    return piece_round_trip(table(spark, sf_dir, "documents"))
