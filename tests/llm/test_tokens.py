"""Token operators against the tokenizer libraries, text by text."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import types as T

from sablewatch.llm import attribution, pieces, token_store
from sablewatch.session import shared_folder

ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b   c    d", "\n\n x\n  y \t z", "▁ a▁b", "  x   y",
    "x　 y  z  q", "naïve café ÉÀ 日本語 한국어 😀😀 \U0001f468‍\U0001f469", "<s> </s> <0x0A> <unk> <|endoftext|>",
    "it's we'll 12345 3.14 a1b2", "\x00\x01\x1c \x1d\x85 x", "the the the " * 50, " " * 40 + "x" + " " * 17, "aaaaaaaaaaaaaaaaaaaa" * 30,
    "!!!???...,,,;;;:::" * 9, "tab\t\ttab\r\nnew\x0b\x0cline",
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    alphabet = "abcdeéñ tion  the\n\t.,'!19ß日😀▁"
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 120))) for _ in range(300)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    schema = "doc_id long, text string, n_tokens int, ids string"
    return spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], schema).repartition(3)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_pieces_equal_the_library(docs, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    got = {r.doc_id: r for r in pieces.piece_round_trip(docs).collect()}
    ids = {r.doc_id: list(r.ids) for r in pieces.encode_pieces(docs).collect()}
    back = {r.doc_id: r.text for r in pieces.decode_pieces(pieces.encode_pieces(docs)).collect()}
    for i, text in enumerate(texts):
        want = sp.encode(text or "")
        assert ids[i] == want, repr(text)
        assert back[i] == sp.decode(want), repr(text)
        assert got[i].n_tokens == len(want)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(sp.decode(want).encode()).hexdigest()


def test_decode_of_any_ids(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    rng = random.Random(3)
    lists = [[rng.choice([rng.randrange(3, 259), rng.randrange(259, 32000), 259]) for _ in range(rng.randint(0, 9))]
             for _ in range(300)] + [None]
    df = spark.createDataFrame(list(enumerate(lists)), "doc_id long, ids array<int>")
    for r in pieces.decode_pieces(df).collect():
        assert r.text == sp.decode(lists[r.doc_id] or []), lists[r.doc_id]


def test_segment_tables_forget_without_changing_results(texts):
    own = pieces.PieceCodec(pieces.default_model())
    own.table.limit = 5
    from sablewatch.llm.blocks import blocks
    import pyarrow as pa

    found = []
    for block in blocks(pa.array(texts), 200):
        ids, edges = own.encode_block(block)
        found += [ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)]
    assert found == [pieces.codec(pieces.default_model()).encode_text(
        "" if not t else "▁" + t.replace(" ", "▁")) for t in texts]


def test_token_store(spark, docs, texts, library):
    extra = spark.createDataFrame([(None, "null id"), (3, "second"), (3, "second")], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(extra)
    store = token_store.write_store(rows, shared_folder(spark, "store"), shards=4)
    got = token_store.read_store(token_store.stored_keys(rows), store).collect()
    assert len(got) == len(texts) + 3
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.key for r in ordered] == sorted(r.key for r in got)
    at = 0
    for r in ordered:
        assert (r.start, r.n_tokens) == (at, len(r.ids) // 2)
        at += r.n_tokens
    by_key = {(r.key, r.nth): np.frombuffer(r.ids, "<u2").tolist() for r in got}
    want = {i: library.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    for i in want:
        if i != 3:
            assert by_key[i, 0] == want[i], repr(texts[i])
    second = library.encode("second").ids + [2]
    assert sorted(by_key[3, n] for n in range(3)) == sorted([want[3], second, second])
    unknown = spark.createDataFrame([(10**9 + i, 0) for i in range(200)], "key long, nth long")
    assert token_store.read_store(unknown, store).count() == 0


def test_perfect_hash_is_minimal():
    keys = token_store.key_hash(np.arange(100_000), np.zeros(100_000, np.int64))
    index = token_store.PerfectHash.build(keys)
    assert sorted(index.slots(keys).tolist()) == list(range(100_000))
    assert sum(w.nbytes for w in index.levels) * 8 / 100_000 < 4


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pieces.piece_round_trip(none).count() == 0
    assert attribution.token_attribution(none, ["text"]).count() == 0
    store = token_store.write_store(none, shared_folder(spark, "store"))
    assert token_store.read_store(token_store.stored_keys(none), store).count() == 0


def test_op10_query(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in token_store.op10_token_store(spark, sf).collect()}
    at = 0
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        ids = library.encode(r.text, add_special_tokens=False).ids + [2]
        assert tuple(got[r.doc_id])[1:] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


@pytest.mark.parametrize("rule", attribution.RULES)
def test_attribution_equals_brute_force(spark, texts, library, rule):
    rows = [(i, t, texts[-i], "k") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, a string, b string, field string").repartition(2)
    got = {}
    for r in attribution.token_attribution(df, ["a", "b"], split=("b",), rule=rule).collect():
        got.setdefault(r.doc_id, []).append((r.field, r.section, r.start_char, r.n_chars, r.n_tokens))
    for i, a, b, _ in rows:
        a, b = a or "", b or ""
        text = f"{a}\n{b}"
        sections = [("a", 0, 0, len(a) + 1)]
        at = len(a) + 1
        for k, line in enumerate(b.split("\n")):
            size = len(line) + (k < b.count("\n"))
            sections.append(("b", k, at, size))
            at += size
        counts = [0] * len(sections)
        for s, e in library.encode(text, add_special_tokens=False).offsets:
            share = [max(0, min(e, x[2] + x[3]) - max(s, x[2])) for x in sections]
            hit = [k for k, n in enumerate(share) if n]
            counts[{"first": hit[0], "last": hit[-1], "most": share.index(max(share))}[rule]] += 1
        want = [(*s, n) for s, n in zip(sections, counts, strict=True)]
        assert sorted(got[i]) == sorted(want), repr(text)


def colliding_pair() -> tuple[str, str]:
    """Two texts of 1,024 letters with equal polynomial sums modulo 2**64, whatever the base."""
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_no_collision_of_alternating_texts(spark, library):
    from sablewatch.llm.blocks import PieceHash

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    one, two = colliding_pair()
    data = np.frombuffer((one + two).encode(), np.uint8)
    a, b = PieceHash(data)(np.array([0, 1024]), np.array([1024, 2048]))
    assert a != b
    docs = spark.createDataFrame([(0, one), (1, two), (2, f"{one} {two}")], "doc_id long, text string").coalesce(1)
    for r in pieces.encode_pieces(docs).collect():
        assert list(r.ids) == sp.encode([one, two, f"{one} {two}"][r.doc_id])
    store = token_store.write_store(docs, shared_folder(spark, "store"), shards=1)
    for r in token_store.read_store(token_store.stored_keys(docs), store).collect():
        assert np.frombuffer(r.ids, "<u2").tolist()[:-1] == library.encode([one, two, f"{one} {two}"][r.key]).ids


def test_a_false_hit_gets_a_row_of_its_own(monkeypatch):
    """With a hash that tells nothing apart, segments still get their own ids."""
    from sablewatch.llm import segments

    monkeypatch.setattr(segments, "PieceHash", lambda data: lambda start, end: np.zeros(len(start), np.uint64))
    known = segments.SegmentTable(lambda found: {"ids": [np.array([len(p), p[0]]) for p in found]}, {"ids": np.int64})
    data = np.frombuffer(b"aabbbacc", np.uint8)
    for _ in range(2):
        rows = known.look_up(data, np.array([0, 2, 5, 6]), np.array([2, 5, 6, 8]))
        ids, _ = known.columns["ids"].take(rows)
        assert ids.reshape(-1, 2).tolist() == [[2, 97], [3, 98], [1, 97], [2, 99]]


def test_store_of_one_hot_id(spark, library):
    """Rows of one id, and of no id, lie in several shards and are numbered through."""
    rows = [(7, f"text {i % 40}") for i in range(300)] + [(None, f"none {i}") for i in range(150)] + [(i, "x") for i in range(100, 180)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    store = token_store.write_store(docs, shared_folder(spark, "store"), shards=6)
    got = token_store.read_store(token_store.stored_keys(docs), store).collect()
    assert len({(r.key, r.nth) for r in got}) == len(rows) == len(got)
    assert sorted(r.nth for r in got if r.key == 7) == list(range(300))
    found = sorted((r.key, np.frombuffer(r.ids, "<u2").tolist()) for r in got)
    null = -(1 << 63)
    assert found == sorted((null if k is None else k, library.encode(t).ids + [2]) for k, t in rows)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_schema_of_ids_is_kept(spark):
    df = spark.createDataFrame([("k", "a b")], "doc_id string, text string")
    assert pieces.encode_pieces(df).schema["doc_id"].dataType == T.StringType()
