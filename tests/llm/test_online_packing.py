"""Sum-of-squares packing against the tokenizer library and a plain placement rule."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import types as T

from sablewatch.llm.id_payloads import IdPayloads, chunks
from sablewatch.llm.online_packing import Levels, Run, op11_sum_of_squares_packing, pack_tokens, settle

ODD = [None, "", " ", "\n\t", "a", "The Quick  brown", "x\x1cy\x85z q　r", "É é É  ǅ İ ΑΣ ΑΣΑ",
       "<|endoftext|> a<|startoftext|>b <|endo ftext|>", "it's WE'LL 'd 12345 3.14 a1b2", "日本語 😀😀 ‍x ́ y ́z",
       "word " * 3000, "x" * 5000, "!?" * 700 + " \x0b\x0c end"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéñÄ1,.'") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    return ODD + [" ".join(rng.choices(words, k=rng.choice([1, 5, 50, 400, 900]))) for _ in range(150)]


def check_sequences(rows, capacity):
    """Every sequence is gapless and full or a power of two; every document is whole."""
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, r.length, r.doc_tokens))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at and length > 0
            at += length
        assert at == capacity or at & (at - 1) == 0 and at < capacity
    for held in pieces.values():
        at = 0
        for start, length, total in sorted(held):
            assert start == at
            at += length
        assert at == total


@pytest.mark.parametrize("max_open", [4096, 3])
def test_equal_to_the_library(spark, texts, library, max_open):
    schema = "doc_id long, text string, ids string, start int, length string"
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in enumerate(texts)], schema).repartition(3)
    rows = pack_tokens(docs, capacity=256, max_open=max_open).collect()
    check_sequences(rows, 256)
    found = defaultdict(list)
    for r in rows:
        found[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    for i, text in enumerate(texts):
        want = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        assert [x for _, part in sorted(found[i]) for x in part] == want, repr(text)[:200]


def test_placement_takes_the_least_sum_of_squares():
    rng = random.Random(3)
    capacity = 40
    levels, plain = Levels(capacity), Counter()
    for _ in range(3000):
        size = rng.choice([rng.randint(1, 39), 7, 13, 26])

        def total(h, size=size):
            after = plain.copy()
            if h:
                after[h] -= 1
            if h + size < capacity:
                after[h + size] += 1
            return sum(n * n for n in after.values())

        options = [h for h in [0, *(h for h, n in plain.items() if n)] if h + size <= capacity]
        best = min(total(h) for h in options)
        want = max(h for h in options if total(h) == best)
        got = levels.choose(size)
        assert got == want
        window = levels.take(got)
        if got:
            plain[got] -= 1
        if got + size < capacity:
            levels.add(got + size, [*window, size])
            plain[got + size] += 1
    assert {h: n for h, n in enumerate(levels.counts.tolist()) if n} == {h: n for h, n in plain.items() if n}


def test_settling_moves_every_id_once():
    rng = random.Random(9)
    for _ in range(200):
        windows = []
        for row in range(rng.randint(0, 6)):
            n = rng.randint(1, 63)
            cut = rng.randint(0, n - 1)
            windows.append((n, [(row, 0, cut), (row, cut, n - cut)] if cut else [(row, 0, n)]))
        windows.sort(key=lambda w: -w[0])
        out = list(settle(windows, 64))
        ids = [(row, i) for s in out for row, start, n in s for i in range(start, start + n)]
        assert sorted(ids) == sorted((row, i) for n, w in windows for row, i in [(w[0][0], k) for k in range(n)])
        sizes = [sum(n for _, _, n in s) for s in out]
        assert all(s == 64 or s & (s - 1) == 0 for s in sizes)


def test_open_windows_are_bounded():
    run = Run(100, 5)
    for row in range(50):
        list(run.put(row, 60))
        assert run.levels.open <= 6


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_payloads_equal_the_library(monkeypatch, name):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    known, whole = IdPayloads(path, kept=40), Tokenizer.from_file(path)
    rng = random.Random(8)
    alphabet = ["a", "B", "é", "É", "ß", "ÿ", "Ñ", "İ", "'s", "'LL", "'", "1", "²", "ª", ".", "<|", "|>", "_", "\u0301", " ", "  ", "\n", "\t",
                "\xa0", "\x85", "\u3000", "\x1c", "\x00", "日", "😀", "<|endoftext|>", "×", "Σ", "the"]
    texts = [t or "" for t in ODD] + ["".join(rng.choices(alphabet, k=rng.randint(1, 40))) for _ in range(1500)]
    for text in texts:
        assert known.encode(text.encode()).tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)
    monkeypatch.setattr("sablewatch.llm.id_payloads.CHUNK_BYTES", 7)
    monkeypatch.setattr(chunks, "__defaults__", (7,))
    for text in texts:
        assert known.encode(text.encode()).tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_odd_tables(spark, library):
    schema = T.StructType().add("doc_id", "long").add("text", "string")
    assert pack_tokens(spark.createDataFrame([], schema)).count() == 0
    rows = pack_tokens(spark.createDataFrame([(None, "a b"), (None, "a b"), (3, None)], schema).coalesce(1)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.length) for r in rows if r.start == 0) and \
        sum(r.length for r in rows) == 2 * (len(library.encode("a b").ids) + 1) + 1


def test_query_on_documents(spark, library):
    sf_dir = "/root/testdata/sf0.001"
    rows = op11_sum_of_squares_packing(spark, sf_dir).collect()
    check_sequences(rows, 2048)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        ids = [*library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1]
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())


def test_plain_texts_are_cut_into_pieces_without_segments():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    known, whole = IdPayloads(path), Tokenizer.from_file(path)
    for text in ("It's plain,  été 1999!\n\n\tend  ", " \n x", "", "a \n \n b'll don't"):
        assert known.encode(text.encode()).tolist() == whole.encode(text, add_special_tokens=False).ids
    assert known.pieces and not len(known)
