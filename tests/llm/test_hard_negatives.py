"""Hard negatives against plain scoring of all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sablewatch.llm import hard_negatives
from sablewatch.llm.hard_negatives import Anchors, encode, mine_hard_negatives, rotation
from tests.check_oracles import compare, connect


def brute_force(rows, is_anchor, positives=5, negatives=3):
    rows = {(i, label, tuple(v)) for i, label, v, *_ in rows
            if i is not None and label is not None and v is not None and None not in v}
    dim = max((len(v) for *_, v in rows), default=0)
    grown = [(i, label, np.array(v + (0,) * (dim - len(v)), np.int64)) for i, label, v in rows]
    out = []
    for i, label, v in grown:
        if not is_anchor(i):
            continue
        scored = sorted((-int(w @ v), j, other) for j, other, w in grown if j != i)
        best = [(j, -s) for s, j, other in scored if other == label][:positives]
        for j, score in best:
            inside = [(m, -s) for s, m, other in scored
                      if other != label and 50 * score <= -100 * s <= 95 * score][:negatives]
            out += [(i, j, rank + 1, m, score, s) for rank, (m, s) in enumerate(inside)]
    return sorted(out)


def found(spark, rows, anchors, schema="vec_id long, label int, embedding array<long>, node string, score int", **more):
    df = spark.createDataFrame(rows, schema).repartition(3)
    return sorted(tuple(r) for r in mine_hard_negatives(df, anchors, **more).collect())


def rows_of(n, dim, spread, seed, labels=4):
    rng = random.Random(seed)
    return [(i, rng.randrange(labels), [rng.randint(-spread, spread) for _ in range(dim)], "x", 1) for i in range(n)]


@pytest.mark.parametrize("spread", [1, 60])
def test_equal_to_all_pairs(spark, monkeypatch, spread):
    monkeypatch.setattr(hard_negatives, "BLOCK", 90)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 7)
    monkeypatch.setattr(hard_negatives, "SEEDS", 6)
    rows = rows_of(700, 12, spread, 3)
    rows += [(1000 + i, 2, rows[5][2], "x", 1) for i in range(300)]  # a hot vector, many ties
    rows += [rows[0], rows[50], rows[50], (50, 1, [1] * 12, "x", 1)]  # repeated rows and ids
    got = found(spark, rows, F.col("vec_id") % 25 == 0)
    assert got == brute_force(rows, lambda i: i % 25 == 0)


def test_odd_rows(spark):
    rows = [(0, 1, [3, 4], "x", 1), (1, 1, [3], "x", 1), (2, 2, [2, 2, 0, 1], "x", 1), (3, 2, [], "x", 1), (None, 1, [9, 9], "x", 1),
            (4, None, [9, 9], "x", 1), (5, 1, None, "x", 1), (6, 2, [None, 1], "x", 1), (7, 1, [0, 0], "x", 1), (8, 2, [1, 1], "x", 1)]
    assert found(spark, rows, F.col("vec_id") >= 0) == brute_force(rows, lambda i: True)
    assert found(spark, rows, F.lit(None).cast("boolean")) == []
    assert found(spark, [], F.col("vec_id") >= 0) == []
    assert found(spark, [(0, 1, [], "x", 1), (1, 1, [], "x", 1), (2, 2, [], "x", 1)], F.col("vec_id") == 0) == [(0, 1, 1, 2, 0, 0)]


def test_intervals_hold_and_filter():
    rng = np.random.default_rng(1)
    for vectors in (rng.integers(-100, 100, (400, 24)), rng.integers(0, 2, (400, 24)), np.zeros((3, 24), np.int64),
                    rng.integers(-5, 6, (300, 1))):
        dim = vectors.shape[1]
        turn = rotation(dim, 64 * -(-4 * dim // 64))
        code, norm, along, length = encode(vectors, turn)
        exact = vectors @ vectors.T
        _, low, high = Anchors(vectors, turn).intervals(slice(None), code, norm, along, length)
        assert (low <= exact).all() and (exact <= high).all()
        if dim == 24 and len(vectors) == 400 and vectors.min() < 0:
            width = (high - low) / (norm[:, None] * norm)
            assert width.mean() < 1.0  # [-1, 1] would be no knowledge


def test_scores_beyond_64_bits_stop_the_job(spark):
    rows = [(i, i % 2, [2**31, 2**31], "x", 1) for i in range(4)]
    with pytest.raises(Exception, match="64 bits"):
        found(spark, rows, F.col("vec_id") == 0)


def test_query_equals_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    name = "op12_hard_negatives"
    ok, note, _ = compare(connect(sf_dir), spark, name, entry.queries()[name], entry.oracle_sql()[name], sf_dir)
    assert ok, note
