"""Document operators against brute force on small tables."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sablewatch.llm import line_dedup, multi_index, near_dedup, ordinal, packing, repeats, repetition
from sablewatch.llm.suffix_array import equal_to_previous, suffix_array

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bin int, kept string"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [line(14) for _ in range(4)]
    out = [None, "", " ", "\n\n", "a", "a b c", "a b c", line(4000)]
    for i in range(60):
        lines = [line(rng.randint(1, 20)) for _ in range(rng.randint(1, 6))]
        if i % 3 == 0:
            lines.insert(rng.randrange(len(lines) + 1), rng.choice(shared))
        out.append("\n".join(lines))
    for base in out[10:30]:  # copies with few edits
        for _ in range(rng.choice([1, 1, 3])):
            chars = list(base)
            for _ in range(rng.choice([0, 1, 2, 6])):
                at = rng.randrange(len(chars))
                chars[at : at + rng.choice([0, 1])] = rng.choice(["x", "", "yz"])
            out.append("".join(chars))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(None if i == 9 else i, t, "xx", f"s{i % 3}" if i % 7 else None, 0, 7, "k") for i, t in enumerate(texts)]
    rows += [rows[12], rows[40]]  # repeated rows
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def key(i):
    return (i is not None, i or 0)


def rows_of(docs):
    return sorted({(r.doc_id, r.text) for r in docs.collect()}, key=lambda r: (key(r[0]), r[1] or ""))


def test_edit_distance_band():
    def full(a, b):
        last = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            now = [i]
            for j, y in enumerate(b, 1):
                now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
            last = now
        return last[-1]

    rng = random.Random(2)
    for _ in range(4000):
        a = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9)))
        b = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9)))
        for tau in (0, 1, 2, 3):
            assert line_dedup.within_edits(a, b, tau) == (full(a, b) <= tau), (a, b, tau)


@pytest.mark.parametrize("tau", [1, 2])
def test_line_dedup(docs, tau):
    got = {(r.doc_id, r.text) for r in line_dedup.dedup_lines(docs, tau=tau, min_bytes=12).collect()}
    seen, whole, want = [], set(), set()
    for i, text in rows_of(docs):
        if text is None:
            want.add((i, None))
            continue
        left = []
        for line in text.split("\n"):
            raw = line.encode()
            if raw.strip(b" \t\n\x0b\x0c\r"):
                hit = raw in whole or len(raw) >= 12 and any(
                    abs(len(raw) - len(s)) <= tau and line_dedup.within_edits(raw, s, tau) for s in seen)
                whole.add(raw)
                if len(raw) >= 12:
                    seen.append(raw)
                if hit:
                    continue
            left.append(line)
        want.add((i, "\n".join(left)))
    assert got == want
    assert line_dedup.dedup_lines(docs).columns == docs.columns


@pytest.mark.parametrize("tau", [1, 2])
def test_line_dedup_of_crowded_keys(spark, monkeypatch, tau):
    """Keys too large for pairs give what pairs give."""
    rng = random.Random(tau)
    words = ["", "a", "b", "aa", "ab", "ba", "aba", "bbb", "abcdé", "abcdf", "abxdf"]
    lines = ["".join(["the first part ", rng.choice(words), " of a shared notice ", rng.choice(words), rng.choice(words), " ends"])
             for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)
    seen, want = [], set()
    for i, line in enumerate(lines):
        if any(line_dedup.within_edits(line.encode(), s, tau) for s in seen):
            want.add(i)
        seen.append(line.encode())
    monkeypatch.setattr(line_dedup, "PAIRS", 2)
    got = {r.doc_id for r in line_dedup.removed_lines(docs, tau=tau, min_bytes=12).collect()}
    assert got == want and 0 < len(want) < 300


def test_line_dedup_of_a_line_in_100_000_variants(spark):
    """One segment differs by several bytes: all pairs of the key would be 5 billion."""
    rng = random.Random(5)
    names = ["".join(rng.choice("0123456789abcdef") for _ in range(6)) for _ in range(100_000)]
    before = "This notice was written for all readers and was last printed on page "
    text = before + "{} of the same edition, which is kept by the library of the town, with thanks"
    docs = spark.createDataFrame([(i, text.format(x)) for i, x in enumerate(names)], "doc_id long, text string")
    seen, equal, near = set(), set(), set()
    masks = set()
    for i, name in enumerate(names):
        own = {(name[:k], name[k + 1 :]) for k in range(6)}
        if name in seen:
            equal.add(i)
        elif own & masks:
            near.add(i)
        seen.add(name)
        masks |= own
    got = line_dedup.removed_lines(docs.repartition(8)).collect()
    assert {r.doc_id for r in got if not r.near} == equal
    assert {r.doc_id for r in got if r.near} == near
    assert len(near) > 100


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(1500):
        text = np.array([rng.randint(0, rng.choice([0, 1, 255])) for _ in range(rng.randint(0, 40))], np.uint8)
        order = suffix_array(text)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
        same = equal_to_previous(text, order, 3)
        for k in range(1, len(order)):
            a, b = text[order[k - 1] :][:3].tolist(), text[order[k] :][:3].tolist()
            assert same[k] == (a == b and len(a) == 3)


def test_repeats(docs):
    seen, want = set(), {}
    for i, text in rows_of(docs):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for at in range(len(raw) - 39):
            window = raw[at : at + 40]
            gone[at : at + 40] |= window in seen
            seen.add(window)
        want[i, text] = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
    found = repeats.cut_repeats(docs, length=40, gram=12, cell=9).collect()
    assert len(found) == docs.count()
    for r in found:
        assert repeats.kept_bytes((r.row.text or "").encode(), r.ranges)[0] == want[r.row.doc_id, r.row.text]
    assert repeats.remove_repeats(docs).columns == docs.columns


def test_repeats_of_crowded_grams(spark, docs, monkeypatch):
    """Partitions shared out give what whole ones give."""
    options = {"length": 40, "gram": 12, "cell": 9}
    want = {(r.row.doc_id, r.row.text): repeats.kept_bytes((r.row.text or "").encode(), r.ranges)[0]
            for r in repeats.cut_repeats(docs, **options).collect()}
    monkeypatch.setattr(repeats, "CROWD", 2)
    for r in repeats.cut_repeats(docs, **options).collect():
        assert repeats.kept_bytes((r.row.text or "").encode(), r.ranges)[0] == want[r.row.doc_id, r.row.text]


def test_repeats_of_a_passage_in_9_000_contexts(spark, monkeypatch):
    """No key holds the stretches at the passage's edges from all documents."""
    rng = random.Random(8)
    own = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=90))
    passage = own() + own()[:50]
    texts = [own() + passage + own() for _ in range(9_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    dealt = []
    deal = repeats.deal_pieces
    monkeypatch.setattr(repeats, "deal_pieces", lambda *a: dealt.append(deal(*a)) or dealt[-1])
    got = {r.row.doc_id: repeats.kept_bytes(r.row.text.encode(), r.ranges)[0].decode()
           for r in repeats.cut_repeats(docs).collect()}
    largest = dealt[0].groupBy("key").count().agg({"count": "max"}).first()[0]
    assert 1000 < largest < repeats.CROWD * 1.2
    seen = set()
    for i, text in enumerate(texts):
        gone = np.zeros(len(text), bool)
        for at in range(len(text) - 99):
            window = text[at : at + 100]
            if window in seen:
                gone[at : at + 100] = True
            seen.add(window)
        assert got[i] == "".join(c for c, g in zip(text, gone, strict=True) if not g)


def weighted(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(len(words), 1)))]
    return {g: grams.count(g) for g in set(grams)}


def jaccard(x, y):
    if not set(x) & set(y):
        return 0.0
    x, y = ({k: v / sum(s.values()) for k, v in s.items()} for s in (x, y))
    every = set(x) | set(y)
    return sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in every) for d in set(x) & set(y))


def test_near_duplicates(docs):
    rows = rows_of(docs)
    sets = [weighted(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            equal = (rows[i][1] or "") == (rows[j][1] or "")
            if equal or (len(sets[i]) < 400 and len(sets[j]) < 400 and jaccard(sets[i], sets[j]) >= 0.8):
                a, b = sorted((root(i), root(j)))
                group[b] = a
    want = {(rows[i][0], rows[root(i)][0]) for i in range(len(rows))}
    got = near_dedup.near_duplicate_classes(docs).collect()
    assert {(r.doc_id, r.class_id) for r in got} == want
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((key(r.doc_id) for r in kept.collect())) == sorted(key(c) for c in {c for _, c in want})


def test_agreeing_signatures_equal_pairwise_comparison():
    rng = np.random.default_rng(3)
    bands, rows = 5, 3
    one = rng.integers(0, 2, (150, bands * rows)).astype(np.uint32)
    two = rng.integers(0, 2, (40, bands * rows)).astype(np.uint32)
    class_x, class_y = rng.integers(0, 4, 150), rng.integers(0, 4, 40)
    for band in range(bands):
        want = set()
        for i in range(len(one)):
            for j in range(len(two)):
                same = one[i] == two[j]
                shared = [b for b in range(bands) if same[b * rows:(b + 1) * rows].all()]
                # Blocks meet under a band they share; argmax of none is the first.
                if class_x[i] != class_y[j] and same.mean() >= 0.6 and (shared or [0])[0] == band:
                    want.add((i, j, round(same.mean(), 9)))
        got = zip(*near_dedup._agreeing(one, two, class_x, class_y, 0.6, bands, band), strict=True)
        assert {(int(i), int(j), round(float(x), 9)) for i, j, x in got} == want


@pytest.mark.parametrize("block_bytes", [near_dedup.BLOCK_BYTES, 6_000])
def test_star_of_variants_is_one_class(spark, monkeypatch, block_bytes):
    """Variants near the base alone, and one chained over another variant; also over many blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", block_bytes)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]

    def edited(words, n):
        words = list(words)
        for at in rng.sample(range(len(words)), n):
            words[at] = f"e{rng.random()}"
        return words

    rows = [(i, " ".join(edited(base, 2))) for i in range(70)]
    far = edited(rows[7][1].split(), 2)
    rows += [(500, " ".join(far)), (501, " ".join(f"z{i}" for i in range(90)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [(i, weighted(t)) for i, t in rows]
    group = {i: i for i, _ in rows}
    for i, x in sets:
        for j, y in sets:
            if j < i and jaccard(x, y) >= 0.8:
                a, b = group[i], group[j]
                group = {k: min(a, b) if g in (a, b) else g for k, g in group.items()}
    assert {(r.doc_id, r.class_id) for r in near_dedup.near_duplicate_classes(df).collect()} == set(group.items())


def test_quality_rules_on_odd_texts(docs):
    for r in repetition.repetition_rules(docs).collect():
        if r.n_words == 0:
            assert r.base_failed and not r.kept and r.word_chars == 0
    many = {r.doc_id for r in docs.collect() if r.text and len(r.text.split()) == 4000}
    assert {r.doc_id for r in repetition.repetition_rules(docs).collect() if r.n_words == 4000} == many


def test_packing(docs, nothing):
    rows = packing.pack_documents(docs, capacity=200, per_source=2, shard_rows=40).collect()
    sizes, parts = {}, {}
    for r in docs.collect():
        sizes.setdefault((key(r.doc_id), len((r.text or "").encode())), 0)
        sizes[key(r.doc_id), len((r.text or "").encode())] += 1
    bins = {}
    for r in rows:
        parts.setdefault((key(r.doc_id)), []).append(r.size)
        assert (r.bin is None) == (r.size == 0)
        if r.bin is not None:
            bins.setdefault((r.shard, r.bin), []).append(r)
    total = sum(size * n for (_, size), n in sizes.items())
    assert sum(map(sum, parts.values())) == total
    for held in bins.values():
        assert sum(r.size for r in held) <= 200
        clusters = [r.cluster for r in held if r.cluster is not None]
        assert len(clusters) == len(set(clusters))
        sources = [r.source for r in held if r.source is not None]
        assert len(held) == 1 or max(map(sources.count, sources), default=0) <= 2
    assert packing.pack_documents(nothing).count() == 0


def test_packing_is_best_fit():
    rng = np.random.default_rng(3)
    for _ in range(20):
        n = 120
        sizes, sources = rng.integers(1, 40, n), rng.integers(-1, 3, n)
        clusters = rng.integers(0, 5, n).astype(np.uint64)
        got = packing.pack_shard(sizes, sources, clusters, 60, 2)
        left, held = [], []
        for i in np.lexsort((sources, clusters, -sizes)).tolist():
            fits = [left[b] for b in range(len(left)) if left[b] >= sizes[i]
                    and not (clusters[i] and clusters[i] in [clusters[j] for j in held[b]])
                    and (sources[i] < 0 or [sources[j] for j in held[b]].count(sources[i]) < 2)]
            b = got[i]
            if not fits:
                assert b == len(left)
                left.append(60)
                held.append([])
            else:
                assert left[b] == min(fits)
            left[b] -= sizes[i]
            held[b].append(i)


def test_packing_is_best_fit_with_thousands_of_clusters():
    """Clusters share bits of the bitmap; equal sizes of other clusters lie in between."""
    rng = np.random.default_rng(4)
    for most in (12, 90):
        n = 1500
        sizes, clusters = rng.integers(1, most, n), rng.integers(1, 1 << 60, n // 2).astype(np.uint64)
        clusters = clusters[rng.integers(0, len(clusters), n)]
        got = packing.pack_shard(sizes, np.full(n, -1), clusters, 100, 9)
        left, bits = np.empty(n, np.int64), np.zeros((n, packing.CLUSTER_BITS), bool)
        used = 0
        for i in np.lexsort((np.full(n, -1), clusters, -sizes)).tolist():
            bit = int(clusters[i] % packing.CLUSTER_BITS)
            fits = np.flatnonzero((left[:used] >= sizes[i]) & ~bits[:used, bit])
            if not len(fits):
                assert got[i] == used
                left[used] = 100
                used += 1
            else:
                assert left[got[i]] == left[fits].min()
            left[got[i]] -= sizes[i]
            bits[got[i], bit] = True


def test_search_ties(spark):
    """Vectors of 0 and 1: many different ones tie, and the smaller ids come first."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(2)
    grid = np.unique(rng.integers(0, 2, size=(900, 10)), axis=0)
    grid = grid[grid.any(axis=1)]
    ids = rng.permutation(len(grid))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, grid.astype(float), strict=True)],
                               "vec_id long, embedding array<double>")
    got = {}
    for r in multi_index.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    hits = 0
    for q, found in got.items():
        score = dict(zip(ids.tolist(), (grid @ grid[int(np.flatnonzero(ids == q)[0])]).tolist(), strict=True))
        order = sorted((i for i in score if i != q), key=lambda i: (-score[i], i))[:20]
        listed = [found[k] for k in range(1, 21)]
        assert listed == sorted(listed, key=lambda i: (-score[i], i))
        hits += len(set(listed) & set(order))
    assert hits / (20 * len(got)) >= 0.9


def test_search(spark):
    rng = np.random.default_rng(8)
    grid = rng.normal(size=(700, 16)) * rng.uniform(0.5, 2, size=(700, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(grid)]
    rows += [(1000 + i, rows[40][1]) for i in range(60)]  # equal vectors
    bad = [(None, rows[1][1]), (2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [None] * 16)]
    df = spark.createDataFrame(rows + bad + rows[:3], "vec_id long, embedding array<float>")
    from pyspark.sql import functions as F

    got = {}
    for r in multi_index.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append(r)
    ids = np.array([i for i, _ in rows])
    exact = np.array([v for _, v in rows]).astype(np.float32).astype(np.float64)
    hits = total = 0
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    for q, found in got.items():
        at = int(np.flatnonzero(ids == q)[0])
        score = exact @ exact[at]
        order = [i for i in np.lexsort((ids, -score)).tolist() if i != at][:20]
        found.sort(key=lambda r: r.rank)
        assert [r.rank for r in found] == list(range(1, 21))
        assert all(a.score > b.score or (a.score == b.score and a.vec_id < b.vec_id)
                   for a, b in zip(found, found[1:], strict=False))
        hits += len({r.vec_id for r in found} & {int(ids[i]) for i in order})
        total += 20
    assert hits / total >= 0.9
    few = spark.createDataFrame(rows[:5], "vec_id long, embedding array<float>")
    assert multi_index.nearest(few, F.col("vec_id") == 0).count() == 4
    assert multi_index.nearest(few.limit(0), F.col("vec_id") == 0).count() == 0


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    grades = ordinal.label_grades(labels)
    train = grades.filter("doc_id % 4 != 0")
    model = ordinal.fit_ordinal(docs, train, n_grades=3)
    assert (np.diff(model.thresholds) > 0).all()
    held = ordinal.score_ordinal(docs, model).join(grades.filter("doc_id % 4 = 0"), "doc_id").collect()
    kept = {g: [r.tails[1] >= ordinal.KEEP_TAIL for r in held if r.grade == g] for g in (0, 1, 2)}
    assert np.mean(kept[2]) > 0.95 and np.mean(kept[1]) < 0.1 and np.mean(kept[0]) < 0.1
    assert all(r.tails[0] >= r.tails[1] for r in held)


def test_kept_text_goes_to_python_once(spark):
    docs = spark.createDataFrame([(1, "a b", "en"), (2, None, "de"), (2, None, "de"), (3, "", None)],
                                 "doc_id long, text string, lang string")
    model = ordinal.fit_ordinal(docs, spark.createDataFrame([], "doc_id long, grade int"), n_grades=3)
    scored = ordinal.score_ordinal(docs, model, keep=("text", "lang"))
    assert sorted(scored.select(*docs.columns).collect(), key=str) == sorted(docs.collect(), key=str)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "_keep_0" not in plan and "_keep_1" in plan
    batches = docs.repartition(1).crossJoin(spark.range(4)).select(F.repeat(F.lit("x"), 3 << 20).alias("text"))
    sizes = batches.mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in bs), "n long")
    assert max(r.n for r in sizes.collect()) < 16  # 48 MB of texts, not in one batch


def test_tables_that_a_worker_keeps_are_small():
    from sablewatch.llm import blocks

    data = np.tile(np.frombuffer(b"0123456789abcdef", np.uint8), blocks.BLOCK_BYTES // 16)
    hashes = blocks.PieceHash(data)
    assert hashes([0], [4096]) == hashes([16], [4112]) != hashes([1], [4097])
    assert sum(t.nbytes for pair in blocks._TABLES.values() for t in pair) <= 25 << 20


def test_classifier_without_labels(spark, docs, nothing):
    none = spark.createDataFrame([], "doc_id long, grade int")
    model = ordinal.fit_ordinal(docs, none, n_grades=3)
    assert {r.tails[1] >= 0.35 for r in ordinal.score_ordinal(docs, model).collect()} == {True}
    assert ordinal.score_ordinal(nothing, model).count() == 0


def test_empty_tables(nothing):
    assert repetition.repetition_rules(nothing).count() == 0
    assert line_dedup.dedup_lines(nothing).count() == 0
    assert near_dedup.near_duplicate_classes(nothing).count() == 0
    assert repeats.remove_repeats(nothing).count() == 0


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, before, sf)
        assert out.columns == docs.columns, name
        assert out.count() <= before.count()
        before = out
    ids = {r.doc_id for r in before.select("doc_id").collect()}
    packed = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in packed} == ids


def test_plain_jaccards_equal_the_weighted_index():
    rng = np.random.default_rng(3)
    sets = []
    for n in (0, 1, 5, 40, 40, 60):
        elements = np.unique(rng.integers(0, 70, n).astype(np.uint64))
        sets.append((elements, np.ones(len(elements), np.int64)))
    sets.append((sets[3][0], np.where(np.arange(len(sets[3][0])) == 0, 2, 1)))
    for one in sets:
        for two, found in zip(sets, near_dedup.plain_jaccards(one, sets), strict=True):
            plain = all(len(e) and w.max() == 1 for e, w in (one, two))
            assert np.isnan(found) != plain
            if plain:
                assert abs(found - near_dedup.probability_jaccard(one, two)) < 1e-12
