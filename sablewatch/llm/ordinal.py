"""Quality classifier: ordinal regression with cumulative links on hashed text.

Grades are ordered 0 .. K-1. One weight vector ``w`` over hashed text features is
shared by all grades, with ascending thresholds ``t_1 < ... < t_(K-1)``:

    P(grade >= k | x) = sigmoid(w . x - t_k)

which gives the expected grade (the sum over k) and the tail probability that a
document reaches a wanted grade.

Features are read from the bytes of the whole text, in numpy: the presence of each
word (letters folded to lower case in ASCII, marks at its edges cut off), of each
pair of marks at a word's end, and of steps of four shares (capital letters, marks,
variety of words, length in words). Only features are weighed whose presence differs
clearly between grades in the sample, so that rare words carry no noise.

``fit_ordinal`` learns from at most ``sample`` labelled documents, those with the
smallest hash of their id; scoring runs over every row of the table, without a
shuffle. The model is one small array per feature kept, at most ``max_features``.

Null text: an empty one, which has no features. Null grades are not learned from.
Repeated rows give repeated results. With no labels, or one grade alone, every
document gets the share of each grade seen (grade K-1 if none was).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sablewatch.llm.blocks import Block, PieceHash, map_blocks, mix, range_sums
from sablewatch.llm.registry import query, table
from sablewatch.llm.words import word_edges
from sablewatch.session import small_batches

#: Most labelled documents learned from.
SAMPLE = 8_000
#: Most features with a weight.
MAX_FEATURES = 20_000
#: Least difference of a feature's presence between grades, in standard errors.
MIN_Z = 4.0
#: Grades of the ``labels`` table: 0 toxic, 1 poor, 2 good.
TOXIC, POOR, GOOD = 0, 1, 2
#: A document is kept if it reaches the best grade with this probability.
KEEP_TAIL = 0.35

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_MARK = np.zeros(256, bool)
_MARK[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def text_features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """``(text, feature)`` pairs, each once: which text holds which feature."""
    data = _FOLD[block.data]
    hashes = PieceHash(data)
    starts, ends, ranges = word_edges(block)
    doc = np.repeat(np.arange(len(block)), np.diff(ranges))
    # Marks at a word's edges, up to four on each side, stand apart from it.
    left, right = starts.copy(), ends.copy()
    for _ in range(4):
        left += (left < right - 1) & _MARK[data[left]]
        right -= (right > left + 1) & _MARK[data[right - 1]]
    words = hashes(left, right)
    tail = np.maximum(ends - 2, starts)
    marked = _MARK[data[tail]] & _MARK[data[ends - 1]] & (ends - tail == 2)
    salt = np.uint64(0x632BE59BD9B4E019)
    features = [words, mix(hashes(tail[marked], ends[marked]) ^ salt)]
    owners = [doc, doc[marked]]

    # Steps of shares, per text.
    n_words = np.maximum(np.diff(ranges), 1)
    size = np.maximum(np.diff(block.bounds), 1)
    distinct = np.unique(words ^ mix(doc + 1), return_index=True)[1]
    spread = np.bincount(doc[distinct], minlength=len(block))
    shares = [
        range_sums(_UPPER[block.data], block.bounds) / size,
        range_sums(_MARK[block.data], block.bounds) / size,
        # Long texts repeat words by nature; root-scaled variety allows for it.
        np.minimum(spread / np.sqrt(n_words) / 25, 1),
        np.minimum(np.log2(n_words) / 16, 1),
    ]
    for kind, share in enumerate(shares):
        step = np.floor(np.sqrt(share) * 12).astype(np.uint64)
        features.append(mix(step + np.uint64(1000 * (kind + 1))))
        owners.append(np.arange(len(block)))
    owner, feature = np.concatenate(owners), np.concatenate(features)
    once = np.unique(feature ^ mix(owner + 1), return_index=True)[1]
    return owner[once], feature[once]


@dataclass(frozen=True)
class OrdinalModel:
    features: np.ndarray  # ascending feature hashes
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one less than grades

    def tails(self, n: int, owner: np.ndarray, feature: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. K-1, a column each."""
        at = np.searchsorted(self.features, feature)
        at[at == len(self.features)] = 0
        known = self.features[at] == feature if len(self.features) else np.zeros(len(feature), bool)
        score = np.bincount(owner[known], self.weights[at[known]], n)
        return 1 / (1 + np.exp(np.clip(self.thresholds - score[:, None], -500, 500)))


def select_features(owner: np.ndarray, feature: np.ndarray, grade: np.ndarray, n_grades: int,
                    min_z: float, most: int) -> np.ndarray:
    """Features whose presence splits the grades, at any threshold, by ``min_z``."""
    distinct, inverse = np.unique(feature, return_inverse=True)
    total, n = np.bincount(inverse), len(grade)
    best = np.zeros(len(distinct))
    for k in range(1, n_grades):
        high = grade >= k
        share = high.mean() if n else 0.0
        if share in (0.0, 1.0):
            continue
        seen = np.bincount(inverse, high[owner], len(distinct))
        error = np.sqrt(total * share * (1 - share) * np.maximum(1 - total / n, 1e-9) + 0.5)
        best = np.maximum(best, np.abs(seen - total * share) / error)
    best[total < 4] = 0
    top = np.argsort(-best, kind="stable")[:most]
    return np.sort(distinct[top[best[top] >= min_z]])


def fit_weights(owner: np.ndarray, feature: np.ndarray, grade: np.ndarray, n_grades: int,
                min_z: float = MIN_Z, max_features: int = MAX_FEATURES, l2: float = 1e-4,
                rounds: int = 400) -> OrdinalModel:
    """Maximum likelihood of the cumulative-link model by adaptive gradient steps."""
    n = len(grade)
    seen = np.bincount(grade, minlength=n_grades) + 0.5 if n else np.array([1e-3] * (n_grades - 1) + [1.0])
    above = 1 - np.cumsum(seen)[:-1] / seen.sum()
    start = -np.log(above / (1 - above))
    kept = select_features(owner, feature, grade, n_grades, min_z, max_features)
    if not len(kept):
        return OrdinalModel(kept, np.empty(0), start)
    at = np.minimum(np.searchsorted(kept, feature), len(kept) - 1)
    known = kept[at] == feature
    owner, at = owner[known], at[known]
    # Thresholds: the first, and positive gaps after it.
    params = np.concatenate([np.zeros(len(kept)), start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    cut = len(kept)
    first, second = np.zeros_like(params), np.zeros_like(params)
    weigh = (n / (n_grades * seen))[grade]  # each grade counts alike
    rows = np.arange(n)
    for step in range(1, rounds + 1):
        gaps = np.exp(params[cut + 1 :])
        t = params[cut] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(owner, params[at], n)
        inner = 1 / (1 + np.exp(np.clip(t - score[:, None], -500, 500)))
        tails = np.column_stack([np.ones(n), inner, np.zeros(n)])
        slopes = tails * (1 - tails)
        p = np.maximum(tails[rows, grade] - tails[rows, grade + 1], 1e-9)
        d_score = -weigh * (slopes[rows, grade] - slopes[rows, grade + 1]) / p / n
        d_t = np.zeros((n, n_grades + 1))
        d_t[rows, grade] += weigh * slopes[rows, grade] / p / n
        d_t[rows, grade + 1] -= weigh * slopes[rows, grade + 1] / p / n
        d_t = d_t.sum(axis=0)[1:-1]
        later = np.cumsum(d_t[::-1])[::-1]  # a gap moves all thresholds after it
        gradient = np.concatenate([
            np.bincount(at, d_score[owner], cut) + l2 * params[:cut], later[:1], later[1:] * gaps])
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        params -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    t = params[cut] + np.concatenate([[0.0], np.cumsum(np.exp(params[cut + 1 :]))])
    return OrdinalModel(kept, params[:cut], t)


def fit_ordinal(docs: DataFrame, grades: DataFrame, *, n_grades: int, id_col: str = "doc_id",
                text_col: str = "text", sample: int = SAMPLE, **options) -> OrdinalModel:
    """Learn from documents whose id has a grade; ``grades`` holds ``id_col, grade``.

    The sample is bounded, so the driver holds at most ``sample`` documents' features.
    """
    chosen = (grades.filter(F.col("grade").isNotNull() & F.col(id_col).isNotNull())
              .groupBy(F.col(id_col).alias("doc_id")).agg(F.min("grade").cast("int").alias("grade"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # At most `sample` rows of two numbers: small enough to send to every task.
    rows = source.join(F.broadcast(chosen), "doc_id").select("grade", "text")

    def features(block, part):
        owner, feature = text_features(block)
        order = np.argsort(owner, kind="stable")
        edges = np.searchsorted(owner[order], np.arange(len(block) + 1))
        raw = feature[order]
        return {"grade": part.column(0),
                "features": [raw[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]}

    found = map_blocks(rows, "text", features, "grade int, features binary").collect()
    found.sort(key=lambda r: (r.grade, bytes(r.features)))  # any order of rows, one model
    sets = [np.frombuffer(r.features, np.uint64) for r in found]
    grade = np.array([r.grade for r in found], np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    feature = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    return fit_weights(owner, feature, grade, n_grades, **options)


def score_ordinal(docs: DataFrame, model: OrdinalModel, *, id_col: str = "doc_id",
                  text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, expected_grade, tails`` and the columns named in ``keep``."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # bounded by max_features
    small_batches(spark)
    # Kept columns travel under names of their own, whatever they are called; a kept text
    # is there already and is not sent twice.
    inner = ["text" if c == text_col else f"_keep_{i}" for i, c in enumerate(keep)]
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                         *(F.col(f"`{c}`").alias(n) for c, n in zip(keep, inner, strict=True) if n != "text"))

    def score(block, rows):
        tails = sent.value.tails(len(block), *text_features(block))
        return {"doc_id": rows.column(0), "expected_grade": tails.sum(axis=1), "tails": list(tails),
                **{n: rows.column(rows.schema.get_field_index(n)) for n in inner}}

    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    schema = f"doc_id {kinds['doc_id']}, expected_grade double, tails array<double>"
    scored = map_blocks(source, "text", score, schema + "".join(f", {n} {kinds[n]}" for n in inner))
    return scored.select("doc_id", "expected_grade", "tails",
                         *(F.col(n).alias(c) for c, n in zip(keep, inner, strict=True)))


def label_grades(labels: DataFrame) -> DataFrame:
    """``doc_id, grade`` of the labels table: toxic below poor below good."""
    toxic, quality = F.col("toxic"), F.col("quality")
    grade: Column = (F.when(toxic == 1, TOXIC).when(quality == 0, POOR)
                     .when((quality == 1) & (toxic == 0), GOOD))
    return labels.select("doc_id", grade.alias("grade"))


@query("op7_ordinal_quality")
def op7_ordinal_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_ordinal(docs, label_grades(labels), n_grades=3)
    scored = score_ordinal(docs, model)
    good = F.col("tails")[GOOD - 1]
    return scored.select(
        "doc_id", F.round("expected_grade", 6).alias("expected_grade"),
        F.round(F.col("tails")[0], 6).alias("not_toxic"), F.round(good, 6).alias("good"),
        (good >= KEEP_TAIL).alias("kept"))
