"""Quality rules by repetition coverage.

Rolling hashes of word n-grams of several lengths, in numpy over whole blocks of
texts, measure how many characters stand inside n-grams or lines that a text
holds more than once. Texts are judged one by one: no shuffle, no state.

Null text: no words. Empty text, or one without words: all counts 0, base rule
failed, not kept. Other columns of the input are ignored. Each row gives a row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sablewatch.llm.blocks import Block, PieceHash, map_blocks, mix, range_sums
from sablewatch.llm.registry import query, table
from sablewatch.llm.words import code_points, word_edges

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

#: n-gram length -> most percent of word characters inside repeated n-grams.
NGRAM_LIMITS = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
#: Most percent of word characters inside lines equal to an earlier line.
LINE_LIMIT = 30
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20


def _repeated(keys: np.ndarray) -> np.ndarray:
    """True where the key occurs at least twice."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def repetition_counts(block: Block, lengths: list[int]) -> dict[str, np.ndarray]:
    """Per text: the base counts and the characters covered for each n."""
    data, bounds = block.data, block.bounds
    hashes, points = PieceHash(data), code_points(data)
    starts, ends, ranges = word_edges(block)
    chars = points[ends] - points[starts]
    doc = np.repeat(np.arange(len(block)), np.diff(ranges))
    salt = mix(np.arange(len(block)) + 1)
    out = {
        "n_words": np.diff(ranges),
        "word_chars": range_sums(chars, ranges),
        "n_symbols": range_sums(SYMBOLS[data], bounds),
    }

    # Lines: between newlines and text edges; only those with a word count.
    breaks = np.flatnonzero(data == 0x0A)
    line_starts = np.unique(np.concatenate([bounds[:-1], breaks + 1]))
    line_starts = line_starts[line_starts < len(data)]
    line_ends = np.append(line_starts[1:], len(data))
    line_ends -= (data[line_ends - 1] == 0x0A) if len(line_starts) else 0
    first, last = np.searchsorted(starts, line_starts), np.searchsorted(starts, line_ends)
    worded = last > first
    line_starts, line_ends, first, last = (x[worded] for x in (line_starts, line_ends, first, last))
    line_doc = np.searchsorted(bounds, line_starts, side="right") - 1
    keys = hashes(line_starts, line_ends) ^ salt[line_doc]
    again = np.ones(len(keys), bool)
    again[np.unique(keys, return_index=True)[1]] = False
    total = np.concatenate([[0], np.cumsum(chars)])
    out["n_dup_lines"] = np.bincount(line_doc[again], minlength=len(block))
    out["dup_line_chars"] = np.bincount(
        line_doc[again], (total[last] - total[first])[again], len(block)).astype(np.int64)

    grams = hashes(starts, ends)
    words = grams
    live = np.arange(len(words))
    step = np.uint64(0xD6E8FEB86659FD93)
    top = max(lengths)
    size = 1
    while size < top and len(live):
        size += 1
        # An n-gram can repeat only where both (n-1)-grams in it repeat.
        if size > min(lengths) + 1:
            repeats = np.zeros(len(words) + 1, bool)
            repeats[live] = True
            live = live[repeats[live + 1]]
        live = live[live + size <= len(words)]
        live = live[doc[live] == doc[live + size - 1]]
        longer = np.zeros(len(words), np.uint64)
        longer[live] = mix(grams[live] * step + words[live + size - 1])
        grams = longer
        if size < min(lengths):
            continue
        live = live[_repeated(grams[live] ^ salt[doc[live]])]
        if size in lengths:
            depth = np.zeros(len(words) + 1, np.int64)
            np.add.at(depth, live, 1)
            np.add.at(depth, live + size, -1)
            covered = np.cumsum(depth[:-1]) > 0
            out[f"dup_chars_{size}"] = range_sums(chars * covered, ranges)
            if size == min(lengths):
                out["n_repeat_words"] = range_sums(covered, ranges)
    zero = np.zeros(len(block), np.int64)
    for name in ["n_repeat_words", *(f"dup_chars_{n}" for n in lengths)]:
        out.setdefault(name, zero)
    return out


def repetition_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                     ngram_limits: dict[int, int] | None = None,
                     line_limit: int = LINE_LIMIT) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` for every document.

    The shortest length in ``ngram_limits`` is also the window of
    ``n_repeat_words``.
    """
    limits = dict(ngram_limits or NGRAM_LIMITS)
    lengths = sorted(limits)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
             "dup_line_chars", *(f"dup_chars_{n}" for n in lengths)]
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def count(block, rows):
        counted = repetition_counts(block, lengths)
        return {"doc_id": rows.column(0), **{n: counted[n].astype(np.int64) for n in names}}

    id_type = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, " + ", ".join(f"{n} long" for n in names)
    counts = map_blocks(source, "text", count, schema)
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    good = 100 * F.col("dup_line_chars") <= line_limit * F.col("word_chars")
    for n in lengths:
        good &= 100 * F.col(f"dup_chars_{n}") <= limits[n] * F.col("word_chars")
    return counts.withColumn("base_failed", failed).withColumn("kept", ~failed & good)


def _oracle() -> str:
    lengths = sorted(NGRAM_LIMITS)
    cover = ",\n".join(
        f"""g{n} AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + {n - 1}), ' ') AS g
             FROM w, unnest(range(1, len(ws) - {n - 2})) AS u(i) WHERE len(ws) >= {n}),
        c{n} AS (SELECT doc_id, sum(length(ws[p])) AS chars, count(*) AS words FROM (
             SELECT DISTINCT doc_id, i + k AS p FROM (
               SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g{n})
             , unnest(range(0, {n})) AS u(k) WHERE n > 1) JOIN w USING (doc_id) GROUP BY doc_id)"""
        for n in lengths)
    joins = "\n".join(f"LEFT JOIN c{n} USING (doc_id)" for n in lengths)
    columns = ", ".join(f"coalesce(c{n}.chars, 0)::BIGINT AS dup_chars_{n}" for n in lengths)
    good = " AND ".join(f"100 * dup_chars_{n} <= {NGRAM_LIMITS[n]} * word_chars" for n in lengths)
    return rf"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text,
          regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        l AS (SELECT doc_id, list_filter(string_split(text, chr(10)),
            lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
        n AS (SELECT doc_id, x, length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) AS chars,
            row_number() OVER (PARTITION BY doc_id, x) AS k FROM l, unnest(ls) AS u(x)),
        d AS (SELECT doc_id, count(*) AS n, sum(chars) AS chars FROM n WHERE k > 1 GROUP BY 1),
        {cover},
        b AS (SELECT doc_id, len(ws)::BIGINT AS n_words,
          coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
          length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
          coalesce(d.n, 0)::BIGINT AS n_dup_lines,
          coalesce(c{lengths[0]}.words, 0)::BIGINT AS n_repeat_words,
          coalesce(d.chars, 0)::BIGINT AS dup_line_chars, {columns}
          FROM w LEFT JOIN d USING (doc_id) {joins}),
        f AS (SELECT *, n_words < {MIN_WORDS}
          OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM b)
        SELECT *, NOT base_failed AND 100 * dup_line_chars <= {LINE_LIMIT} * word_chars
          AND {good} AS kept FROM f"""


@query("op2_repetition_rules", _oracle())
def op2_repetition_rules(spark, sf_dir):
    return repetition_rules(table(spark, sf_dir, "documents"))
