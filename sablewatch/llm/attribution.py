"""Token counts per field and section of a document that is encoded once.

The fields of a row are joined by newlines into one document, which is encoded as
a whole, so that counts add up to the document's. Each token has a span of code
points; spans are joined to the sections' intervals by binary search. A section is
a whole field, or a line of a field named in ``split``; a separator belongs to the
section before it. A token that crosses an edge goes, whole, by the explicit rule

* ``first``: to the section of its first code point,
* ``last``: to the section of its last code point,
* ``most``: to the section holding most of its code points, ties to the earlier.

A token that holds only part of a code point's bytes has that code point as span.

Null field: an empty one; it still has one section. Empty sections are returned
with 0 characters (or 1, their separator). Rows are counted one by one; repeated
rows give repeated results, other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sablewatch.llm.blocks import map_blocks
from sablewatch.llm.byte_tokens import default_tokenizer, encode_block, token_table
from sablewatch.llm.registry import query, table
from sablewatch.llm.words import code_points

RULES = ("first", "last", "most")


def allocate(edges: np.ndarray, start: np.ndarray, end: np.ndarray, rule: str) -> np.ndarray:
    """The section of every span; section ``i`` is ``[edges[i], edges[i+1])``."""
    first = np.searchsorted(edges, start, "right") - 1
    if rule == "first":
        return first
    last = np.searchsorted(edges, end - 1, "right") - 1
    if rule == "last":
        return last
    out = first.copy()
    for i in np.flatnonzero(first != last).tolist():
        sections = np.arange(first[i], last[i] + 1)
        share = np.minimum(edges[sections + 1], end[i]) - np.maximum(edges[sections], start[i])
        out[i] = sections[np.argmax(share)]
    return out


def token_attribution(docs: DataFrame, fields: list[str], *, split: tuple[str, ...] = (),
                      rule: str = "first", id_col: str = "doc_id",
                      tokenizer: str | None = None) -> DataFrame:
    """``doc_id, field, section, start_char, n_chars, n_tokens`` of every section.

    ``section`` counts from 0 within its field; ``start_char`` is its place in the
    joined document.
    """
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}")
    path = tokenizer or default_tokenizer()
    texts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    source = docs.select(
        F.col(id_col).alias("doc_id"), F.concat_ws("\n", *texts).alias("text"),
        *(F.char_length(t).cast("long").alias(f"size_{i}") for i, t in enumerate(texts)))
    cut = np.array([f in split for f in fields])

    def run(block, rows):
        known = token_table(path, True)
        ids, token_edges, used = encode_block(block, known)
        n_docs, n_fields = len(block), len(fields)
        points = code_points(block.data)
        base = points[block.bounds]  # edges of documents, in code points of the block
        # Token spans, in code points of the block.
        chars, _ = known.columns["chars"].take(used)
        ends = np.cumsum(chars)
        begins = ends - chars
        inner = chars == 0  # such a token holds later bytes of the code point before
        begins[inner] -= 1
        ends = np.maximum(ends, begins + 1)
        # Field edges; every field but the last has its separator.
        sizes = np.stack([rows.column(2 + i).to_numpy() for i in range(n_fields)], axis=1)
        sizes[:, :-1] += 1
        field_at = base[:-1, None] + np.cumsum(sizes, axis=1) - sizes
        at = [field_at.ravel()]
        owner = [np.arange(n_docs * n_fields)]
        if cut.any():
            lines = np.flatnonzero(block.data == 0x0A)
            doc = np.searchsorted(block.bounds, lines, "right") - 1
            line_at = points[lines] + 1
            for i in np.flatnonzero(cut).tolist():
                start = field_at[doc, i]
                stop = start + sizes[doc, i] - (i + 1 < n_fields)
                own = (line_at > start) & (line_at <= stop)
                at.append(line_at[own])
                owner.append(doc[own] * n_fields + i)
        at, owner = np.concatenate(at), np.concatenate(owner)
        order = np.lexsort((at, owner))
        at, owner = at[order], owner[order]
        edges = np.append(at, base[-1])
        section = np.arange(len(owner)) - np.searchsorted(owner, owner)
        # Sections of width 0 hold no code point, and binary search passes over them.
        counts = np.bincount(allocate(edges, begins, ends, rule), minlength=len(at))
        doc = owner // n_fields
        return {"doc_id": rows.column(0).take(doc), "field": np.array(fields, object)[owner % n_fields],
                "section": section, "start_char": at - base[doc], "n_chars": np.diff(edges),
                "n_tokens": counts}

    id_type = source.schema["doc_id"].dataType.simpleString()
    return map_blocks(source, "text", run, f"doc_id {id_type}, field string, section long, "
                      "start_char long, n_chars long, n_tokens long")


@query("op8_token_attribution")
def op8_token_attribution(spark, sf_dir):
    return token_attribution(table(spark, sf_dir, "documents"), ["source", "lang", "text"],
                             split=("text",))
