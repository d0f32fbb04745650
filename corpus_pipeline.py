"""From raw documents to packed training sequences, a stage at a time.

Each stage takes ``(spark, docs, sf_dir)`` and returns a table, which is written as
Parquet and read again as the next stage's input; all but the last return the columns
of ``documents``. A stage works on every row that the one before it has kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sablewatch.llm.line_dedup import dedup_lines
from sablewatch.llm.near_dedup import keep_one
from sablewatch.llm.ordinal import GOOD, KEEP_TAIL, fit_ordinal, label_grades, score_ordinal
from sablewatch.llm.packing import pack_documents
from sablewatch.llm.registry import table
from sablewatch.llm.repeats import remove_repeats
from sablewatch.session import cut_lineage


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows a changed text; documents without any text left go."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).filter(
        F.length(F.trim("text")) > 0)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that reach the best grade with enough probability."""
    labels = label_grades(table(spark, sf_dir, "labels"))
    model = fit_ordinal(docs, labels, n_grades=3)
    others = tuple(c for c in docs.columns if c != "doc_id")
    scored = score_ordinal(docs, model, keep=others)
    return scored.filter(F.col("tails")[GOOD - 1] >= KEEP_TAIL).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that equal or nearly equal an earlier line are cut."""
    return _counted(dedup_lines(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies."""
    return keep_one(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes and more that stand earlier are cut."""
    return _counted(remove_repeats(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes."""
    return pack_documents(docs)


STAGES = [
    ("quality", quality),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("passage_dedup", passages),
    ("packing", packing),
]

#: The classifier and the greedy packing cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
